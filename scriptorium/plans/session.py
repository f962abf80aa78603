"""What a session needs to run this package's Python functions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Python workers can import the package, wherever the driver was started. Executors on other machines need it installed at the same place."""
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(":"):
        sc.environment["PYTHONPATH"] = f"{path}:{ROOT}" if path else ROOT


def local_session(cpus: int = 8, partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("scriptorium").config("spark.sql.shuffle.partitions", str(partitions or cpus)).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
