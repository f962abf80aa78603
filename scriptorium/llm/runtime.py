"""What the operators need of a session: shared checkpoints, worker imports, bounded broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Workers can import this package; checkpoints go to the cluster's shared folder.

    spark.checkpoint.dir is the cluster's choice and is left alone. Only a
    local session may leave it unset, as in tests; a folder of this machine is
    used there. Elsewhere executors could not see such a folder, so it is an error.
    """
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(":"):
        sc.environment["PYTHONPATH"] = f"{path}:{_ROOT}" if path else _ROOT
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scriptorium-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    prepare(spark)
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, compression: str = "lz4_raw") -> DataFrame:
    """Write df as a compressed table in the shared checkpoint folder and go on from there.

    Lost executors then repeat nothing that came before, and later plans know
    the table's size. `release` removes a cut whose successor is written; what
    is left goes when the session or this process ends. Folders that a killed
    process left behind begin with `scriptorium-cut-`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scriptorium-cut-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = spark
    out._scriptorium_cut = path
    return out


_written: dict[str, SparkSession] = {}


def release(*cuts: DataFrame) -> None:
    """Delete these cuts. Nothing that is still to be computed may read them.

    The shuffle files of the plans that wrote them go as well, see `sweep`.
    """
    spark = None
    for df in cuts:
        path = getattr(df, "_scriptorium_cut", None)
        spark = _written.pop(path, None) or spark
        if spark is not None and path is not None:
            remove(spark, path)
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def sweep(df: DataFrame) -> None:
    """Have Spark drop the shuffle files of finished plans.

    It drops those of plans that the driver's collector has found unreachable,
    which it otherwise looks for twice an hour.
    """
    df.sparkSession.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        with contextlib.suppress(Exception):  # the session may have been stopped
            remove(spark, path)


def parallel(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt out anew over all shuffle partitions, for a small table whose rows are about to multiply."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


#: A key with a larger share of the rows than one in this many is joined by broadcast; there are never more such keys.
_HOT = 1000


def apart(df: DataFrame) -> DataFrame:
    """df, whose operators share no generated method with those that follow.

    The JVM leaves methods of more than 8000 bytes to the interpreter, which is
    some five times slower; a coalesce to more partitions than there are moves
    no row and ends a method.
    """
    return df.coalesce(1 << 20)


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows inner-joined with facts, which has one row a key and in `count` how many of the rows have it.

    No key loads one task: at most _HOT keys can each hold more than one in
    _HOT of the rows; these are broadcast, a table of bounded size. The rows of
    all other keys are shuffled. Both tables should be cuts, they are read twice.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = facts.where(F.col(count) * _HOT > total).drop(count)
    cold = facts.where(F.col(count) * _HOT <= total).drop(count)
    names = [c for c in (*rows.columns, *facts.columns) if c not in keys and c != count]
    some = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return some.select(*keys, *names).unionByName(rest.select(*keys, *names))


#: Slots of a sieve, of 64 bits each: a broadcast of at most this many pairs of longs, whatever the table's size.
_SLOTS = 19


def sieve_slot(key: str) -> Column:
    return F.shiftrightunsigned(key, 64 - _SLOTS)


def sieve_bit(key: str) -> Column:
    return F.shiftrightunsigned(key, 58 - _SLOTS).bitwiseAND(63).cast("int")


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(slot, bits): a bitmap of the hash column `key`, for `sift`. Its size is bounded by construction."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), sieve_bit(key))
    return cut(keys.groupBy(sieve_slot(key).alias("_slot")).agg(F.bit_or(bit).alias("_bits")))


def sift(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows whose hash may be among the keys of a sieve, without a shuffle: all that are, and few that are not while the bitmap is thinly filled."""
    held = rows.join(F.broadcast(found), sieve_slot(key) == F.col("_slot")).where(F.getbit("_bits", sieve_bit(key)) == 1)
    return held.drop("_slot", "_bits")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str, modulus: int):
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus
