"""Context assembly: the best candidates of each request, rendered into a byte budget."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Order of the reasons to show a text, and the response's limits.
PRIORITIES = ("bootstrap", "guidance", "explicit", "linked", "related")
MAX_ITEMS, MAX_RESPONSE = 40, 64 * 1024
DEFAULT_BUDGET, MAX_BUDGET = 16 * 1024, 48 * 1024


def candidates(rows: DataFrame) -> DataFrame:
    """J17, T7 for (request, path, priority, start_line, evidence, ...): one row a path, the best by (priority, start_line), with all evidence joined in that order."""
    rest = [c for c in rows.columns if c not in ("request", "path", "evidence")]
    best = F.min_by(F.struct(*rest), F.struct("priority", "start_line")).alias("best")
    evidence = F.transform(F.sort_array(F.collect_list(F.struct("priority", "start_line", "evidence"))), lambda x: x["evidence"])
    return rows.groupBy("request", "path").agg(best, F.array_distinct(F.flatten(evidence)).alias("evidence")).select("request", "path", "best.*", "evidence")


def fit(content: str, start: int, budget: int) -> tuple[str, int | None]:
    """Whole lines from `start` (one-based) that fit, and the next line if any is left."""
    lines = content.removesuffix("\n").split("\n") if content else []
    out, size = [], 0
    for i in range(start - 1, len(lines)):
        cost = len(lines[i].encode()) + (1 if out else 0)
        if size + cost > budget:
            return "\n".join(out), i + 1
        out.append(lines[i])
        size += cost
    return "\n".join(out), None


def _render(request, rows: pd.DataFrame, budget: int) -> Iterator[tuple]:
    rows = rows.sort_values(["priority", "path", "start_line"], kind="stable")
    guided = int((rows["priority"] <= 1).sum())
    share = budget if guided == len(rows) else budget // 4
    used, count = 0, 0
    for r in rows.itertuples(index=False):
        left = budget - used
        if left <= 0 or count == MAX_ITEMS:
            return
        allowed = min(left, share // max(1, guided)) if r.priority <= 1 else left
        text, more = fit(r.content or "", int(r.start_line), allowed)
        size = len(text.encode())
        if r.priority <= 1:
            guided -= 1
            share -= size
        if text.strip():
            yield request, count, r.path, PRIORITIES[r.priority], text, more, size
            used, count = used + size, count + 1
        if more is not None and r.priority > 1:
            return


def assemble(picked: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """(request, item, path, reason, content, next_start_line, bytes).

    What an item gets depends on what earlier ones used, so a request is
    rendered in order by one group; guidance shares a quarter of the budget
    evenly while other candidates exist. A request's candidates are few by
    contract (the catalog bounds them), requests are spread over the cluster.
    """
    if not 1 <= budget <= MAX_BUDGET:
        raise ValueError("budget must be 1 to 49152 bytes")

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["request", "item", "path", "reason", "content", "next_start_line", "bytes"]
        out = pd.DataFrame(list(_render(key[0], rows, budget)), columns=names)
        out["next_start_line"] = out["next_start_line"].astype("Int32")
        return out

    kind = dict(picked.dtypes)["request"]
    schema = f"request {kind}, item int, path string, reason string, content string, next_start_line int, bytes int"
    return picked.select("request", "path", "priority", "start_line", "content").groupBy("request").applyInPandas(run, schema)


def bound(response: dict, most: int = MAX_RESPONSE) -> dict:
    """Halves the last item's content, drops it once it is empty, then drops diagnostics, until the JSON fits."""
    out = {**response, "items": [dict(i) for i in response.get("items", [])], "diagnostics": list(response.get("diagnostics", []))}
    size = lambda: len(json.dumps(out, ensure_ascii=False).encode())
    while size() > most and (out["items"] or out["diagnostics"]):
        out["truncated"] = True
        if out["items"]:
            last = out["items"][-1]
            lines = last["content"].split("\n")
            if len(lines) > 1:
                last["content"] = "\n".join(lines[: len(lines) // 2])
                last["next_start_line"] = last.get("start_line", 1) + len(lines) // 2
            else:
                out["items"].pop()
        else:
            out["diagnostics"].pop()
    return out
