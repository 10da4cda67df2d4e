"""Ranking with conditions: filter first and rank exactly, or rank inside an index and filter then."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.indexes.ivf import PROBES, Cells
from lodestar.operators.nearest import nearest_vectors

# The fraction of rows that a condition is taken to keep.
SELECTIVITY = {"=": 0.10, "!=": 0.90, "range": 0.25, "spatial": 0.05, "text": 0.05}


def selectivity(kinds: Sequence[str], rows: int, unique: int = 0) -> float:
    """Product over the conditions; ``unique`` of them are equalities on a key. Never under one row."""
    out = math.prod([SELECTIVITY[k] for k in kinds]) * (1 / max(rows, 1)) ** unique
    return max(out, 1 / max(rows, 1))


@dataclass
class Plan:
    strategy: str  # "pre" or "post"
    reason: str
    rows_read: dict[str, float]  # estimates of both


def choose(index: Cells, rows: int, k: int, kinds: Sequence[str], probes: int = PROBES, strategy: str = "auto", keep: float | None = None) -> Plan:
    """Pre-filter reads all rows once; post-filter reads the probed cells but may find fewer than k.

    keep: the share of rows that pass, where it is known; the fixed values of ``kinds`` otherwise.
    """
    if strategy not in ("auto", "pre", "post"):
        raise ValueError("the strategy is auto, pre or post")
    keep = selectivity(kinds, rows) if keep is None else keep
    scanned = rows * min(1.0, probes / max(len(index.centres), 1))
    cost = {"pre": float(rows), "post": scanned}
    if strategy != "auto":
        return Plan(strategy, "asked for", cost)
    if not kinds:
        return Plan("post", "no condition: the index alone", cost)
    if scanned * keep < k:
        return Plan("pre", f"about {scanned * keep:.1f} of the probed rows pass, fewer than {k}", cost)
    return Plan("post", f"about {scanned * keep:.0f} of the probed rows pass", cost)


def hybrid_nearest(df: DataFrame, index: Cells, query: Sequence[float], k: int, id_col: str, where: Column | None = None, kinds: Sequence[str] = (), probes: int = PROBES, strategy: str = "auto", rows: int | None = None) -> tuple[DataFrame, Plan]:
    """The k nearest rows under a condition, and the plan that was chosen.

    "auto" counts the rows that pass and ranks them all exactly if the post-filter would find, or finds, fewer than k.
    The post-filter answer is approximate: asked for, it may hold fewer than k rows although more exist (see ``warning``).
    """
    keep = None
    if strategy == "auto" and where is not None:
        rows, passing = df.agg(F.count(F.lit(1)), F.count_if(where)).first()
        keep = passing / max(rows, 1)
        kinds = kinds or ["range"]
    plan = choose(index, df.count() if rows is None else rows, k, kinds, probes, strategy, keep)
    if plan.strategy == "post":
        out = index.search(query, k, id_col, probes, where)
        found = out.count() if strategy == "auto" and k is not None else k
        if found == k or (where is None and probes >= len(index.centres)):
            return out, plan
        plan = Plan("pre", f"only {found} of the probed rows pass, fewer than {k}", plan.rows_read)
    return nearest_vectors(df, index.vector_col, query, k, id_col, index.metric, where), plan


def warning(found: int, k: int, plan: Plan) -> str | None:
    return f"only {found} of {k} rows: filtered after the ranking of the probed cells; try more probes or 'pre'" if plan.strategy == "post" and found < k else None


def with_scores(df: DataFrame, scores: DataFrame, id_col: str) -> DataFrame:
    """Rows with a score: those that no score names go."""
    return df.join(scores, id_col)


def explain(df: DataFrame) -> DataFrame:
    """The physical plan as rows (line, text), without running it."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return df.sparkSession.createDataFrame(list(enumerate(text.splitlines())), "line int, text string").orderBy(F.col("line"))
