"""References whose target is missing, gone or not there yet.

Composite references may have null parts. References are grouped by their null mask, and each mask is anti-joined on its
non-null columns under the declared match rule. A target may have lives (from, to); a reference then needs a life at its
own time. Keys that hold a large share of the references are salted, with their targets replicated per salt.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLED = 16  # one row in so many is counted to find heavy keys
MATCHES = ("simple", "full", "partial")


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _anti(refs: DataFrame, parents: DataFrame, cols: Sequence[int], timed: bool, hot_share: float, salts: int) -> DataFrame:
    """Rows of ``refs`` without an alive parent on the key parts ``cols``."""
    names = [f"k{i}" for i in cols]
    parents = parents.where(_all([F.col(f"p{i}").isNotNull() for i in cols])).select(*(f"p{i}" for i in cols), *(["p_from", "p_to"] if timed else [])).distinct()
    # At most 1 / hot_share keys can be that heavy, so this list is bounded whatever the data. One row in ``SAMPLED``, by a hash of the
    # reference, tells them well enough: a key that is missed, or held for hot, costs time only.
    seen = refs.where(F.pmod(F.xxhash64("r_id"), F.lit(SAMPLED)) == 0).groupBy(*names).count()
    total = seen.agg(F.sum("count")).first()[0] or 0
    hot = [tuple(r) for r in seen.where(F.col("count") > max(1000 / SAMPLED, hot_share * total)).orderBy(F.desc("count")).limit(int(1 / hot_share)).select(*names).collect()] if total else []
    equal = [F.col(f"k{i}") == F.col(f"p{i}") for i in cols]
    if hot:
        is_hot = lambda prefix: reduce(lambda a, b: a | b, [_all([F.col(f"{prefix}{i}") == F.lit(v) for i, v in zip(cols, h)]) for h in hot])
        refs = refs.withColumn("r_salt", F.when(is_hot("k"), F.pmod(F.xxhash64("r_id", "r_time"), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
        parents = parents.withColumn("p_salt", F.explode(F.when(is_hot("p"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        equal.append(F.col("r_salt") == F.col("p_salt"))
    if timed:
        equal.append((F.col("p_from") <= F.col("r_time")) & (F.col("p_to").isNull() | (F.col("r_time") < F.col("p_to"))))
    return refs.join(parents, _all(equal), "left_anti").select("r_id", "r_time")


def orphan_references(
    refs: DataFrame, ref_id: str, ref_keys: Sequence[str], parents: DataFrame, parent_keys: Sequence[str], *,
    match: str = "simple", ref_time: str | None = None, alive_from: str | None = None, alive_to: str | None = None, hot_share: float = 0.02, salts: int = 32,
) -> DataFrame:
    """Rows (ref_id, ref_time): each reference, once, that no parent row answers.

    ``match``: ``simple``, a reference with a null part is no case; ``full``, all parts null is no case, some null is an
    orphan; ``partial``, the non-null parts must equal those of some parent, all parts null is no case.
    ``ref_time``, ``alive_from`` (inclusive) and ``alive_to`` (exclusive, null: open) demand a parent that is alive at the
    time of the reference. ``hot_share``: keys with a larger share of the references are spread over ``salts`` tasks.

    Defined cases: a null time with ``ref_time`` given is no case; a parent with a null key part answers nothing on that
    part; a life without a beginning is never alive; repeated references come out once; empty parents make every case
    an orphan; empty references give no rows; keys compare exactly; further columns, of any name, are ignored.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if len(ref_keys) != len(parent_keys) or not ref_keys or len(ref_keys) > 6:
        raise ValueError("one to six key columns on each side are needed, as many on both")
    timed = ref_time is not None
    if timed != (alive_from is not None):
        raise ValueError("ref_time and alive_from belong together")
    n = len(ref_keys)
    r = refs.select(F.col(ref_id).alias("r_id"), (F.col(ref_time) if timed else F.lit(None).cast("timestamp")).alias("r_time"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(ref_keys)))
    p = parents.select(*(F.col(c).alias(f"p{i}") for i, c in enumerate(parent_keys)), *([F.col(alive_from).alias("p_from"), (F.col(alive_to) if alive_to else F.lit(None).cast("timestamp")).alias("p_to")] if timed else []))
    if timed:
        r = r.where(F.col("r_time").isNotNull())
    found = []
    for nulls in product((False, True), repeat=n):
        if all(nulls) or any(nulls) and match == "simple":
            continue
        masked = r.where(_all([F.col(f"k{i}").isNull() if x else F.col(f"k{i}").isNotNull() for i, x in enumerate(nulls)]))
        if any(nulls) and match == "full":
            found.append(masked.select("r_id", "r_time"))
        else:
            found.append(_anti(masked, p, [i for i, x in enumerate(nulls) if not x], timed, hot_share, salts))
    return reduce(DataFrame.unionAll, found).distinct()
