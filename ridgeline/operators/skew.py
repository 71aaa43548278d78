"""Per-key results where a few keys hold most rows.

Rows are range partitioned on the composite (key, secondary order) with quantiles that Spark samples, so a heavy key
spreads over as many partitions as its share needs. Each partition reduces its rows to one partial state per key, and
the states of a key that crosses partition bounds are stitched by a second, tiny aggregation.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.plans.lineage import cut_lineage
from ridgeline.plans.names import fresh


def range_stitched_totals(df: DataFrame, key: str, order: str, value: str, partitions: int | None = None) -> DataFrame:
    """Rows (key, total, entries): the sum of ``value`` per ``key``, each ``order`` value counted once.

    Parameters: ``key`` the skewed grouping column; ``order`` identifies an entry and is the secondary order by which a
    heavy key is split; ``partitions`` overrides the number of ranges.

    Defined cases: a null key is left out; a null, zero or negative value adds nothing but its entry still counts; entries
    delivered again (same key and order) count once, with the largest value; a null order is one entry of its key; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    rows = df.select(
        F.col(key).alias("key"), F.col(order).alias("order"), F.greatest(F.coalesce(F.col(value), F.lit(0)), F.lit(0)).cast("long").alias("value")
    ).where(F.col("key").isNotNull())
    by = [F.col("key"), F.col("order")]
    ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    # The range partitioning already clusters (key, order): this aggregation needs no exchange.
    once = ranged.groupBy("key", "order").agg(F.max("value").alias("value"))
    # Partial sums per partition and key, then the states of one key are stitched.
    return once.groupBy("key").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("entries")).select(F.col("key").alias(key), "total", "entries")


def heavy_keys(totals: DataFrame, key: str, share: float) -> DataFrame:
    """The ``key`` values of ``totals`` (key, total) that hold at least ``share`` of the sum of all totals, by exact arithmetic.

    Nothing comes out when the totals are all zero or there are none.
    """
    whole = totals.agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("whole"))
    exact = Fraction(str(share))  # 0.02 is a fiftieth, not the nearest binary number
    limit = whole.select(F.col("whole") * F.lit(exact.numerator)).scalar()
    return totals.where((F.col("total") > 0) & (F.col("total").cast("decimal(28,0)") * F.lit(exact.denominator) >= limit)).select(key)


def running_totals(df: DataFrame, key: str, order: str, value: str, out: str = "running_total") -> DataFrame:
    """``df`` with the running sum of ``value`` within each ``key`` in the order of ``order``, also for keys too heavy for one task.

    A plain window would send a whole key to one task. Here (key, order) ranges spread a heavy key, each partition sums its
    own part, and the sums of the earlier partitions of the same key are added as an offset: one row per partition and key.

    Defined cases: null values add nothing; rows with a null key form one key; equal (key, order) rows all come out and
    share the total that includes all of them; an empty table gives no rows. ``out`` must not be a column of ``df``.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column exists: {out}")
    part, here, before, own, k = fresh([*df.columns, out], "part", "here", "before", "own", "k")
    ranged = df.repartitionByRange(F.col(key).asc(), F.col(order).asc()).withColumn(part, F.spark_partition_id())
    # The partition id is fixed by writing the split once: range bounds are sampled, a second run could draw others.
    ranged = cut_lineage(ranged)
    v: Column = F.coalesce(F.col(value), F.lit(0))
    states = ranged.groupBy(part, key).agg(F.sum(v).alias(own))
    w = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = states.select(F.col(part), F.col(key).alias(k), F.coalesce(F.sum(own).over(w), F.lit(0)).alias(before))
    inside = Window.partitionBy(part, key).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn(here, F.sum(v).over(inside))
    joined = local.join(offsets.withColumnRenamed(part, "_" + part), (F.col(part) == F.col("_" + part)) & F.col(key).eqNullSafe(F.col(k)))
    return joined.select(*df.columns, (F.col(here) + F.col(before)).alias(out))
