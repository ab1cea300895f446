"""Order-dependent operators that stay parallel when one group holds most of the rows.

A plain window sends a whole group to one task. Here rows are cut into runs of ``chunk``
consecutive order values; the window works inside a run and a small table of per-run carries
joins the runs together. Without group keys the carries of all rows would meet in one window, so
there they go up one more level, in runs of ``chunk`` runs: the topmost window holds a row for
every chunk * chunk order values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 50_000
_RUN, _OVER = "__run", "__over"


def _same(a: list[str]):
    return [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in a]


def _with_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on the group keys (NULL-safe) and the run number."""
    cond = F.col(f"l.{_RUN}") == F.col(f"r.{_RUN}")
    for c in _same(keys):
        cond = cond & c
    extra = [c for c in carry.columns if c not in (*keys, _RUN)]
    return df.alias("l").join(carry.alias("r"), cond, "left").select("l.*", *[f"r.{c}" for c in extra])


def _last_before(last_of: DataFrame, keys: list[str], cols: list[str], chunk: int) -> DataFrame:
    """(keys, run, last value of every column in earlier runs); ``last_of``: one row per run."""
    earlier = lambda *k: W.partitionBy(*k).orderBy(_RUN).rowsBetween(W.unboundedPreceding, -1)
    last = lambda c, w: F.last(f"__{c}", ignorenulls=True).over(w).alias(f"__{c}")
    if keys:
        return last_of.select(*keys, _RUN, *[last(c, earlier(*keys)) for c in cols])
    runs = last_of.withColumn(_OVER, F.floor(F.col(_RUN) / chunk))
    top = runs.groupBy(_OVER).agg(*[F.max_by(f"__{c}", F.when(F.col(f"__{c}").isNotNull(), F.col(_RUN))).alias(f"__{c}") for c in cols])
    above = W.orderBy(_OVER).rowsBetween(W.unboundedPreceding, -1)
    top = top.select(_OVER, *[F.last(f"__{c}", ignorenulls=True).over(above).alias(f"__up_{c}") for c in cols])
    inside = runs.select(_OVER, _RUN, *[last(c, earlier(_OVER)) for c in cols])
    return inside.join(top, _OVER).select(_RUN, *[F.coalesce(f"__{c}", f"__up_{c}").alias(f"__{c}") for c in cols])


def _sum_before(totals: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """(keys, run, sum of ``__t`` over earlier runs); ``totals``: one row per run."""
    before = lambda c, *k: F.coalesce(F.sum(c).over(W.partitionBy(*k).orderBy(_RUN).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if keys:
        return totals.select(*keys, _RUN, before("__t", *keys).alias("__before"))
    runs = totals.withColumn(_OVER, F.floor(F.col(_RUN) / chunk))
    above = F.coalesce(F.sum("__t").over(W.orderBy(_OVER).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = runs.groupBy(_OVER).agg(F.sum("__t").alias("__t")).select(_OVER, above.alias("__up"))
    inside = runs.select(_OVER, _RUN, before("__t", _OVER).alias("__in"))
    return inside.join(top, _OVER).select(_RUN, (F.col("__in") + F.col("__up")).alias("__before"))


def fill_down(df: DataFrame, keys: list[str], order: str, cols: list[str], chunk: int = CHUNK) -> DataFrame:
    """Replace NULLs in ``cols`` by the last earlier value in the group; ``order`` is an integer column."""
    runs = df.withColumn(_RUN, F.floor(F.col(order) / chunk))
    inner = W.partitionBy(*keys, _RUN).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    last_of = runs.groupBy(*keys, _RUN).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__{c}") for c in cols]
    )
    carry = _last_before(last_of, keys, cols, chunk)
    local = runs.withColumns({c: F.last(c, ignorenulls=True).over(inner) for c in cols})
    out = _with_carry(local, carry, keys)
    return out.select(
        *[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, chunk: int = CHUNK, inclusive: bool = True
) -> DataFrame:
    """Cumulative sum of ``value`` in the group, up to and including (or only before) each row."""
    runs = df.withColumn(_RUN, F.floor(F.col(order) / chunk)).withColumn("__f", value.cast("long"))
    inner = W.partitionBy(*keys, _RUN).orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    totals = runs.groupBy(*keys, _RUN).agg(F.sum("__f").alias("__t"))
    carry = _sum_before(totals, keys, chunk)
    local = runs.withColumn(out, F.coalesce(F.sum("__f").over(inner), F.lit(0)))
    joined = _with_carry(local, carry, keys)
    return joined.select(*df.columns, (F.col(out) + F.col("__before")).alias(out))


def running_count(df: DataFrame, keys: list[str], order: str, flag: Column, out: str, chunk: int = CHUNK) -> DataFrame:
    """Number of flagged rows up to and including each row: block ids for gaps and islands."""
    return running_sum(df, keys, order, F.coalesce(flag, F.lit(False)).cast("int"), out, chunk)


def keep_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row per key in ``order``; a per-task limit before the shuffle keeps hot keys small."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def top_per_group(df: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def duplicated_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once: counted map-side, then a semi join."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys)
    return df.join(hot, keys, "left_semi")


def as_of_dates(anchors: DataFrame, available: DataFrame, anchor: str = "anchor", out: str = "nearest") -> DataFrame:
    """Latest available date not after each anchor, by filling a calendar; equi-join, any number of anchors.

    ``anchors`` holds an ``anchor`` date column, ``available`` a ``date`` column.
    """
    days = available.select(F.col("date").cast("date").alias("date")).where("date is not null").distinct()
    seen = days.select("date", F.lit(None).cast("date").alias("a")).unionByName(
        anchors.select(F.lit(None).cast("date").alias("date"), F.col(anchor).alias("a"))
    )
    span = seen.agg(F.min("date").alias("lo"), F.max("a").alias("hi")).where("lo <= hi")
    cal = span.select(F.explode(F.sequence("lo", "hi")).alias("__day"))
    marked = cal.join(days, F.col("__day") == F.col("date"), "left").select(
        "__day", F.datediff("__day", F.lit("1900-01-01")).alias("__n"), F.col("date").alias(out)
    )
    filled = fill_down(marked, [], "__n", [out], chunk=366).select("__day", out)
    return anchors.join(filled, F.col(anchor) == F.col("__day"), "left").drop("__day")
