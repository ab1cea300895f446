"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target number of rows over its number of documents. Each document's count is the inverse of the
Poisson distribution of that mean at a uniform number hashed from the seed and the document's id; documents are exploded by their
counts and the copies ordered by a hash over all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.ranges import partitions_of
from sitemetrics.operators.reuse import written

#: Up to here exp(-rate) doesn't vanish and a source's distribution is kept as an array; above, terms begin near the mean, in log space.
NEAR_RATE = 500.0
#: Sources whose rates may be sent to all tasks; more are joined by a shuffle.
BROADCAST_SOURCES = 1000
#: Copies of a row that are made at once. If a source's rate is above, blocks of so many are dealt over all tasks first.
BLOCK = 10000


def _terms(rate: str) -> str:
    """The distribution function of k = 0, 1, ... up to where the rest is below 1e-16."""
    last = f"CAST(ceil({rate} + 12 * sqrt({rate}) + 30) AS INT)"
    step = f"struct(s.p * {rate} / k AS p, s.c + s.p * {rate} / k AS c, array_append(s.all, s.c + s.p * {rate} / k) AS all)"
    return f"aggregate(sequence(1, {last}), struct(exp(-{rate}) AS p, exp(-{rate}) AS c, array(exp(-{rate})) AS all), (s, k) -> {step}, s -> s.all)"


def _far_count(rate: str, u: str) -> str:
    """How many k have a distribution function up to `u`, for rates above NEAR_RATE. Terms below `first` are less than 1e-16 together.

    The first term's logarithm is by Stirling's series, whose next part is below 1e-14 here, and holds no difference of large numbers.
    """
    first, last = f"CAST(floor({rate} - 12 * sqrt({rate}) - 30) AS BIGINT)", f"CAST(ceil({rate} + 12 * sqrt({rate}) + 30) AS BIGINT)"
    begin = f"exp({first} - {rate} - {first} * log1p(({first} - {rate}) / {rate}) - 0.5 * ln(2 * pi() * {first}) - 1 / (12D * {first}) + 1 / (360D * pow({first}, 3)))"
    step = f"struct(s.p * {rate} / k AS p, s.c + s.p * {rate} / k AS c, s.n + IF(s.c + s.p * {rate} / k <= {u}, 1, 0) AS n)"
    return f"aggregate(sequence({first} + 1, {last}), struct({begin} AS p, {begin} AS c, {first} + IF({begin} <= {u}, 1, 0) AS n), (s, k) -> {step}, s -> s.n)"


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, source_col: str = "source") -> DataFrame:
    """(source, n, rate): documents and mean repetitions of each source, for `rows` copies in all (default: as many as documents).

    `weights` are relative; a source not named has 0. None gives every source the same weight. A null source is one source, named by
    None. Raises ValueError for a negative weight.
    """
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    elif any(w < 0 for w in weights.values()):
        raise ValueError("a weight is negative")
    else:
        weight = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in weights.items()], F.lit(0.0))
    counts = written(counts.withColumn("weight", weight), "sources")
    total = counts.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    copies = total["n"] if rows is None else rows
    if not total["w"]:
        return counts.select("source", "n", F.lit(0.0).alias("rate"))
    return counts.select("source", "n", (F.col("weight") / F.lit(float(total["w"])) * F.lit(float(copies)) / F.col("n")).alias("rate"))


def _unused(names: list[str], taken: list[str]) -> list[str]:
    """The names, with as many underscores as it takes to differ from those taken."""
    lower = {t.lower() for t in taken}
    return [next(n + "_" * k for k in range(len(lower) + 1) if n + "_" * k not in lower) for n in names]


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, rows: int | None = None, seed: int = 7, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """`docs` with each row repeated by its count, in a global hash order; adds `mix_rate`, `mix_copy` (1, 2, ...) and `mix_key` (the order).

    Columns of `docs` keep their names, whatever they are called; one that is called like an added column is replaced. Rows of one id have the same count, and a
    null id counts as the empty text. Texts aren't read, so null and empty ones are rows like others. An empty table gives none.
    The copies are ordered by mix_key within each partition, and partitions take ascending ranges of it.
    """
    rates = source_rates(docs, weights, rows, source_col)
    kept = docs.drop("mix_rate", "mix_copy", "mix_key")
    origin, terms, uniform, copies, block = _unused(["mix_source", "mix_terms", "mix_u", "mix_n", "mix_block"], kept.columns)
    size = rates.agg(F.count("*").alias("sources"), F.max("rate").alias("rate")).first()
    rates = rates.select(F.col("source").alias(origin), F.col("rate").alias("mix_rate"), F.when(F.col("rate") <= NEAR_RATE, F.expr(_terms("rate"))).alias(terms))
    rates = F.broadcast(rates) if size["sources"] <= BROADCAST_SOURCES else rates
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(kept[id_col].cast("string"), F.lit("")))
    hashed = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    joined = kept.join(rates, kept[source_col].cast("string").eqNullSafe(F.col(origin))).withColumn(uniform, hashed)
    near, far = F.size(F.filter(terms, lambda c: c <= F.col(uniform))).cast("long"), F.expr(_far_count("mix_rate", uniform))
    counted = joined.withColumn(copies, F.when(F.col("mix_rate") <= NEAR_RATE, near).otherwise(far)).where(F.col(copies) > 0).drop(terms, uniform, origin)
    n = partitions_of(docs)
    blocks = counted.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / BLOCK))))
    blocks = blocks.repartition(n) if (size["rate"] or 0) > BLOCK else blocks
    of_block = F.sequence(F.col(block) * BLOCK + 1, F.least(F.col(copies), (F.col(block) + 1) * BLOCK))
    copied = blocks.withColumn("mix_copy", F.explode(of_block)).drop(copies, block)
    key = F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("mix_copy").cast("string")).cast("binary")), 1, 12)
    place = F.conv(F.substring("mix_key", 1, 6), 16, 10).cast("long")  # uniform, so equal ranges need no sample
    return copied.withColumn("mix_key", key).repartitionById(n, F.floor(place * n / (1 << 24)).cast("int")).sortWithinPartitions("mix_key")
