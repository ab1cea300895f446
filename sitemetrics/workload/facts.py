"""Canonical facts derived from the shared tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemetrics.operators.reuse import written


class Facts:
    """The folder of the tables with their facts written at first use. Queries that need a fact in several places derive it once from the order lines."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __str__(self) -> str:
        return self.folder

    @cached_property
    def rev(self) -> DataFrame:
        return written(rev(self.spark, self.folder), "rev")

    @cached_property
    def traffic_base(self) -> DataFrame:
        return written(traffic_base(self.spark, self.folder), "traffic")


def once(spark: SparkSession, sf_dir: str | Facts) -> Facts:
    """`sf_dir` for a query that uses facts more than once; every function here takes it in place of the folder."""
    return sf_dir if isinstance(sf_dir, Facts) else Facts(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders_with_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    site = (
        t("customer")
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("location"))
    )
    return (
        t("orders")
        .join(site, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey", F.col("o_orderdate").cast("date").alias("date"), "o_orderpriority", "segment", "location"
        )
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its fact keys and exact amounts."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    amount = F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(_orders_with_site(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "date", "segment", F.col("p_brand").alias("outlet"), "location",
            F.col("l_quantity").cast("decimal(12,2)").alias("pax"), amount.alias("revenue"), "l_orderkey", "l_linenumber",
        )
    )


def rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue fact, one row per (date, segment, outlet, location)."""
    if isinstance(sf_dir, Facts):
        return sf_dir.rev
    return (
        lines(spark, sf_dir)
        .groupBy("date", "location", "segment", "outlet")
        .agg(F.sum("pax").alias("pax"), F.sum("revenue").alias("revenue"))
    )


def traffic_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    if isinstance(sf_dir, Facts):
        return sf_dir.traffic_base
    return (
        _orders_with_site(spark, sf_dir)
        .groupBy("date", "location", F.col("o_orderpriority").alias("terminal"))
        .agg((F.count(F.lit(1)) * 100).cast("decimal(18,2)").alias("traffic"))
    )


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows, but only days 1-10 in every third month, whose total also exists as one monthly row."""
    base = traffic_base(spark, sf_dir)
    third = F.month("date") % 3 == 0
    daily = base.where(~third | (F.dayofmonth("date") <= 10)).select(
        "date", F.lit(None).cast("date").alias("period_end"), F.lit("daily").alias("granularity"),
        "location", "terminal", F.col("traffic").cast("decimal(28,2)").alias("traffic"),
    )
    monthly = (
        base.where(third)
        .groupBy(F.trunc("date", "MM").alias("date"), "location", "terminal")
        .agg(F.sum("traffic").cast("decimal(28,2)").alias("traffic"))
        .select("date", F.last_day("date").alias("period_end"), F.lit("monthly").alias("granularity"),
                "location", "terminal", "traffic")
    )
    return daily.unionByName(monthly)


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose exact revenue adds up to the targets: the written revenue fact, else the order lines."""
    return sf_dir.rev if isinstance(sf_dir, Facts) else lines(spark, sf_dir)


def target_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _amounts(spark, sf_dir)
        .groupBy("location", "outlet", (F.year("date") + 1).alias("year"), F.month("date").alias("month"))
        .agg((F.sum("revenue").cast("decimal(28,4)") * F.lit("1.1").cast("decimal(3,1)")).cast("decimal(24,5)").alias("aop"))
    )


def target_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _amounts(spark, sf_dir)
        .where(F.col("location").isin("ASIA", "EUROPE") & (F.dayofmonth("date") <= 20))
        .groupBy("location", "date")
        .agg((F.sum("revenue").cast("decimal(28,4)") * F.lit("1.05").cast("decimal(3,2)")).cast("decimal(24,6)").alias("aop"))
    )


def outlet_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("p_brand", 7, 10).cast("int") % 4
    pool = F.when(k == 0, "P0").when(k == 1, "P1").when(k == 2, "ALL")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("outlet"), pool.alias("pool")).distinct()


# Which terminals a pool serves; ALL overlaps the other two.
POOLS = {
    "P0": ["1-URGENT"],
    "P1": ["2-HIGH", "3-MEDIUM"],
    "ALL": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}


def pool_member(spark: SparkSession) -> DataFrame:
    rows = [(p, t) for p, ts in POOLS.items() for t in ts]
    return spark.createDataFrame(rows, "pool string, terminal string")


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    k = F.col("o_orderkey") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("Rs. "), price))
        .when(k == 1, F.concat(F.lit("("), price, F.lit(")")))
        .when(k == 2, F.concat(price, F.lit(" L")))
        .otherwise("-")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"), "o_totalprice")


CTES: dict[str, tuple[list[str], str]] = {
    "rev": ([], """
SELECT CAST(o.o_orderdate AS DATE) AS date, r.r_name AS location, cu.c_mktsegment AS segment, p.p_brand AS outlet,
       SUM(CAST(l.l_quantity AS DECIMAL(12,2))) AS pax,
       SUM(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer cu ON o.o_custkey = cu.c_custkey
JOIN nation n ON cu.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY 1, 2, 3, 4"""),
    "traffic_base": ([], """
SELECT CAST(o.o_orderdate AS DATE) AS date, r.r_name AS location, o.o_orderpriority AS terminal,
       CAST(COUNT(*) * 100 AS DECIMAL(18,2)) AS traffic
FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey JOIN nation n ON cu.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY 1, 2, 3"""),
    "traffic": (["traffic_base"], """
SELECT date, CAST(NULL AS DATE) AS period_end, 'daily' AS granularity, location, terminal, traffic
FROM traffic_base WHERE MONTH(date) % 3 <> 0 OR DAY(date) <= 10
UNION ALL
SELECT CAST(DATE_TRUNC('month', date) AS DATE), LAST_DAY(CAST(DATE_TRUNC('month', date) AS DATE)), 'monthly',
       location, terminal, SUM(traffic)
FROM traffic_base WHERE MONTH(date) % 3 = 0
GROUP BY CAST(DATE_TRUNC('month', date) AS DATE), location, terminal"""),
    "target_monthly": (["rev"], """
SELECT location, outlet, YEAR(date) + 1 AS year, MONTH(date) AS month,
       CAST(SUM(revenue) * CAST(1.1 AS DECIMAL(3,1)) AS DECIMAL(24,5)) AS aop
FROM rev GROUP BY location, outlet, YEAR(date) + 1, MONTH(date)"""),
    "target_daily": (["rev"], """
SELECT location, date, CAST(SUM(revenue) * CAST(1.05 AS DECIMAL(3,2)) AS DECIMAL(24,6)) AS aop
FROM rev WHERE location IN ('ASIA', 'EUROPE') AND DAY(date) <= 20 GROUP BY location, date"""),
    "outlet_pool": ([], """
SELECT DISTINCT p_brand AS outlet,
       CASE CAST(SUBSTRING(p_brand, 7) AS INT) % 4 WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' WHEN 2 THEN 'ALL' END AS pool
FROM part"""),
    "pool_member": ([], """
SELECT * FROM (VALUES ('P0', '1-URGENT'), ('P1', '2-HIGH'), ('P1', '3-MEDIUM'), ('ALL', '1-URGENT'), ('ALL', '2-HIGH'),
  ('ALL', '3-MEDIUM'), ('ALL', '4-NOT SPECIFIED'), ('ALL', '5-LOW')) AS t(pool, terminal)"""),
    "messy": ([], """
SELECT o_orderkey, o_totalprice,
       CASE o_orderkey % 4 WHEN 0 THEN CONCAT('Rs. ', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR))
            WHEN 1 THEN CONCAT('(', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), ')')
            WHEN 2 THEN CONCAT(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), ' L') ELSE '-' END AS raw
FROM orders"""),
}


def with_ctes(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named fact definitions and what they need, in dependency order."""
    order: list[str] = []

    def add(n: str) -> None:
        for dep in CTES[n][0]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in order]
    parts += [f"{n} AS ({q.strip()})" for n, q in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def pct_sql(c: str, p: str) -> str:
    """SQL twin of the fractional-change rule."""
    return (
        f"CASE WHEN {c} IS NULL OR {p} IS NULL THEN NULL WHEN {p} = 0 THEN "
        f"(CASE WHEN {c} > 0 THEN 10.0::DOUBLE WHEN {c} < 0 THEN -1.0::DOUBLE END) ELSE ({c} - {p}) / {p} END"
    )


def div_sql(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN NULL ELSE {n} / {d} END"


def trend_sql(p: str, metric: str) -> str:
    return (
        f"CASE WHEN {p} > 0.05::DOUBLE THEN '📈 {metric} Increase' WHEN {p} < -0.05::DOUBLE THEN '📉 {metric} Decline' "
        f"ELSE '➡️ Stable' END"
    )
