"""Sources, loads, data quality, ordered operators and schema inference over the shared tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitemetrics.functions import vocabulary as V
from sitemetrics.operators import ordered as O
from sitemetrics.operators.reuse import materialise, shared_folder, stage_path, written
from sitemetrics.plans import grids as G
from sitemetrics.plans import infer as INF
from sitemetrics.plans import quality as QL
from sitemetrics.plans.headers import header_matches
from sitemetrics.sources import files as FS
from sitemetrics.sources import store as ST
from sitemetrics.workload import facts as X
from sitemetrics.workload.comparison import CMP, CUR
from sitemetrics.workload.facts import with_ctes
from sitemetrics.workload.registry import query
from sitemetrics.workload.sheets import PLACES, REGIONS, YEARS, label_row, lay, month_id, stack, text

TODAY, FIRST = dt.date(2001, 8, 1), dt.date(1990, 1, 1)
DAY = "CAST(o_orderdate AS DATE)"


def orders(spark, sf) -> DataFrame:
    return X.table(spark, sf, "orders")


# --- sources ---------------------------------------------------------------------------------------------------


@query("s01_delimited_cells", f"""
SELECT 'c' || CAST(c AS VARCHAR) || '.csv' AS grid_id, CAST(n AS INT) AS row_idx, CAST(k AS INT) AS col_idx, v AS value FROM (
  SELECT c, n, UNNEST([0, 1, 2, 3]) AS k, UNNEST([CAST(o_orderkey AS VARCHAR), 'say "' || o_orderpriority || '", ok', CAST({DAY} AS VARCHAR), 'two' || chr(10) || 'lines']) AS v
  FROM (SELECT *, o_orderkey // 100 AS c, ROW_NUMBER() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) * 2 - 2 AS n FROM orders)
  UNION ALL SELECT c, n, 0, '' FROM (SELECT o_orderkey // 100 AS c, ROW_NUMBER() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey DESC) AS d,
    ROW_NUMBER() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) * 2 - 1 AS n FROM orders) WHERE d > 1)""")
def delimited_cells(spark, sf):
    """Orders written as quoted CSV texts of at most a hundred records with blank lines between, delimiter by file number."""
    c = F.floor(F.col("o_orderkey") / 100)
    d = F.when(c % 3 == 0, ",").when(c % 3 == 1, ";").otherwise("\t")
    quoted = F.concat(F.lit('"say ""'), "o_orderpriority", F.lit('"", ok"'))
    line = F.concat_ws("", text("o_orderkey"), d, quoted, d, F.col("o_orderdate").cast("date").cast("string"), d, F.lit('"two\nlines"'))
    files = orders(spark, sf).select(c.alias("c"), "o_orderkey", line.alias("line")).groupBy("c").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n\n").alias("text"))
    cells = FS.delimited_cells(files.select(F.concat(F.lit("c"), text("c"), F.lit(".csv")).alias("path"), "text"))
    return cells.select("grid_id", F.col("row_idx").cast("int").alias("row_idx"), F.col("col_idx").cast("int").alias("col_idx"), "value")


@query("s01_large_delimited", f"""
SELECT 'f' || CAST(f AS VARCHAR) AS grid_id, r AS row_idx, CAST(k AS INT) AS col_idx, v AS value FROM (
  SELECT f, r, UNNEST([0, 1, 2]) AS k, UNNEST([CAST(o_orderkey AS VARCHAR), CASE o_orderkey % 5 WHEN 0 THEN 'two' || chr(10) || chr(10) || 'gaps; "' || o_orderpriority || '"' ELSE o_orderpriority END, CAST({DAY} AS VARCHAR)]) AS v
  FROM (SELECT *, o_orderkey % 3 AS f, ROW_NUMBER() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) - 1 AS r FROM orders))""")
def large_delimited(spark, sf):
    """Orders as three text files, read in byte ranges of 64 kB: fields with line breaks lie across their borders."""
    f = F.col("o_orderkey") % 3
    field = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('"two\n\ngaps; ""'), "o_orderpriority", F.lit('"""'))).otherwise(F.col("o_orderpriority"))
    line = F.concat_ws(";", text("o_orderkey"), field, F.col("o_orderdate").cast("date").cast("string"))
    path = stage_path(spark, "delimited")
    rows = orders(spark, sf).select(f.alias("f"), "o_orderkey", line.alias("line")).repartition(3, "f").sortWithinPartitions("f", "o_orderkey")
    rows.select("f", F.col("line").alias("value")).write.partitionBy("f").text(path)
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in sizes:
            spark.conf.set(k, "64k")
        cells = written(FS.read_delimited(spark, path, "part-*"), "cells")
    finally:
        for k, v in sizes.items():
            spark.conf.set(k, v)
    return cells.select(F.concat(F.lit("f"), F.regexp_extract("source", "/f=([0-9]+)/", 1)).alias("grid_id"), F.col("row_idx").cast("bigint").alias("row_idx"), F.col("col_idx").cast("int").alias("col_idx"), "value")


@query("s02_json_pairs", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_pairs(spark, sf):
    return FS.json_pairs(X.table(spark, sf, "events"), "event_id", "props").where("key = 'k' and value is not null")


@query("s02_flatten_records", """
SELECT event_id, ts, event_type AS "who.kind", user_id AS "who.id", value AS "amount", '["' || event_type || '"]' AS tags FROM events""")
def flatten_records(spark, sf):
    e = X.table(spark, sf, "events")
    nested = e.groupBy(F.floor(F.col("event_id") / 100).alias("doc")).agg(F.collect_list(F.struct(
        "event_id", "ts", F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("id")).alias("who"), F.col("value").alias("amount"), F.array("event_type").alias("tags"))).alias("records"))
    return FS.json_records(nested.select("records"))


@query("s03_xml_cells", f"""
SELECT 'c' || CAST(f AS VARCHAR) AS path, CAST(n AS INT) AS row_idx, UNNEST(['key', 'note', 'day']) AS name, UNNEST([CAST(o_orderkey AS VARCHAR), o_orderpriority || ' & <co>', CAST({DAY} AS VARCHAR)]) AS value
FROM (SELECT *, o_orderkey // 100 AS f, ROW_NUMBER() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) - 1 AS n FROM orders)""")
def xml_cells(spark, sf):
    row = F.concat(F.lit('<order id="1"><key>'), text("o_orderkey"), F.lit("</key><note>"), "o_orderpriority", F.lit(" &amp; &lt;co&gt;</note><day>"), F.col("o_orderdate").cast("date").cast("string"), F.lit("</day></order>"))
    docs = orders(spark, sf).select(F.floor(F.col("o_orderkey") / 100).alias("f"), "o_orderkey", row.alias("row")).groupBy("f").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "row"))), lambda x: x["row"]), "\n").alias("body"))
    files = docs.select(F.concat(F.lit("c"), text("f")).alias("path"), F.concat(F.lit("<?xml version='1.0'?><orders>"), "body", F.lit("</orders>")).alias("text"))
    return FS.xml_cells(files).select("path", F.col("row_idx").cast("int").alias("row_idx"), "name", "value")


@query("s04_html_cells", r"""
SELECT page_id, CAST(t AS INT) AS table_idx, CAST(r AS INT) AS row_idx, CAST(0 AS INT) AS col_idx, TRIM(REGEXP_REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(
  REGEXP_REPLACE(li, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS value FROM (
  SELECT page_id, t, UNNEST(items) AS li, UNNEST(RANGE(LEN(items))) AS r FROM (
    SELECT page_id, t, REGEXP_EXTRACT_ALL(ul, '(?s)<li>(.*?)</li>', 1) AS items FROM (
      SELECT page_id, UNNEST(uls) AS ul, UNNEST(RANGE(LEN(uls))) AS t FROM (SELECT page_id, REGEXP_EXTRACT_ALL(html, '(?s)<ul>(.*?)</ul>', 1) AS uls FROM pages))))""")
def html_cells(spark, sf):
    """The lists of every whole page rewritten as one-column tables."""
    html = F.col("html")
    for a, b in (("<ul>", "<TABLE class='x'>"), ("</ul>", "</table>"), ("<li>", "<tr><td>"), ("</li>", "</td></tr>")):
        html = F.replace(html, F.lit(a), F.lit(b))
    pages = X.table(spark, sf, "pages").select("page_id", html.alias("html"))
    i = lambda c: F.col(c).cast("int").alias(c)
    return FS.html_cells(pages, "page_id").select("page_id", i("table_idx"), i("row_idx"), i("col_idx"), "value")


@query("s03_xml_groups", f"""
SELECT 'f' || CAST(f AS VARCHAR) AS file, CASE WHEN f % 2 = 0 THEN 'order' ELSE 'entry' END AS tag, CAST(n AS BIGINT) AS row_idx,
  UNNEST(['_id', 'note', 'part._kind', 'part.part']) AS name, UNNEST([CAST(o_orderkey AS VARCHAR), o_orderpriority || ' & <co>', o_orderstatus, CAST({DAY} AS VARCHAR)]) AS value
FROM (SELECT *, o_orderkey % 8 AS f, ROW_NUMBER() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) - 1 AS n FROM orders)""")
def xml_groups(spark, sf):
    """Orders as XML files of two row elements, with attributes, an element below one of its own name, and a head that isn't a row."""
    f = F.col("o_orderkey") % 8
    plain = f % 2 == 0
    body = F.concat(F.lit('<note>'), "o_orderpriority", F.lit(' &amp; &lt;co&gt;</note><part kind="'), "o_orderstatus", F.lit('"><part>'), F.col("o_orderdate").cast("date").cast("string"), F.lit("</part></part>"))
    pre = F.when(plain, "order").otherwise("n:entry")
    line = F.concat(F.lit("<"), pre, F.lit(' id="'), text("o_orderkey"), F.lit('">'), body, F.lit("</"), pre, F.lit(">"))
    rows = orders(spark, sf).select(f.alias("f"), plain.alias("plain"), F.lit(1).alias("part"), F.col("o_orderkey").alias("k"), line.alias("value"))
    ends = rows.select("f", "plain").distinct()
    root = F.when(F.col("plain"), "orders").otherwise("n:sheet")
    head = F.concat(F.lit("<?xml version='1.0'?><"), root, F.lit(" xmlns:n='u'><!-- <order> --><head><title>t</title></head>"))
    head = ends.select("f", "plain", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), head.alias("value"))
    tail = ends.select("f", "plain", F.lit(2).alias("part"), F.lit(0).cast("long").alias("k"), F.concat(F.lit("</"), root, F.lit(">")).alias("value"))
    path = stage_path(spark, "xml")
    lines = rows.unionByName(head).unionByName(tail).repartitionById(8, F.col("f").cast("int")).sortWithinPartitions("f", "part", "k")  # a file for each task
    lines.select("f", "value").write.partitionBy("f").text(path)
    cells = FS.read_xml_groups(spark, path, "part-*")
    return cells.select(F.concat(F.lit("f"), F.regexp_extract("path", "/f=([0-9]+)/", 1)).alias("file"), "tag", "row_idx", "name", "value")


@query("s05_corpus_manifest", """
SELECT source || '/' || CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.CSV' WHEN 2 THEN '.pdf' ELSE '' END AS path,
  CAST(OCTET_LENGTH(ENCODE(text)) + CASE doc_id % 4 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 0 END AS BIGINT) AS size, CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'csv' WHEN 2 THEN 'pdf' ELSE '' END AS extension,
  CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'csv' WHEN 2 THEN 'pdf' ELSE 'xml' END AS format, CASE WHEN doc_id % 4 <> 2 THEN 'utf-8' END AS encoding FROM documents""")
def corpus_manifest(spark, sf):
    k = F.col("doc_id") % 4
    path = F.concat("source", F.lit("/"), text("doc_id"), F.when(k == 0, ".txt").when(k == 1, ".CSV").when(k == 2, ".pdf").otherwise(""))
    body = F.concat(F.when(k == 2, "%PDF").when(k == 3, "<?xml").otherwise(""), "text").cast("binary")
    return FS.manifest(X.table(spark, sf, "documents").select(path.alias("path"), body.alias("content"))).drop("delimiter")


@query("s07_merge_pages", """
SELECT source, width, CAST(n - 1 AS INT) AS row_idx, value FROM (
  SELECT 'c' || CAST(o_custkey % 20 AS VARCHAR) AS source, CAST(o_orderkey % 3 + 1 AS INT) AS width, CAST(o_orderkey AS VARCHAR) AS value,
    ROW_NUMBER() OVER (PARTITION BY o_custkey % 20, o_orderkey % 3 ORDER BY o_orderkey) AS n FROM orders)""")
def merge_pages(spark, sf):
    """Every order is a one-row table part of width 1 to 3 on its own page."""
    o = orders(spark, sf).select(F.concat(F.lit("c"), text(F.col("o_custkey") % 20)).alias("source"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 3 + 1).alias("w"))
    cells = o.select("source", "page", F.lit(0).alias("row_idx"), F.explode(F.sequence(F.lit(0), F.col("w").cast("int") - 1)).alias("col_idx"), text("page").alias("value"))
    merged = G.merge_same_width(cells)
    return merged.where("col_idx = 0").select("source", (100000 - F.substring("grid_id", -5, 5).cast("int")).alias("width"), "row_idx", "value")


@query("s08_full_scan", with_ctes(["rev"], "SELECT date, segment, outlet, location, CAST(revenue AS DOUBLE) AS revenue FROM rev"))
def full_scan(spark, sf):
    return X.rev(spark, sf).select("date", "segment", "outlet", "location", F.col("revenue").cast("double").alias("revenue"))


@query("s11_range_scan", with_ctes(["rev"], "SELECT date, segment, outlet, location FROM rev WHERE date BETWEEN DATE '1996-01-15' AND DATE '2001-02-10'"))
def range_scan(spark, sf):
    return ST.for_range(X.rev(spark, sf), dt.date(2001, 2, 10), dt.date(1996, 1, 15)).select("date", "segment", "outlet", "location")


@query("s09_s10_date_scans", with_ctes(["rev"], """
SELECT 'one' AS scan, COUNT(*) AS rows FROM rev WHERE date = DATE '1998-06-01' UNION ALL
SELECT 'list', COUNT(*) FROM rev WHERE date IN (DATE '1998-06-01', DATE '1999-02-03', DATE '1890-01-01') UNION ALL SELECT 'none', 0"""))
def date_scans(spark, sf):
    rev = X.rev(spark, sf)
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("scan"), "rows")
    days = [dt.date(1998, 6, 1), dt.date(1999, 2, 3), dt.date(1890, 1, 1)]
    return n(ST.for_date(rev, days[0]), "one").unionByName(n(ST.for_dates(rev, days), "list")).unionByName(n(ST.for_dates(rev, []), "none"))


# --- loads and quality -----------------------------------------------------------------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


def line_order(desc: bool = False):
    return [F.desc(c) if desc else F.asc(c) for c in LINE_ORDER.split(", ")]


@query("w02_dedupe_keep_last", f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in LINE_ORDER.split(', '))}) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_keep_last(spark, sf):
    return O.keep_one(X.table(spark, sf, "lineitem"), LINE_KEY, *line_order(desc=True))


@query("v02_duplicate_log", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1) USING (l_orderkey, l_linenumber)")
def duplicate_log(spark, sf):
    return QL.duplicate_log(X.table(spark, sf, "lineitem"), LINE_KEY).select(*LINE_KEY, "l_partkey", "l_extendedprice")


_STORED = f"SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) AS rn FROM lineitem WHERE l_returnflag = 'A') WHERE rn = 1"
_ADDED = (f"SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) AS rn FROM lineitem WHERE l_returnflag <> 'A') n WHERE rn = 1 "
          "AND NOT EXISTS (SELECT 1 FROM st s WHERE s.l_orderkey = n.l_orderkey AND s.l_linenumber = n.l_linenumber)")


def _two_batches(spark, sf):
    li = X.table(spark, sf, "lineitem")
    stored = O.keep_one(li.where("l_returnflag = 'A'"), LINE_KEY, *line_order())
    incoming = li.where("l_returnflag <> 'A'")
    return incoming, stored, ST.new_rows(stored, incoming, LINE_KEY, *line_order())


@query("s14_load_first_wins", with_ctes([], "SELECT * FROM st UNION ALL SELECT * FROM ad", {"st": _STORED, "ad": _ADDED}))
def first_wins(spark, sf):
    _, stored, added = _two_batches(spark, sf)
    return stored.unionByName(added)


@query("s14_load_counts", with_ctes([], """SELECT CAST((SELECT COUNT(*) FROM ad) AS BIGINT) AS inserted,
CAST((SELECT COUNT(*) FROM lineitem WHERE l_returnflag <> 'A') - (SELECT COUNT(*) FROM ad) AS BIGINT) AS skipped, (SELECT COUNT(*) FROM lineitem WHERE l_returnflag <> 'A') AS total_rows""", {"st": _STORED, "ad": _ADDED}))
def load_counts(spark, sf):
    incoming, _, added = _two_batches(spark, sf)
    return ST.load_counts(incoming, added)


@query("s15_s16_clean_batches", with_ctes(["traffic"], """
SELECT date, period_end, granularity, location, CASE WHEN terminal = '5-LOW' THEN '' ELSE terminal END AS terminal, CAST(traffic AS DOUBLE) AS traffic FROM traffic WHERE terminal <> '2-HIGH'"""))
def clean_batches(spark, sf):
    t = X.traffic(spark, sf)
    raw = t.select(
        F.col("date").cast("string").alias("date"), "period_end", F.when(F.col("granularity") == "daily", F.lit(None)).otherwise(" Monthly ").alias("granularity"),
        F.concat(F.lit(" "), "location").alias("location"), F.when(F.col("terminal") == "5-LOW", "NaN").otherwise(F.col("terminal")).alias("terminal"),
        F.when(F.col("terminal") == "2-HIGH", "n/a").otherwise(text("traffic")).alias("traffic"))
    return ST.clean_traffic(raw)


@query("s17_load_audit", with_ctes([], """
SELECT 'batch.csv' AS file_name, MIN(CAST(l_shipdate AS DATE)) AS report_date, COUNT(*) AS row_count, CAST(SUM(CAST(l_extendedprice AS DECIMAL(30,8))) AS DOUBLE) AS primary_total,
  CAST(SUM(CAST(l_quantity AS DECIMAL(30,8))) AS DOUBLE) AS total_pax, TIMESTAMP '2024-01-01 00:00:00' AS uploaded_at, 'Available' AS status, 'Revenue' AS load_type FROM ad""", {"st": _STORED, "ad": _ADDED}))
def load_audit(spark, sf):
    _, _, added = _two_batches(spark, sf)
    rows = added.select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("revenue"), F.col("l_quantity").alias("pax"))
    return ST.audit_row(rows, ST.REVENUE, "batch.csv", dt.datetime(2024, 1, 1))


@query("s18_rows_to_retag", with_ctes(["rev"], "SELECT DISTINCT segment AS old_segment, outlet FROM rev WHERE segment IN ('BUILDING', 'FURNITURE')"))
def rows_to_retag(spark, sf):
    from sitemetrics.operators import dims

    rules = spark.createDataFrame([("BUILDING", None, "Core", "Building"), ("FURNITURE", None, "Core", "Furniture")], "raw_segment string, outlet_key string, segment string, business_unit string")
    r = X.rev(spark, sf).select("segment", "outlet").distinct().withColumns({"business_unit": F.lit(None).cast("string"), "old_segment": F.col("segment")})
    fixed = dims.canonical_segment(r, rules)
    return fixed.where("segment <> old_segment").select("old_segment", "outlet")


@query("s18_retag", with_ctes(["rev"], """
SELECT date, CASE WHEN segment IN ('BUILDING', 'FURNITURE') THEN 'Core' ELSE segment END AS segment, outlet, location, CAST(revenue AS DOUBLE) AS revenue,
  CASE WHEN segment = 'BUILDING' THEN 'Custom' WHEN segment = 'FURNITURE' THEN 'Furniture' ELSE segment END AS business_unit
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY date, CASE WHEN segment IN ('BUILDING', 'FURNITURE') THEN 'Core' ELSE segment END, outlet, location ORDER BY segment) AS n FROM rev) WHERE n = 1"""))
def retag(spark, sf):
    """All stored rows after a rule change; two old segments become one, and of rows that then share a key the first delivered stays."""
    rules = spark.createDataFrame([("BUILDING", None, "Core", "Building"), ("FURNITURE", None, "Core", "Furniture")], "raw_segment string, outlet_key string, segment string, business_unit string")
    unit = F.when(F.col("segment") == "BUILDING", "Custom").when(F.col("segment") != "FURNITURE", F.col("segment"))
    stored = X.rev(spark, sf).select(
        "date", "segment", unit.alias("business_unit"), "outlet", "location", F.col("revenue").cast("double").alias("revenue"), F.col("segment").alias("source_file"),
        F.lit(dt.datetime(2024, 1, 1)).alias("uploaded_at"))
    return ST.retagged(stored, rules).drop("source_file", "uploaded_at")


@query("s14_load_repeated", with_ctes(["traffic"], """
SELECT date, location, terminal, granularity, CAST(traffic AS DOUBLE) AS traffic, CASE WHEN terminal <= '3' THEN 'first' ELSE 'third' END AS source_file FROM traffic"""))
def load_repeated(spark, sf):
    """A load, the same again, and one of all rows with other figures for the stored keys: the first delivery stays."""
    root = stage_path(spark, "store")
    t = X.traffic(spark, sf).withColumn("traffic", F.col("traffic").cast("double"))
    early = t.where("terminal <= '3'")
    later = t.withColumn("traffic", F.when(F.col("terminal") <= "3", F.col("traffic") + 1).otherwise(F.col("traffic")))
    for k, (name, batch) in enumerate((("first", early), ("second", early), ("third", later.unionByName(later.limit(1).withColumn("location", F.lit(None).cast("string")))))):
        ST.load(spark, root, ST.TRAFFIC, ST.clean_traffic(batch), name, dt.datetime(2024, 1, 1 + k))
    return ST.read_table(spark, root, ST.TRAFFIC).select("date", "location", "terminal", "granularity", "traffic", "source_file")


@query("s16_target_loads", with_ctes(["target_monthly"], "SELECT location, 'Main' AS segment, outlet, CAST(year AS INT) AS year, CAST(month AS INT) AS month, CAST(aop AS DOUBLE) AS aop FROM target_monthly"))
def target_loads(spark, sf):
    root = stage_path(spark, "store")
    batch = ST.clean_monthly(X.target_monthly(spark, sf), "Main")
    for k in range(2):
        ST.load(spark, root, ST.TARGET_MONTHLY, batch, f"budget {k}", dt.datetime(2024, 1, 1 + k))
    return ST.read_table(spark, root, ST.TARGET_MONTHLY).select("location", "segment", "outlet", "year", "month", "aop")


@query("s20_embedded_targets", with_ctes(["rev"], """
SELECT location, outlet, 'Main' AS segment, CAST(YEAR(date) AS INT) AS year, CAST(MONTH(date) AS INT) AS month, CAST(SUM(revenue) AS DOUBLE) AS aop FROM rev WHERE segment <> 'BUILDING' GROUP BY 1, 2, 4, 5"""))
def embedded_targets(spark, sf):
    rows = X.rev(spark, sf).withColumn("aop_daily", F.when(F.col("segment") != "BUILDING", F.col("revenue")))
    return ST.embedded_targets(rows, "Main")


@query("s22_best_candidate", """
SELECT source, grid_id, confidence, n_rows, others FROM (SELECT 'src' || CAST(o_custkey AS VARCHAR) AS source, CAST(o_orderkey AS VARCHAR) AS grid_id, o_totalprice AS confidence, o_orderkey % 7 AS n_rows,
  COUNT(*) OVER (PARTITION BY o_custkey) - 1 AS others, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey % 7 DESC, CAST(o_orderkey AS VARCHAR) DESC) AS rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn = 1""")
def best_candidate(spark, sf):
    g = orders(spark, sf).select(F.concat(F.lit("src"), text("o_custkey")).alias("source"), text("o_orderkey").alias("grid_id"), F.col("o_totalprice").alias("confidence"),
                                 (F.col("o_orderkey") % 7).alias("n_rows"), (F.col("o_orderstatus") != "P").alias("accepted"))
    return ST.best_candidate(g)


def dirty(spark, sf) -> DataFrame:
    """Revenue lines with planted defects."""
    k = F.col("o_orderkey")
    o = orders(spark, sf)
    return o.select(
        F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit("1980-01-01").cast("date")).otherwise(F.col("o_orderdate").cast("date")).alias("date"),
        F.col("o_orderpriority").alias("segment"), F.when(k % 17 == 0, "  ").otherwise(F.concat(F.lit("c"), text(F.col("o_custkey") % 20))).alias("outlet"),
        F.when(k % 19 == 0, "Nowhere").otherwise("ASIA").alias("location"), F.when(k % 23 == 0, -1.0).otherwise(2.0).alias("pax"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("revenue"), F.lit(None).cast("double").alias("aop"), F.lit(None).cast("double").alias("traffic"), "o_orderkey")


DIRTY = f"""SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN DATE '1980-01-01' ELSE {DAY} END AS date, o_orderpriority AS segment,
  CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE 'c' || CAST(o_custkey % 20 AS VARCHAR) END AS outlet, CASE WHEN o_orderkey % 19 = 0 THEN 'Nowhere' ELSE 'ASIA' END AS location,
  CASE WHEN o_orderkey % 23 = 0 THEN -1.0 ELSE 2.0 END AS pax, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS revenue, o_orderkey FROM orders"""
_CHECKS = [
    ("required_columns", "MAX(0)", "required columns missing"), ("dates", "SUM(CASE WHEN date IS NULL OR date < DATE '2015-01-01' THEN 1 ELSE 0 END)", "rows without a plausible date"),
    ("revenue", "SUM(CASE WHEN revenue IS NULL THEN 1 ELSE 0 END)", "rows without revenue"), ("pax", "SUM(CASE WHEN pax < 0 THEN 1 ELSE 0 END)", "rows with negative customers"),
    ("locations", "SUM(CASE WHEN location = 'ASIA' THEN 0 ELSE 1 END)", "rows with an unknown location"), ("segments", "SUM(CASE WHEN segment IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END)", "rows with an unknown segment"),
    ("outlets", "SUM(CASE WHEN TRIM(outlet) = '' THEN 1 ELSE 0 END)", "rows without an outlet"), ("duplicates", "SUM(CASE WHEN c > 1 THEN 1 ELSE 0 END)", "rows sharing a key"),
]
REPORT = " UNION ALL ".join(f"SELECT '{k}' AS \"check\", {e} = 0 AS passed, CAST({e} AS BIGINT) AS affected, CAST(CAST({e} AS BIGINT) AS VARCHAR) || ' {t}' AS message FROM dk" for k, e, t in _CHECKS)
DIRTY_CTES = {"di": DIRTY, "dk": "SELECT *, COUNT(*) OVER (PARTITION BY date, segment, outlet, location) AS c FROM di"}


def _report(spark, sf):
    return QL.validation_report(dirty(spark, sf), ["ASIA"], ["1-URGENT", "2-HIGH"], dt.date(2026, 1, 1))


@query("v01_validation_report", with_ctes([], REPORT, DIRTY_CTES))
def validation_report(spark, sf):
    return _report(spark, sf)


@query("v03_validation_summary", with_ctes([], """
SELECT BOOL_AND(passed) AS passed, AVG(CASE WHEN passed THEN 1 ELSE 0 END) AS pass_rate, CAST(COUNT(CASE WHEN NOT passed THEN 1 END) AS VARCHAR) || ' of ' || CAST(COUNT(*) AS VARCHAR) || ' checks failed: ' ||
  STRING_AGG(CASE WHEN NOT passed THEN "check" END, ', ' ORDER BY "check") AS summary FROM rep""", {**DIRTY_CTES, "rep": REPORT}))
def validation_summary(spark, sf):
    return QL.validation_summary(_report(spark, sf)).drop("failing")


@query("v04_reject_reasons", with_ctes([], """
SELECT CASE WHEN date IS NULL THEN 'no date' WHEN revenue IS NULL THEN 'no revenue' WHEN date < DATE '1990-01-01' THEN 'implausible date' ELSE 'accepted' END AS reason, COUNT(*) AS rows FROM di GROUP BY 1""", {"di": DIRTY}))
def reject_reasons(spark, sf):
    return QL.reject_counts(dirty(spark, sf), dt.date(2026, 1, 1), FIRST)


@query("p11_plausible_dates", with_ctes([], "SELECT o_orderkey FROM di WHERE date BETWEEN DATE '1990-01-01' AND DATE '2001-08-01' + 366", {"di": DIRTY}))
def plausible(spark, sf):
    return dirty(spark, sf).where(INF.plausible_date("date", TODAY, FIRST)).select("o_orderkey")


@query("p01_canonical_projection", with_ctes([], """
SELECT date, segment, outlet, location, pax, revenue FROM (SELECT date, segment, TRIM(outlet) AS outlet, CASE location WHEN 'ASIA' THEN 'Asia' ELSE location END AS location, pax, revenue,
  ROW_NUMBER() OVER (PARTITION BY date, segment, TRIM(outlet), location ORDER BY o_orderkey DESC) AS rn FROM (SELECT * REPLACE (CASE segment WHEN '1-URGENT' THEN '1-URGENT' WHEN '2-HIGH' THEN '2-High' WHEN '3-MEDIUM' THEN '3-Medium'
  WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' ELSE '5-Low' END AS segment, CAST(pax AS DOUBLE) AS pax) FROM di) WHERE date IS NOT NULL) WHERE rn = 1""", {"di": DIRTY}))
def canonical_projection(spark, sf):
    raw = dirty(spark, sf).select(F.col("date").alias(" Date "), F.col("segment").alias("SEGMENT"), "outlet", "location", text("pax").alias("Pax"), text("revenue").alias("Revenue"), "o_orderkey")
    return QL.canonical(raw, F.col("o_orderkey"), ["1-urgent"]).select("date", "segment", "outlet", "location", "pax", "revenue")


@query("p02_alias_projection", with_ctes(["rev"], "SELECT date, location, outlet, CAST(revenue AS DOUBLE) AS revenue FROM rev"))
def alias_projection(spark, sf):
    odd = X.rev(spark, sf).select(F.col("date").alias(" Report DATE"), F.col("location").alias("City"), F.col("outlet").alias("Outlet name (new)"), F.col("revenue").cast("double").alias("Total Revenue INR"))
    return FS.rename_by_alias(odd, {k: V.COLUMN_ALIASES[k] for k in ("date", "location", "outlet", "revenue")})


@query("p05_any_nonzero", with_ctes(["rev"], f"SELECT segment, outlet, location, a, b FROM (SELECT segment, outlet, location, CAST(COALESCE(SUM(CASE WHEN {CUR} AND pax > 150 THEN revenue END), 0) AS DOUBLE) AS a, "
       f"CAST(COALESCE(SUM(CASE WHEN {CMP} AND pax > 150 THEN revenue END), 0) AS DOUBLE) AS b FROM rev GROUP BY 1, 2, 3) WHERE a <> 0 OR b <> 0"))
def any_nonzero(spark, sf):
    from sitemetrics.plans.compare import any_nonzero as keep
    from sitemetrics.workload.comparison import HALVES

    s = X.rev(spark, sf).groupBy("segment", "outlet", "location").agg(*[
        F.coalesce(F.sum(F.when(HALVES.side(n) & (F.col("pax") > 150), F.col("revenue"))), F.lit(0)).cast("double").alias(c) for n, c in (("current", "a"), ("compare", "b"))])
    return keep(s, ["a", "b"])


@query("p07_multi_select", with_ctes(["rev"], "SELECT 'all' AS choice, COUNT(*) AS rows FROM rev UNION ALL SELECT 'two', COUNT(*) FROM rev WHERE location IN ('ASIA', 'EUROPE')"))
def multi_select(spark, sf):
    from sitemetrics.operators.select import selected

    rev = X.rev(spark, sf)
    n = lambda picks, name: selected(rev, "location", picks).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("choice"), "rows")
    return n([], "all").unionByName(n(["ASIA", "EUROPE"], "two"))


# --- ordered and reshaping operators ---------------------------------------------------------------------------


@query("w01_fill_down", """
SELECT o_orderkey, o_custkey % 5 AS g, LAST_VALUE(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS label FROM orders""")
def fill_down(spark, sf):
    o = orders(spark, sf).select("o_orderkey", (F.col("o_custkey") % 5).alias("g"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("label"))
    return O.fill_down(o, ["g"], "o_orderkey", ["label"])


@query("w04_w05_blocks", """
SELECT o_orderkey, CAST(SUM(CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM orders""")
def block_numbers(spark, sf):
    o = orders(spark, sf).select("o_orderkey")
    return O.running_count(o, [], "o_orderkey", F.col("o_orderkey") % 9 == 0, "block")


@query("w03_fill_across", """
SELECT l_orderkey AS grid_id, l_linenumber AS col_idx, LAST_VALUE(banner IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS banner FROM (
  SELECT l_orderkey, l_linenumber, MAX(CASE WHEN l_partkey % 3 = 0 THEN l_shipdate END)::DATE::VARCHAR AS banner FROM lineitem GROUP BY 1, 2)""")
def fill_across(spark, sf):
    h = X.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("grid_id"), F.col("l_linenumber").alias("col_idx")).agg(
        F.max(F.when(F.col("l_partkey") % 3 == 0, F.col("l_shipdate"))).cast("date").cast("string").alias("banner"))
    return G.fill_across(h, ["banner"])


@query("w07_first_in_order", "SELECT o_custkey, (LIST(o_orderpriority ORDER BY o_orderpriority, o_orderkey))[1] AS pick FROM orders GROUP BY 1")
def first_in_order(spark, sf):
    return orders(spark, sf).groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct("o_orderpriority", "o_orderkey")).alias("pick"))


@query("r01_union_by_key", with_ctes(["traffic"], """
SELECT date, location, terminal, CAST(traffic AS DOUBLE) AS traffic, src FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY date, location, terminal ORDER BY src DESC) AS rn FROM (
  SELECT date, location, terminal, traffic, 1 AS src FROM traffic WHERE granularity = 'daily' UNION ALL SELECT date, location, terminal, traffic, 2 FROM traffic WHERE granularity = 'monthly')) WHERE rn = 1"""))
def union_by_key(spark, sf):
    t = X.traffic(spark, sf)
    cols = ["date", "location", "terminal", F.col("traffic").cast("double").alias("traffic")]
    parts = t.where("granularity = 'daily'").select(*cols, F.lit(1).alias("src")).unionByName(t.where("granularity = 'monthly'").select(*cols, F.lit(2).alias("src")))
    return O.keep_one(parts, ["date", "location", "terminal"], F.desc("src"))


@query("r04_unpivot_wide", with_ctes(["rev"], "SELECT date, location, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM rev GROUP BY 1, 2"))
def unpivot_wide(spark, sf):
    wide = X.rev(spark, sf).groupBy("date").pivot("location", REGIONS).agg(F.sum("revenue"))
    return wide.unpivot(["date"], REGIONS, "location", "revenue").where("revenue is not null").withColumn("revenue", F.col("revenue").cast("double"))


@query("o05_dimension_order", with_ctes(["rev"], """
SELECT segment, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(CASE segment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 9 END AS INT) AS ord FROM rev GROUP BY segment"""))
def dimension_order(spark, sf):
    ord_ = spark.createDataFrame([("MACHINERY", 0), ("BUILDING", 1)], "segment string, ord int")
    s = X.rev(spark, sf).groupBy("segment").agg(F.sum("revenue").cast("double").alias("revenue"))
    return s.join(ord_, "segment", "left").fillna(9, ["ord"]).orderBy("ord", "segment")


@query("o07_history_order", """
SELECT o_orderpriority AS file_name, MIN(CAST(o_orderdate AS DATE)) AS report_date, COUNT(*) AS row_count, CAST(SUM(CAST(o_totalprice AS DECIMAL(30,8))) AS DOUBLE) AS primary_total,
  CAST(0 AS DOUBLE) AS total_pax, CAST(o_orderdate AS TIMESTAMP) AS uploaded_at, 'Available' AS status, 'Traffic' AS load_type FROM orders GROUP BY o_orderpriority, o_orderdate""")
def history_order(spark, sf):
    """History of all loads, derived from the stored rows: every priority and day is a delivered file."""
    stored = orders(spark, sf).select(
        F.col("o_orderpriority").alias("source_file"), F.col("o_orderdate").cast("timestamp").alias("uploaded_at"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("traffic"))
    return ST.newest_first(ST.derived_history(stored, ST.TRAFFIC))


# --- schema inference ------------------------------------------------------------------------------------------

VOCAB = V.Vocab(places=PLACES, segments={s.lower(): s for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}, outlet_keywords=[], years=YEARS)


def unknown_sheets(spark, sf) -> DataFrame:
    """Odd months: long sheets with unfamiliar headers, a units title and a total row; even months: days as columns."""
    sf = X.once(spark, sf)
    rev = sf.rev
    odd = rev.where(F.month("date") % 2 == 1).withColumn("grid_id", month_id("odd "))
    rows = odd.withColumn("row_idx", F.row_number().over(W.partitionBy("grid_id").orderBy("date", "segment", "outlet", "location")) + 2)
    g = rows.select("grid_id").distinct()
    title = label_row(g, 0, ["Daily figures"], "odd.csv")
    head = label_row(g, 2, ["Bill Date", "City", "Division", "Shop", "Visitors", "Net Sales"], "odd.csv")
    body = lay(rows, [(0, F.date_format("date", "dd/MM/yyyy")), (1, F.col("location")), (2, F.col("segment")), (3, F.col("outlet")), (4, text("pax")), (5, F.concat(F.lit("Rs. "), text("revenue")))], "odd.csv")
    total = lay(g.withColumn("row_idx", F.lit(10_000_000)), [(0, F.lit("Grand Total")), (4, F.lit("1")), (5, F.lit("1"))], "odd.csv")
    even = rev.where(F.month("date") % 2 == 0).withColumns({"grid_id": F.concat(F.lit("even "), F.col("location"), F.date_format("date", " yyyy-MM")), "sheet": F.col("location")})
    keys = even.select("grid_id", "sheet", "segment", "outlet").distinct().withColumn("row_idx", F.row_number().over(W.partitionBy("grid_id").orderBy("segment", "outlet")))
    eg = even.select("grid_id", "sheet").distinct().withColumn("row_idx", F.lit(0))
    col = F.dayofmonth("date") + 1
    names = lay(keys, [(0, F.col("segment")), (1, F.col("outlet"))], "even.xlsx", F.col("sheet"))
    heads = lay(eg, [(0, F.lit("Segment")), (1, F.lit("Outlet"))], "even.xlsx", F.col("sheet"))
    days = lay(even.select("grid_id", "sheet", "date").distinct().withColumn("row_idx", F.lit(0)), [(col, F.date_format("date", "dd-MM-yyyy"))], "even.xlsx", F.col("sheet"))
    values = lay(even.join(keys.drop("sheet"), ["grid_id", "segment", "outlet"]), [(col, text("revenue"))], "even.xlsx", F.col("sheet"))
    budget = X.target_monthly(spark, sf).select(F.concat(F.lit("budget "), text("year")).alias("grid_id")).distinct()
    plan = stack(label_row(budget, 0, ["Annual Operating Plan"], "plan.xlsx"), label_row(budget, 1, ["Outlet", "Location", "01-04-2000", "01-05-2000", "01-06-2000"], "plan.xlsx"),
                 label_row(budget, 2, ["A", "ASIA", "1", "2", "3"], "plan.xlsx"))
    return materialise(stack(title, head, body, total, names, heads, days, values, plan))


@query("m10_infer_rows", with_ctes(["rev"], """
SELECT date, segment, outlet, location, CASE WHEN MONTH(date) % 2 = 1 THEN CAST(pax AS DOUBLE) END AS pax, CAST(revenue AS DOUBLE) AS revenue FROM rev r
WHERE MONTH(date) % 2 = 1 OR (location, DATE_TRUNC('month', date)) IN (SELECT (location, DATE_TRUNC('month', date)) FROM rev GROUP BY location, DATE_TRUNC('month', date) HAVING COUNT(DISTINCT date) >= 3)"""))
def infer_rows(spark, sf):
    return INF.infer(unknown_sheets(spark, sf), VOCAB, TODAY, first=FIRST).rows.select("date", "segment", "outlet", "location", "pax", "revenue")


@query("m11_m12_grid_status", with_ctes(["rev", "target_monthly"], """
SELECT 'odd' AS kind, TRUE AS accepted, 'long' AS layout, CAST(NULL AS VARCHAR) AS reason, COUNT(DISTINCT DATE_TRUNC('month', date)) AS grids FROM rev WHERE MONTH(date) % 2 = 1
UNION ALL SELECT 'even', TRUE, 'date_wide', NULL, COUNT(*) FROM (SELECT location, DATE_TRUNC('month', date) FROM rev WHERE MONTH(date) % 2 = 0 GROUP BY 1, 2 HAVING COUNT(DISTINCT date) >= 3)
UNION ALL SELECT 'even', FALSE, 'long', 'not identified: date, revenue', COUNT(*) FROM (SELECT location, DATE_TRUNC('month', date) FROM rev WHERE MONTH(date) % 2 = 0 GROUP BY 1, 2 HAVING COUNT(DISTINCT date) < 3) HAVING COUNT(*) > 0
UNION ALL SELECT 'budget', FALSE, 'date_wide', 'budget workbook, load it as targets', COUNT(DISTINCT year) FROM target_monthly"""))
def grid_status(spark, sf):
    s = INF.infer(unknown_sheets(spark, sf), VOCAB, TODAY, first=FIRST).grids
    return s.groupBy(F.split("grid_id", " ")[0].alias("kind"), "accepted", "layout", "reason").agg(F.count(F.lit(1)).alias("grids"))


@query("m14_mapping_report", None)
def mapping_report(spark, sf):
    return INF.infer(unknown_sheets(spark, sf), VOCAB, TODAY, first=FIRST).mapping


@query("m01_m02_header_rows", with_ctes(["rev", "target_monthly"], """
SELECT 'odd' AS kind, CAST(2 AS INT) AS header_row, COUNT(DISTINCT DATE_TRUNC('month', date)) AS grids FROM rev WHERE MONTH(date) % 2 = 1
UNION ALL SELECT 'even', 0, COUNT(DISTINCT (location, DATE_TRUNC('month', date))) FROM rev WHERE MONTH(date) % 2 = 0 UNION ALL SELECT 'budget', 1, COUNT(DISTINCT year) FROM target_monthly"""))
def header_rows(spark, sf):
    h = G.find_headers(unknown_sheets(spark, sf), VOCAB)
    return h.groupBy(F.split("grid_id", " ")[0].alias("kind"), F.col("header_row").cast("int").alias("header_row")).agg(F.count(F.lit(1)).alias("grids"))


@query("m05_role_profile", """
SELECT 'text' AS kind, COUNT(*) AS n, 0.0::DOUBLE AS num, 0.0::DOUBLE AS date, 1.0::DOUBLE AS text FROM orders UNION ALL SELECT 'number', COUNT(*), 1.0, 0.0, 0.0 FROM orders UNION ALL SELECT 'date', COUNT(*), 0.0, 1.0, 0.0 FROM orders""")
def role_profile(spark, sf):
    kinds = F.create_map(F.lit(0), F.col("o_orderpriority"), F.lit(1), text("o_totalprice"), F.lit(2), F.date_format("o_orderdate", "dd-MMM-yyyy"))
    data = orders(spark, sf).select(F.lit("orders").alias("grid_id"), F.explode(kinds).alias("ord", "value"))
    p = INF.profiles(data.withColumn("value", F.when(F.col("ord") == 1, F.concat(F.lit("Rs. "), "value")).otherwise(F.col("value"))), VOCAB)
    return p.select(F.element_at(F.array(F.lit("text"), F.lit("number"), F.lit("date")), F.col("ord") + 1).alias("kind"), "n", "num", "date", "text")


@query("m07_role_assign", """
SELECT grid_id, role, ord FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY grid_id ORDER BY score DESC, ord) AS rn FROM (
    SELECT o_custkey AS grid_id, 'date' AS role, CAST(o_orderkey AS INT) AS ord, o_totalprice / 1000000 AS score FROM orders) WHERE score >= 0.3) WHERE rn = 1""")
def role_assign(spark, sf):
    scores = orders(spark, sf).select(
        F.col("o_custkey").alias("grid_id"), F.col("o_orderkey").cast("int").alias("ord"), F.lit("x").alias("label"), F.lit("date").alias("role"), F.lit(0).alias("role_no"),
        (F.col("o_totalprice") / 1000000).alias("score"), F.lit("content").alias("method"))
    return INF.assign_roles(scores).select("grid_id", "role", "ord")


@query("o08_rank_candidates", None)
def rank_candidates(spark, sf):
    return G.rank_candidates(unknown_sheets(spark, sf))


@query("m04_header_scores", """
SELECT DISTINCT o_orderpriority AS label, CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 * 0.8 ELSE 0.6 END AS score FROM orders""".replace("1.0 * 0.8", "0.8::DOUBLE").replace("ELSE 0.6", "ELSE 0.6::DOUBLE"))
def header_scores(spark, sf):
    o = orders(spark, sf).select(F.col("o_orderpriority").alias("label")).distinct()
    t = F.when(F.col("label") == "5-LOW", "report revenue").otherwise(F.concat(F.lit("netrevenue"), F.lit("x")))
    return o.select("label", G.synonym_scores(t, "revenue").alias("score"))


#: Header texts with letters left out or doubled and words changed in order, in SQL that Spark and DuckDB both read.
HEADERS = """
SELECT o_orderkey, CASE CAST(floor(o_orderkey / 12) AS BIGINT) % 5 WHEN 0 THEN h WHEN 1 THEN swapped
  WHEN 2 THEN concat(substring(h, 1, p), substring(h, p + 2, 100)) WHEN 3 THEN concat(substring(h, 1, p), substring(h, p, 100))
  ELSE concat(substring(swapped, 1, p), substring(swapped, p + 2, 100)) END AS label
FROM (SELECT *, concat(split_part(h, ' ', 2), ' ', split_part(h, ' ', 1)) AS swapped, CAST(1 + floor(o_orderkey / 60) % (length(h) - 2) AS INT) AS p FROM (
  SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN 'Invoice Date' WHEN 1 THEN 'Service Point' WHEN 2 THEN 'Net Sales' WHEN 3 THEN 'Guest Count'
    WHEN 4 THEN 'Business Vertical' WHEN 5 THEN 'Geographical Segment' WHEN 6 THEN 'Total Revenue' WHEN 7 THEN 'Budgeted Revenue' WHEN 8 THEN 'Passenger Traffic'
    WHEN 9 THEN 'Outlet Name' WHEN 10 THEN 'Growth Percent' ELSE 'S. No.' END AS h FROM orders) a) b"""
_BANK = ", ".join(f"('{r}', '{p.replace('-', ' ')}', {w}::DOUBLE)" for r, ps in V.HEADER_SYNONYMS.items() for p, w in ps)
_PLAIN = "' ' || regexp_replace({}, '[^a-z0-9]+', ' ', 'g') || ' '"
_SORTED = "array_to_string(list_sort(list_filter(string_split({}, ' '), lambda x: x <> '')), ' ')"


@query("m04_fuzzy_headers", f"""
WITH bank(role, p, w) AS (VALUES {_BANK}), labels AS (SELECT DISTINCT label, regexp_replace(regexp_replace(lower(label), ' +', ' ', 'g'), '\\.+$', '') AS t FROM ({HEADERS})),
x AS (SELECT label, role, w, t, p, {_SORTED.format('t')} AS s, {_SORTED.format('p')} AS q FROM labels, bank WHERE NOT regexp_matches(t, '^s\\.? ?no\\.?$|growth|percent')),
y AS (SELECT label, role, w, CASE WHEN t = p THEN w WHEN contains({_PLAIN.format('t')}, {_PLAIN.format('p')}) AND length(p) >= 3 THEN w * 0.82::DOUBLE
  WHEN contains(t, p) AND length(p) >= 4 THEN w * 0.65::DOUBLE END AS direct, 1 - levenshtein(s, q) / greatest(length(s), length(q)) AS ratio FROM x),
z AS (SELECT label, role, MAX(direct) AS direct, MAX(w * ratio * 0.9::DOUBLE) FILTER (ratio >= 0.82::DOUBLE) AS fuzzy FROM y GROUP BY 1, 2)
SELECT label, role, CASE WHEN COALESCE(direct, 0) < 0.6 AND COALESCE(fuzzy, 0) > COALESCE(direct, 0) THEN fuzzy ELSE direct END AS score,
  CASE WHEN COALESCE(direct, 0) < 0.6 AND COALESCE(fuzzy, 0) > COALESCE(direct, 0) THEN 'similar' ELSE 'synonym' END AS method FROM z WHERE direct IS NOT NULL OR fuzzy IS NOT NULL""")
def fuzzy_headers(spark, sf):
    labels = spark.sql(HEADERS.replace("FROM orders", "FROM {orders}"), orders=orders(spark, sf))
    return header_matches(labels, "label")


def across_sheets(spark, sf) -> DataFrame:
    """A sheet per place, segment and year: a title, a row of dates, customers and revenue below."""
    rev = X.rev(spark, sf).groupBy("date", "location", "segment").agg(F.sum("pax").alias("pax"), F.sum("revenue").alias("revenue"))
    rev = written(rev, "sums")
    rev = rev.withColumns({"grid_id": F.concat_ws(" ", F.lit("across"), "location", "segment", F.year("date").cast("string")), "sheet": F.col("location"), "column": F.dayofyear("date")})
    g = rev.select("grid_id", "sheet", "segment").distinct()
    row = lambda r, value: lay(g.withColumn("row_idx", F.lit(r)), [(0, value)], "across.xlsx", F.col("sheet"))
    body = [lay(rev.withColumn("row_idx", F.lit(r)), [(F.col("column"), v)], "across.xlsx", F.col("sheet")) for r, v in (
        (2, F.date_format("date", "dd/MM/yyyy")), (3, text("pax")), (4, text("revenue")))]
    return materialise(stack(row(0, F.concat(F.lit("Figures of "), "segment")), row(2, F.lit("Date")), row(3, F.lit("Visitors")), row(4, F.lit("Net sales")), *body))


_ACROSS = "SELECT location, segment, YEAR(date) AS y FROM rev GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT date) >= 3"


@query("r05_transposed_metrics", with_ctes(["rev"], """
SELECT date, segment, location || ' - ' || segment AS outlet, location, CAST(SUM(pax) AS DOUBLE) AS pax, CAST(SUM(revenue) AS DOUBLE) AS revenue
FROM rev JOIN a USING (location, segment) WHERE a.y = YEAR(date) GROUP BY 1, 2, 3, 4""", {"a": _ACROSS}))
def transposed_metrics(spark, sf):
    return INF.infer(across_sheets(spark, sf), VOCAB, TODAY, first=FIRST).rows.select("date", "segment", "outlet", "location", "pax", "revenue")


@query("m08_orientation", with_ctes(["rev"], "SELECT 'transposed' AS layout, TRUE AS accepted, COUNT(*) AS grids FROM a", {"a": _ACROSS}))
def orientation(spark, sf):
    return INF.infer(across_sheets(spark, sf), VOCAB, TODAY, first=FIRST).grids.groupBy("layout", "accepted").agg(F.count(F.lit(1)).alias("grids"))


# --- streaming -------------------------------------------------------------------------------------------------


@query("i01_stream_ingest", """
SELECT date, location, terminal, traffic FROM (SELECT CAST(ts AS DATE) AS date, event_type AS location, 'T' || CAST(user_id % 5 AS VARCHAR) AS terminal, value AS traffic,
  ROW_NUMBER() OVER (PARTITION BY CAST(ts AS DATE), event_type, user_id % 5 ORDER BY value) AS rn FROM events WHERE value IS NOT NULL) WHERE rn = 1""")
def stream_ingest(spark, sf):
    """Events as visitor counts through the streaming load, then the stored table."""
    from sitemetrics.streaming.ingest import file_source, ingest_stream

    root = f"{shared_folder(spark)}/stream-{dt.datetime.now():%Y%m%d%H%M%S%f}"
    schema = X.table(spark, sf, "events").schema.simpleString()[len("struct<"):-1].replace(":", " ")
    source = file_source(spark, sf, schema, glob="events.parquet")

    def clean(batch: DataFrame) -> DataFrame:
        return ST.clean_traffic(batch.select(
            F.col("ts").cast("date").alias("date"), F.col("event_type").alias("location"), F.concat(F.lit("T"), text(F.col("user_id") % 5)).alias("terminal"), F.col("value").alias("traffic")))

    ingest_stream(source, root, ST.TRAFFIC, clean, f"{root}/checkpoint", "events", F.asc("traffic")).awaitTermination()
    return ST.read_table(spark, root, ST.TRAFFIC).select("date", "location", "terminal", "traffic")


@query("i01_repeated_events", """
SELECT 'events-0' AS file_name, COUNT(*) AS row_count, CAST(SUM(CAST(value AS DECIMAL(30,8))) AS DOUBLE) AS primary_total, MIN(CAST(ts AS DATE)) AS report_date,
  (SELECT COUNT(*) FROM events WHERE value IS NOT NULL) AS stored FROM events WHERE value IS NOT NULL""")
def repeated_events(spark, sf):
    """All events delivered twice in a stream, and the whole stream run again from the start: the audit has one load, the table each event once."""
    from sitemetrics.streaming.ingest import file_source, ingest_stream

    root = stage_path(spark, "stream")
    events = X.table(spark, sf, "events")
    for _ in range(2):
        events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(f"{root}/inbox")
    schema = "event_id bigint, ts timestamp, event_type string, value double"

    def clean(batch: DataFrame) -> DataFrame:
        return ST.clean_traffic(batch.select(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("location"), text("event_id").alias("terminal"), F.col("value").alias("traffic")))

    for run in ("first", "second"):
        source = file_source(spark, f"{root}/inbox", schema, per_batch=1)
        ingest_stream(source, root, ST.TRAFFIC, clean, f"{root}/checkpoint-{run}", "events", key=["event_id"], event_time="ts").awaitTermination()
    stored = ST.read_table(spark, root, ST.TRAFFIC).groupBy(F.col("source_file").alias("file_name")).agg(F.count(F.lit(1)).alias("stored"))
    return ST.history(spark, root).select("file_name", "row_count", "primary_total", "report_date").join(stored, "file_name", "left")


@query("m09_data_rows", with_ctes(["rev"], """
SELECT 'odd' AS kind, COUNT(*) AS rows FROM rev WHERE MONTH(date) % 2 = 1 UNION ALL
SELECT 'even', COUNT(*) FROM (SELECT DISTINCT location, DATE_TRUNC('month', date), segment, outlet FROM rev WHERE MONTH(date) % 2 = 0) UNION ALL
SELECT 'budget', COUNT(*) FROM (SELECT DISTINCT YEAR(date) FROM rev)"""))
def data_rows(spark, sf):
    cells = unknown_sheets(spark, sf)
    headers = materialise(G.find_headers(cells, VOCAB))
    rows = G.drop_junk_rows(cells, headers, materialise(G.header_labels(cells, headers))).select("grid_id", "row_idx").distinct()
    return rows.groupBy(F.split("grid_id", " ")[0].alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


@query("m03_header_labels", with_ctes(["rev"], """
SELECT label, COUNT(*) AS grids FROM (SELECT UNNEST(['Bill Date', 'City', 'Division', 'Shop', 'Visitors', 'Net Sales']) AS label, m FROM (
  SELECT DISTINCT DATE_TRUNC('month', date) AS m FROM rev WHERE MONTH(date) % 2 = 1)) GROUP BY label"""))
def header_label_counts(spark, sf):
    cells = unknown_sheets(spark, sf)
    labels = G.header_labels(cells, materialise(G.find_headers(cells, VOCAB)))
    return labels.where("grid_id like 'odd %'").groupBy("label").agg(F.count(F.lit(1)).alias("grids"))


@query("m13_confidence", None)
def second_confidence(spark, sf):
    r = INF.infer(unknown_sheets(spark, sf), VOCAB, TODAY, first=FIRST)
    report = QL.validation_report(r.rows, REGIONS, list(VOCAB.segments.values()), dt.date(2026, 1, 1), ["grid_id"])
    return INF.confidence_v2(r.mapping, r.rows, QL.validation_summary(report, ["grid_id"]))


@query("s06_stored_cells", with_ctes(["rev"], "SELECT CAST(COUNT(*) * 6 + COUNT(DISTINCT DATE_TRUNC('month', date)) * 6 AS BIGINT) AS cells, COUNT(DISTINCT DATE_TRUNC('month', date)) AS grids FROM rev"))
def stored_cells(spark, sf):
    from sitemetrics.workload.sheets import long_sheets

    return G.filled(materialise(long_sheets(spark, sf))).agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("grid_id").alias("grids"))
