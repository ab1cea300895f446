"""Scalar parsing and label functions over texts derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitemetrics.functions import dates as D
from sitemetrics.functions import labels as L
from sitemetrics.functions import numbers as NB
from sitemetrics.operators.terms import found_terms
from sitemetrics.workload import facts as X
from sitemetrics.workload.facts import with_ctes
from sitemetrics.workload.registry import query

WIDE_YEARS = (1990, 2050)


def orders(spark, sf):
    return X.table(spark, sf, "orders")


def price_text():
    return F.col("o_totalprice").cast("decimal(18,2)").cast("string")


PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"
PRICE_D = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)"


@query("k01_messy_numbers", with_ctes(["messy"], f"""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {PRICE_D} WHEN 1 THEN -{PRICE_D} WHEN 2 THEN {PRICE_D} * 100000.0::DOUBLE END AS value FROM messy"""))
def messy_numbers(spark, sf):
    return X.messy(spark, sf).select("o_orderkey", NB.messy_number("raw").alias("value"))


@query("k01_suffixes_and_marks", f"""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN {PRICE_D} * 10000000.0::DOUBLE WHEN 1 THEN {PRICE_D} * 1000.0::DOUBLE WHEN 2 THEN {PRICE_D} * 1000000.0::DOUBLE
  WHEN 3 THEN {PRICE_D} WHEN 4 THEN NULL ELSE -{PRICE_D} * 100000.0::DOUBLE END AS value FROM orders""")
def suffixes(spark, sf):
    k, p = F.col("o_orderkey") % 6, price_text()
    raw = (
        F.when(k == 0, F.concat(F.lit("₹ "), p, F.lit(" crores"))).when(k == 1, F.concat(p, F.lit(" K"))).when(k == 2, F.concat(F.lit("INR"), p, F.lit(" mn")))
        .when(k == 3, F.concat(p, F.lit(" %"))).when(k == 4, F.concat(F.lit("about "), p)).otherwise(F.concat(F.lit("("), p, F.lit(" lakhs)")))
    )
    return orders(spark, sf).select("o_orderkey", NB.messy_number(raw).alias("value"))


@query("k02_report_numbers", f"""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN {PRICE_D} WHEN 1 THEN {PRICE_D} END AS value FROM orders""")
def report_numbers(spark, sf):
    k, p = F.col("o_orderkey") % 3, price_text()
    raw = (
        F.when(k == 0, F.concat(F.substring(p, 1, 2), F.lit(" ,"), F.substring(p, 3, 50)))
        .when(k == 1, F.concat(F.lit("x"), p, F.lit("|77"))).otherwise(" - ")
    )
    return orders(spark, sf).select("o_orderkey", NB.report_number(raw).alias("value"))


@query("k03_count_numbers", f"""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {PRICE_D} WHEN 1 THEN {PRICE_D} END AS value FROM orders""")
def count_numbers(spark, sf):
    k, p = F.col("o_orderkey") % 4, price_text()
    raw = (
        F.when(k == 0, F.concat(F.lit(" "), F.substring(p, 1, 1), F.lit(","), F.substring(p, 2, 50)))
        .when(k == 1, p).when(k == 2, "—").otherwise(F.concat(p, F.lit(" t")))
    )
    return orders(spark, sf).select("o_orderkey", NB.count_number(raw).alias("value"))


@query("k04_float_or_null", f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN {PRICE_D} END AS value FROM orders")
def floats(spark, sf):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, price_text()).when(k == 1, "NaN").otherwise("n.a.")
    return orders(spark, sf).select("o_orderkey", NB.float_or_null(raw).alias("value"))


DAY = "CAST(o_orderdate AS DATE)"


def date_text():
    """The order date written in one of ten ways."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 10
    f = lambda p: F.date_format(d, p)
    serial = F.datediff(d, F.lit("1899-12-30")).cast("string")
    forms = [f("yyyy-MM-dd"), f("dd/MM/yyyy"), f("d-M-yyyy"), f("dd-MMM-yyyy"), f("d MMMM yyyy"), f("MMM d, yyyy"),
             F.concat(f("yyyy-MM-dd"), F.lit(" 00:00:00")), f("dd.MM.yyyy"), serial]
    out = F.lit("no date here")
    for i, form in reversed(list(enumerate(forms))):
        out = F.when(k == i, form).otherwise(out)
    return out


@query("k05_parse_dates", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 OR (o_orderkey % 10 = 8 AND {DAY} < DATE '2000-01-01') THEN NULL ELSE {DAY} END AS day FROM orders""")
def parse_dates(spark, sf):
    return orders(spark, sf).select("o_orderkey", D.text_date(date_text(), WIDE_YEARS).alias("day"))


@query("k05_month_first_fallback", f"SELECT o_orderkey, CASE WHEN DAY({DAY}) > 12 THEN {DAY} ELSE MAKE_DATE(YEAR({DAY}), DAY({DAY}), MONTH({DAY})) END AS day FROM orders")
def month_first(spark, sf):
    return orders(spark, sf).select("o_orderkey", D.text_date(F.date_format("o_orderdate", "MM/dd/yyyy"), WIDE_YEARS).alias("day"))


@query("k06_target_dates", f"SELECT o_orderkey, {DAY} AS day FROM orders")
def target_dates(spark, sf):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders(spark, sf).select("o_orderkey", D.target_date(raw).alias("day"))


@query("k07_date_in_text", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN {DAY} END AS day FROM orders")
def date_in_text(spark, sf):
    k, f = F.col("o_orderkey") % 4, F.date_format
    raw = (
        F.when(k == 0, F.concat(F.lit("Sales for the day "), f("o_orderdate", "dd-MMM-yyyy"), F.lit(" (final)")))
        .when(k == 1, F.concat(F.lit("report_"), f("o_orderdate", "yyyy-MM-dd"), F.lit(".xlsx")))
        .when(k == 2, F.concat(F.lit("99/99/2001 then "), f("o_orderdate", "dd/MM/yyyy"))).otherwise("no day 12 given")
    )
    return orders(spark, sf).select("o_orderkey", D.date_in_text(raw, WIDE_YEARS).alias("day"))


@query("k08_month_labels", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 OR YEAR({DAY}) < 2000 AND o_orderkey % 4 <> 2 THEN NULL ELSE CAST(DATE_TRUNC('month', {DAY}) AS DATE) END AS month
FROM orders""")
def month_labels(spark, sf):
    k, f = F.col("o_orderkey") % 4, F.date_format
    old = F.year("o_orderdate") < 2000
    raw = (
        F.when(k == 2, f("o_orderdate", "MMMM yyyy")).when(k == 3, f("o_orderdate", "'Fy'yy-MM")).when(old, "Fy24-25")
        .when(k == 0, F.concat(f("o_orderdate", "MMM"), F.lit("'"), f("o_orderdate", "yy"))).otherwise(f("o_orderdate", "MMM-yy"))
    )
    return orders(spark, sf).select("o_orderkey", D.month_label(raw).alias("month"))


@query("k09_day_numbers", "SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 40 BETWEEN 1 AND 31 AS is_day FROM orders")
def day_numbers(spark, sf):
    raw = F.concat((F.col("o_orderkey") % 40).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise(".5"))
    return orders(spark, sf).select("o_orderkey", D.is_day_number(raw).alias("is_day"))


@query("k10_day_month_swap", f"""
SELECT o_orderkey, CASE WHEN DAY({DAY}) <= 12 THEN {DAY} ELSE {DAY} + 0 END AS day FROM orders""")
def swap(spark, sf):
    d = F.col("o_orderdate").cast("date")
    swapped = F.when(F.dayofmonth(d) <= 12, F.make_date(F.year(d), F.dayofmonth(d), F.month(d))).otherwise(d)
    return orders(spark, sf).select("o_orderkey", D.fix_swapped_day(swapped, F.trunc(d, "MM")).alias("day"))


@query("k11_reference_month", f"""
SELECT o_custkey, COALESCE(MAX(CASE WHEN o_orderkey % 2 = 0 THEN CAST(DATE_TRUNC('month', {DAY}) AS DATE) END), DATE '2020-06-01') AS month FROM orders GROUP BY 1""")
def reference_month(spark, sf):
    dated = orders(spark, sf).groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("date"))).alias("d"))
    return dated.select("o_custkey", F.coalesce(F.trunc("d", "MM"), D.month_in_name(F.lit("North Traffic June-20"))).alias("month"))


@query("k18_k19_change_and_ratio", """
SELECT a.o_orderkey, CASE WHEN p IS NULL OR c IS NULL THEN NULL WHEN p = 0 THEN (CASE WHEN c > 0 THEN 10.0::DOUBLE WHEN c < 0 THEN -1.0::DOUBLE END) ELSE (c - p) / p END AS pct,
  CASE WHEN p = 0 THEN NULL ELSE c / p END AS ratio FROM
(SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE o_totalprice END AS p,
  CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN -o_totalprice ELSE o_totalprice * 1.07 END AS c FROM orders) a""")
def change_and_ratio(spark, sf):
    from sitemetrics.functions import metrics as M

    k5, k7, v = F.col("o_orderkey") % 5, F.col("o_orderkey") % 7, F.col("o_totalprice")
    o = orders(spark, sf).select(
        "o_orderkey", F.when(k5 == 0, 0.0).when(k5 != 1, v).alias("p"), F.when(k7 == 0, 0.0).when(k7 == 2, -v).when(k7 != 1, v * 1.07).alias("c"))
    return o.select("o_orderkey", M.pct_change("c", "p").alias("pct"), M.safe_div("c", "p").alias("ratio"))


@query("k20_penetration_and_spend", """
SELECT o_orderkey, o_orderkey / NULLIF(o_custkey % 50, 0) * 100 AS penetration_pct, o_totalprice / NULLIF(o_custkey % 50, 0) AS rev_per_visitor FROM orders""")
def penetration(spark, sf):
    from sitemetrics.functions import metrics as M

    t = F.col("o_custkey") % 50
    return orders(spark, sf).select("o_orderkey", M.penetration_pct("o_orderkey", t).alias("penetration_pct"), M.rev_per_visitor("o_totalprice", t).alias("rev_per_visitor"))


@query("k25_unit_notes", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 10000000.0::DOUBLE WHEN 1 THEN 100000.0::DOUBLE WHEN 2 THEN 1000.0::DOUBLE WHEN 3 THEN 1000000.0::DOUBLE
  WHEN 4 THEN 100000.0::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM orders""")
def unit_notes(spark, sf):
    k = F.col("o_orderkey") % 6
    out = F.lit("Revenue (INR)")
    for i, t in ((4, "Rs. Lacs | Outlet"), (3, "Sales in millions"), (2, "Figures ₹ '000"), (1, "(Rs. in Lakhs) — 05-07-2026"), (0, "Revenue in Crores")):
        out = F.when(k == i, t).otherwise(out)
    return orders(spark, sf).select("o_orderkey", NB.unit_multiplier(F.concat(out, F.lit(" | "), "o_orderpriority")).alias("factor"))


@query("k27_any_date", f"SELECT o_orderkey, {DAY} AS day FROM orders")
def any_date(spark, sf):
    k = F.col("o_orderkey") % 2
    raw = F.when(k == 0, F.col("o_orderdate").cast("date").cast("string")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return orders(spark, sf).select("o_orderkey", D.any_date(raw).alias("day"))


@query("l01_norm_labels", r"""
SELECT doc_id, REGEXP_REPLACE(TRIM(REGEXP_REPLACE(LOWER(TRIM(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(text, '[\n_\-]', ' ', 'g'),
  '[^\p{L}\p{N}_&%().'' ]+', ' ', 'g'), '\s+', ' ', 'g'))), '\.+$', '')), ' $', '') AS label FROM documents""")
def norm_labels(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", L.norm_label("text").alias("label"))


@query("l02_blank_test", """
SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 2, 3) AS blank FROM orders""")
def blanks(spark, sf):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.lit(None)).when(k == 1, "  ").when(k == 2, "NaN").when(k == 3, " None ").otherwise(F.col("o_orderpriority"))
    return orders(spark, sf).select("o_orderkey", L.is_blank(raw).alias("blank"))


@query("l03_clean_cells", r"""
SELECT doc_id, NULLIF(TRIM(REGEXP_REPLACE(text, '[ \t\n\r\f\v]+', ' ', 'g')), '') AS text FROM documents""")
def clean_cells(spark, sf):
    padded = F.concat(F.lit("​ "), F.col("text"), F.lit("  "))
    return X.table(spark, sf, "documents").select("doc_id", L.clean_cell(padded).alias("text"))


@query("l04_title_case", """
SELECT DISTINCT p_name, UPPER(LEFT(split_part(p_name, ' ', 1), 1)) || LOWER(SUBSTRING(split_part(p_name, ' ', 1), 2)) || '-(' ||
  UPPER(LEFT(split_part(p_name, ' ', 2), 1)) || LOWER(SUBSTRING(split_part(p_name, ' ', 2), 2)) || ')' AS label,
  CASE WHEN p_type = 'ECONOMY' THEN 'ECONOMY' ELSE UPPER(LEFT(p_type, 1)) || LOWER(SUBSTRING(p_type, 2)) END AS kind FROM part""")
def title_case(spark, sf):
    raw = F.concat(F.regexp_replace("p_name", " ", "-("), F.lit(")"))
    return X.table(spark, sf, "part").select("p_name", L.title_case(raw).alias("label"), L.title_case(F.lower("p_type"), ["economy"]).alias("kind")).distinct()


PLACES = {"asia": "Asia", "east": "Orient", "middle east": "Orient", "america": "Americas", "usa": "Americas", "af": "Short"}


@query("l05_location_match", """
SELECT n_nationkey, r_name, CASE r_name WHEN 'ASIA' THEN 'Asia' WHEN 'MIDDLE EAST' THEN 'Orient' WHEN 'AMERICA' THEN 'Americas' END AS exact_or_part,
  CASE r_name WHEN 'ASIA' THEN 'Asia' WHEN 'MIDDLE EAST' THEN 'Orient' WHEN 'AMERICA' THEN 'Americas' END AS in_sentence
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def location_match(spark, sf):
    n = X.table(spark, sf, "nation").join(X.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sheet = F.concat(F.lit("Traffic_"), "r_name", F.lit("-"), F.col("n_nationkey").cast("string"))
    return n.select("n_nationkey", "r_name", L.vocabulary_match("r_name", PLACES).alias("exact_or_part"), L.vocabulary_match(sheet, PLACES).alias("in_sentence"))


#: Texts that name customers, nations and segments, some of them with letters grown on: those are no names. For Spark and DuckDB.
NAMED = """
SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN concat('Report of ', c_name, ', ', n_name) WHEN 1 THEN concat('Totals ', n_name, 'x ', c_mktsegment)
  WHEN 2 THEN concat(lower(c_name), 's goal sheet') ELSE concat(c_mktsegment, '-ish ', n_name, '/', c_name, ' (final)') END AS label
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
TERMS = """
SELECT lower(c_name) AS term, concat('customer ', CAST(c_custkey AS STRING)) AS name, CAST(c_custkey AS INT) AS priority FROM customer
UNION ALL SELECT n_name, concat('nation ', CAST(n_nationkey AS STRING)), CAST(1000000 + n_nationkey AS INT) FROM nation
UNION ALL SELECT DISTINCT c_mktsegment, concat('segment ', lower(c_mktsegment)), 2000000 FROM customer"""


@query("l05_site_codes", f"""
WITH named AS ({NAMED}), term AS (SELECT array_to_string(w, ' ') AS term, len(w) AS n, name, priority FROM (
  SELECT *, list_filter(regexp_split_to_array(lower(term), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM ({TERMS}))),
words AS (SELECT label, list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM named),
runs AS (SELECT label, pos, k, array_to_string(list_slice(w, pos, pos + k - 1), ' ') AS run FROM (SELECT label, w, k, UNNEST(range(1, len(w) - k + 2)) AS pos FROM words, (SELECT DISTINCT n AS k FROM term) WHERE len(w) >= k))
SELECT label, name, term FROM runs JOIN term ON run = term QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY n DESC, length(term) DESC, pos, priority, name) = 1""")
def site_codes(spark, sf):
    """A dictionary of all customers, nations and segments looked up in texts between word borders."""
    t = lambda n: X.table(spark, sf, n)
    named = NAMED.replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}").replace("JOIN nation", "JOIN {nation}")
    labels = spark.sql(named, orders=t("orders"), customer=t("customer"), nation=t("nation"))
    terms = spark.sql(TERMS.replace("FROM customer", "FROM {customer}").replace("FROM nation", "FROM {nation}"), customer=t("customer"), nation=t("nation"))
    return found_terms(labels, "label", terms).select("label", "name", "term")


@query("l06_segment_match", """
SELECT DISTINCT c_mktsegment AS segment, CASE c_mktsegment WHEN 'BUILDING' THEN 'Homes' WHEN 'FURNITURE' THEN 'Homes' WHEN 'HOUSEHOLD' THEN 'Homes' WHEN 'MACHINERY' THEN 'Plant' END AS canonical
FROM customer""")
def segment_match(spark, sf):
    vocab = {"building": "Homes", "furnit": "Homes", "household": "Homes", "machine": "Plant"}
    return X.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment")).distinct().withColumn("canonical", L.vocabulary_match("segment", vocab, 5))


@query("l07_segment_from_outlet", """
SELECT DISTINCT p_name, CASE WHEN p_name LIKE '%small%' THEN 'Compact' WHEN p_name LIKE '%red%' THEN 'Colour' WHEN p_name LIKE '%ring%' THEN 'Jewels' END AS segment FROM part""")
def segment_from_outlet(spark, sf):
    rules = [("small", "Compact"), ("red", "Colour"), ("ring", "Jewels")]
    return X.table(spark, sf, "part").select("p_name").distinct().withColumn("segment", L.keyword_class("p_name", rules))


@query("l15_column_group_terminal", """
SELECT DISTINCT o_orderpriority AS label, CASE o_orderpriority WHEN '1-URGENT' THEN 'T1' WHEN '2-HIGH' THEN 'T2' ELSE '' END AS terminal FROM orders""")
def column_group_terminal(spark, sf):
    table = {"1-urgent": "T1", "2-high": "T2"}
    o = orders(spark, sf).select(F.col("o_orderpriority").alias("label")).distinct()
    return o.withColumn("terminal", F.coalesce(L.lookup(F.lower("label"), table), F.lit("")))


@query("l16_total_labels", """
SELECT o_orderkey, o_orderkey % 7 < 4 AS is_total FROM orders""")
def total_labels(spark, sf):
    k = F.col("o_orderkey") % 7
    out = F.concat(F.lit("Totally "), "o_orderpriority")
    for i, t in ((0, F.lit("Grand-Total")), (1, F.concat(F.lit("Total "), "o_orderpriority")), (2, F.concat("o_orderpriority", F.lit(" overall"))), (3, F.lit(" SUM. ")),
                 (4, F.lit("summary")), (5, F.col("o_orderpriority"))):
        out = F.when(k == i, t).otherwise(out)
    return orders(spark, sf).select("o_orderkey", L.is_total_label(out).alias("is_total"))


@query("l18_cell_kinds", f"""
SELECT o_orderkey, o_orderkey % 4 = 0 AS is_number, o_orderkey % 4 = 1 AS is_date, o_orderkey % 4 = 2 AS is_location, o_orderkey % 4 = 3 AS is_blank FROM orders""")
def cell_kinds(spark, sf):
    from sitemetrics.plans.grids import cell_kind_columns

    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, price_text()).when(k == 1, F.date_format("o_orderdate", "dd-MMM-yyyy")).when(k == 2, "Middle East").otherwise(" ")
    o = orders(spark, sf).select("o_orderkey", raw.alias("value"))
    return o.select("o_orderkey", *cell_kind_columns("value", PLACES, WIDE_YEARS))
