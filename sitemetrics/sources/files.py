"""Corpus files: manifest, delimited text, JSON, XML and HTML to cells. A file is one row; files spread over executors."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemetrics.functions.core import let
from sitemetrics.operators.ordered import running_sum
from sitemetrics.operators.reuse import written

# Formats by extension and by leading bytes (hex), candidate delimiters, JSON wrapper keys.
EXTENSIONS = {
    "csv": "csv", "tsv": "csv", "txt": "text", "json": "json", "xml": "xml", "html": "html", "htm": "html", "xlsx": "excel", "xlsm": "excel",
    "xls": "excel", "pdf": "pdf", "docx": "word", "eml": "mail", "png": "image", "jpg": "image", "jpeg": "image",
}
LEADING_BYTES = {"25504446": "pdf", "504B0304": "zip", "D0CF11E0": "ole", "89504E47": "image", "FFD8FF": "image", "3C3F786D6C": "xml"}
DELIMITERS = {",": ",", ";": ";", "\t": r"\t", "|": r"\|"}
#: Bytes of a file whose ranges are summed in one window; longer files go up another level.
RANGE_RUN = 2**36
WRAPPERS = ["data", "records", "rows", "results", "items", "report"]


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a folder as (path, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def decoded(content) -> Column:
    """UTF-8 text without byte-order mark; bytes that are not UTF-8 are read as Latin-1."""
    c = F.col(content) if isinstance(content, str) else content
    utf8 = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(c, "ISO-8859-1")), "^﻿", "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def sniff_delimiter(text: Column) -> Column:
    """The candidate that occurs most in the text; comma on a tie or when none occurs."""
    names = list(DELIMITERS)
    counted = F.array(*[F.struct(_count(text, p).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, (d, p) in enumerate(DELIMITERS.items())])
    best = F.array_max(counted)
    return F.when(best["n"] > 0, best["d"]).otherwise(names[0])


def manifest(files: DataFrame) -> DataFrame:
    """One row per file: size, extension, format by leading bytes or extension, encoding, delimiter."""
    head = F.hex(F.substring("content", 1, 16))
    magic = F.lit(None).cast("string")
    for bytes_, name in LEADING_BYTES.items():
        magic = F.when(head.startswith(bytes_), name).otherwise(magic)
    by_name = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    ext = extension("path")
    named = F.try_element_at(by_name, ext)
    kind = F.when(magic.isin("zip", "ole") & named.isNotNull(), named).otherwise(F.coalesce(magic, named, F.lit("unknown")))
    text = kind.isin("csv", "text", "json", "xml", "html")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    encoding = F.when(head.startswith("EFBBBF"), "utf-8-sig").when(valid, "utf-8").otherwise("latin-1")
    return files.select(
        "path", F.length("content").cast("bigint").alias("size"), ext.alias("extension"), kind.alias("format"), F.when(text, encoding).alias("encoding"),
        F.when(kind.isin("csv", "text"), sniff_delimiter(decoded("content"))).alias("delimiter"),
    )


def delimited_cells(files: DataFrame) -> DataFrame:
    """Cells of delimited texts; ``files``: path, text. Quoted fields may hold delimiters, quotes and line breaks; blank lines keep their number."""
    body = F.regexp_replace("text", r"(\r\n|\n|\r)$", "")
    records = F.regexp_extract_all(body, F.lit(r'((?:"[^"]*+"|[^"\r\n]++|")*+)(?:\r\n|\n|\r|$)'), F.lit(1))
    lines = files.select("path", sniff_delimiter(F.col("text")).alias("d"), records.alias("r")).select(
        "path", "d", F.posexplode(F.slice("r", 1, F.greatest(F.size("r") - 1, F.lit(0)))).alias("row_idx", "line"))
    return _record_cells(lines)


def _record_cells(records: DataFrame) -> DataFrame:
    """Cells of records; ``records``: path, d (the file's delimiter), row_idx, line."""
    pattern = F.create_map(*[F.lit(x) for kv in DELIMITERS.items() for x in kv])
    lines = records.withColumn("p", F.element_at(pattern, F.col("d")))
    field = F.concat(F.col("p"), F.lit('((?:"[^"]*+"|[^'), F.col("p"), F.lit('"]++|")*+)'))
    fields = lines.select("path", "row_idx", F.posexplode(F.regexp_extract_all(F.concat("d", "line"), field, F.lit(1))).alias("col_idx", "raw"))
    bare = F.when(F.col("raw").rlike(r'(?s)^".*"$'), F.replace(F.expr("substring(raw, 2, length(raw) - 2)"), F.lit('""'), F.lit('"'))).otherwise(F.col("raw"))
    return fields.select(F.col("path").alias("grid_id"), F.col("path").alias("source"), F.lit("").alias("sheet"), "row_idx", "col_idx", bare.alias("value"))


def text_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Lines of delimited files as (path, block, at, line). Spark reads a file in byte ranges, many tasks for a large one; ``block`` is the
    range's start and ``at`` rises with the lines of a range. A line ends at a line feed; a carriage return stays at its end.
    """
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def line_records(lines: DataFrame) -> DataFrame:
    """Records of delimited files from their lines: (path, d, row_idx, line); ``lines`` as of :func:`text_lines`.

    A line starts a record when the quotes before it in the file are even. Each byte range counts its own quotes first; a prefix scan over
    the ranges (one row each) then says whether a range begins inside a quoted field and how many records lie before it. Lines that are a
    record by themselves go straight on; only records with line breaks in a field are put together. Where the quotes of a file are odd its
    last one is plain text. Delimiter and encoding (UTF-8, else Latin-1) are those of the whole file.
    """
    here = Window.partitionBy("path", "block").orderBy("at")
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    # After the last line with a quote of its range a line is in the tail; ``turn`` is that last line itself.
    last = F.max(F.when(F.col("q") > 0, F.col("at"))).over(Window.partitionBy("path", "block"))
    counted = lines.withColumn("q", quotes).withColumns({
        "before": F.coalesce(F.sum("q").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2,
        "tail": F.coalesce(F.col("at") > last, F.lit(True)), "turn": F.coalesce(F.col("at") == last, F.lit(False))})
    ranges = counted.groupBy("path", "block").agg(
        F.sum("q").alias("quotes"), *[F.count_if((F.col("before") == p) & ~F.col("tail")).alias(f"n{p}") for p in (0, 1)], F.count_if("tail").alias("tails"),
        F.bool_and(F.is_valid_utf8("line")).alias("utf8"), *[F.sum(_count(F.col("line"), x)).alias(f"d{i}") for i, x in enumerate(DELIMITERS.values())])
    files = ranges.groupBy("path").agg(
        (F.sum("quotes") % 2 == 1).alias("odd"), F.max(F.when(F.col("quotes") > 0, F.col("block"))).alias("last"), F.bool_and("utf8").alias("all_utf8"),
        F.array_max(F.array(*[F.struct(F.sum(f"d{i}").alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])).alias("best"))
    files = files.select("path", "odd", "last", "all_utf8", F.when(F.col("best.n") > 0, F.col("best.d")).otherwise(F.lit(next(iter(DELIMITERS)))).alias("d"))
    after = F.col("odd") & (F.col("block") > F.col("last"))
    entered = running_sum(ranges.join(files, "path"), ["path"], "block", F.col("quotes"), "__quotes", RANGE_RUN, inclusive=False).withColumn(
        "inside", F.when(after, 0).otherwise(F.coalesce("__quotes", F.lit(0)) % 2))
    tail_parity = F.when(F.col("odd") & (F.col("block") >= F.col("last")), 0).otherwise((F.col("inside") + F.col("quotes")) % 2)
    entered = entered.withColumn("starts", F.when(F.col("inside") == 0, F.col("n0")).otherwise(F.col("n1")) + F.when(tail_parity == 0, F.col("tails")).otherwise(0))
    placed = running_sum(entered, ["path"], "block", F.col("starts"), "first", RANGE_RUN, inclusive=False).select(
        "path", "block", "inside", F.coalesce("first", F.lit(0)).alias("first"), "odd", "last", "all_utf8", "d", tail_parity.alias("tail_parity"))
    known = counted.join(placed, ["path", "block"])
    parity = F.when(F.col("tail"), F.col("tail_parity")).otherwise((F.col("inside") + F.col("before")) % 2)
    loose = F.when(F.col("odd") & F.col("turn") & (F.col("block") == F.col("last")), 1).otherwise(0)
    judged = known.withColumns({"start": parity == 0, "open": (parity + F.col("q") - loose) % 2 == 1})
    numbered = judged.withColumn("row_idx", F.col("first") + F.sum(F.col("start").cast("bigint")).over(here.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    raw = F.when(F.col("all_utf8"), F.col("line")).otherwise(F.decode(F.col("line").cast("binary"), "ISO-8859-1"))
    clean = numbered.select("path", "d", "row_idx", "block", "at", "start", "open", raw.alias("line"))
    alone = clean.where("start and not open").select("path", "d", "row_idx", "line")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"])
    joined = clean.where("not start or open").groupBy("path", "d", "row_idx").agg(F.array_join(ordered, "\n").alias("line"))
    bare = F.regexp_replace(F.regexp_replace("line", "\r$", ""), "^\ufeff", "")
    return alone.unionByName(joined).select("path", "d", F.col("row_idx").cast("bigint").alias("row_idx"), F.when(F.col("row_idx") == 0, bare).otherwise(F.regexp_replace("line", "\r$", "")).alias("line"))


def read_delimited(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Cells of delimited files of any size, as :func:`delimited_cells`, but no row ever holds a whole file.

    One record must fit a row, and the line breaks are line feeds, with or without carriage returns before them.
    """
    return _record_cells(line_records(text_lines(spark, path, glob)))


def table_cells(df: DataFrame, grid: str, order: str) -> DataFrame:
    """Cells of a native table (header as row 0); ``order`` numbers its rows from 0."""
    names = [c for c in df.columns if c not in (grid, order)]
    head = df.select(grid).distinct().select(grid, F.lit(0).alias("row_idx"), F.posexplode(F.array(*[F.lit(n) for n in names])).alias("col_idx", "value"))
    body = df.select(grid, (F.col(order) + 1).cast("int").alias("row_idx"), F.posexplode(F.array(*[F.col(n).cast("string") for n in names])).alias("col_idx", "value"))
    return head.unionByName(body).withColumnRenamed(grid, "grid_id")


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs to dotted columns, arrays and maps to JSON text."""
    def leaves(schema: T.StructType, prefix: tuple[str, ...]):
        for f in schema.fields:
            path = (*prefix, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, path)
            else:
                yield path, f.dataType

    out = []
    for path, kind in leaves(df.schema, ()):
        c = reduce(lambda a, n: a[n], path[1:], F.col(f"`{path[0]}`"))
        out.append((F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType)) else c).alias(".".join(path)))
    return df.select(*out)


def json_records(df: DataFrame) -> DataFrame:
    """Rows of JSON documents, nesting flattened. Each document's first wrapper key that holds a list is exploded; one without is a row."""
    lists = [w for w in WRAPPERS if w in df.columns and isinstance(df.schema[w].dataType, T.ArrayType)]
    if not lists:
        return flatten(df)
    own = [c for c in df.columns if c not in lists]
    rest = F.lit(True)
    parts = []
    for w in lists:
        records = df.where(rest & F.col(w).isNotNull()).select(F.explode(w).alias("r"))
        parts.append(flatten(records.select("r.*") if isinstance(records.schema["r"].dataType, T.StructType) else records))
        rest = rest & F.col(w).isNull()
    if own:
        bare = F.lit(False)
        for c in own:
            bare = bare | F.col(f"`{c}`").isNotNull()
        parts.append(flatten(df.where(rest & bare).select(*[f"`{c}`" for c in own])))
    kinds: dict[str, set] = {}
    for p in parts:
        for name, kind in p.dtypes:
            kinds.setdefault(name, set()).add(kind)
    same = [p.select(*[(F.col(f"`{c}`").cast("string") if len(kinds[c]) > 1 else F.col(f"`{c}`")).alias(c) for c in p.columns]) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return json_records(spark.read.option("multiLine", "true").json(path))


def json_pairs(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, key, value) of one-level JSON objects held in a text column; nested values stay JSON text."""
    return df.select(id_col, F.explode(F.from_json(text, "map<string,string>")).alias("key", "value"))


_NAME = r"[A-Za-z_][\w.\-]*"
_PREFIX = rf"(?:{_NAME}:)?"


def xml_row_tag(text: Column) -> Column:
    """The outermost element with child elements, below the root, that occurs more than once; else the first below the root; else the root.

    Names are without their namespace prefix.
    """
    names = F.regexp_extract_all(text, F.lit(rf"<{_PREFIX}({_NAME})"), F.lit(1))
    parent = lambda x: F.regexp_like(text, F.concat(F.lit(rf"<{_PREFIX}"), x, F.lit(rf"(?:\s[^>]*)?>\s*<{_PREFIX}{_NAME}")))
    below = lambda n: F.filter(F.slice(F.array_distinct(n), 2, F.greatest(F.size(n), F.lit(1))), parent)
    return let(names, lambda n: F.coalesce(
        F.try_element_at(F.filter(below(n), lambda x: F.size(F.filter(n, lambda y: y == x)) > 1), F.lit(1)), F.try_element_at(below(n), F.lit(1)), F.try_element_at(n, F.lit(1))))


def _without_cdata(text: Column) -> Column:
    """CDATA sections as escaped text, comments dropped."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    found = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?s)<!\[CDATA\[(.*?)\]\]>"), F.lit(1)))
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.aggregate(found, bare, lambda acc, c: F.replace(acc, F.concat(F.lit("<![CDATA["), c, F.lit("]]>")), plain(c)))


def xml_cells(files: DataFrame) -> DataFrame:
    """Leaf elements of the row element as (path, row_idx, name, value); ``files``: path, text. A file of one record has one row."""
    tagged = files.select("path", _without_cdata(F.col("text")).alias("text")).withColumn("tag", xml_row_tag(F.col("text"))).where("tag is not null")
    row = F.concat(F.lit(rf"(?s)<{_PREFIX}"), F.col("tag"), F.lit(rf"(?:\s[^>]*)?>(.*?)</{_PREFIX}"), F.col("tag"), F.lit(">"))
    rows = tagged.select("path", F.posexplode(F.regexp_extract_all("text", row, F.lit(1))).alias("row_idx", "body"))
    leaf = rf"<{_PREFIX}({_NAME})(?:\s[^>]*)?>([^<]*)</{_PREFIX}\1>"
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(leaf), F.lit(1)).alias("n"), F.regexp_extract_all("body", F.lit(leaf), F.lit(2)).alias("v"))
    return rows.select("path", "row_idx", F.explode(pairs).alias("x")).select("path", "row_idx", F.col("x.n").alias("name"), unescape(F.col("x.v")).alias("value"))


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Large XML files through the built-in reader."""
    return flatten(spark.read.format("xml").option("rowTag", row_tag).load(path))


def xml_row_tags(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, tag) of XML files of any size: the row element as of :func:`xml_row_tag`, without its namespace prefix.

    Files are read in byte ranges and cut at end tags, so that a start tag and the one right below it are in one piece. Markup in a comment or
    CDATA section is left out, but for pieces that lie wholly inside one (markup with end tags, quoted there).
    """
    pieces = spark.read.option("lineSep", "</").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("at"), F.col("value").alias("piece"))
    closed = F.regexp_replace("piece", r"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)", "")
    pieces = pieces.withColumn("piece", F.regexp_replace(closed, r"(?s)^.*(?:-->|\]\]>)", ""))
    tag = rf"<{_PREFIX}({_NAME})"
    parents = F.regexp_extract_all("piece", F.lit(rf"{tag}(?:\s[^>]*)?(?<!/)>\s*(?=<{_NAME})"), F.lit(1))
    named = pieces.select("path", "block", "at", parents.alias("parents"), F.posexplode(F.regexp_extract_all("piece", F.lit(tag + r"(?=[\s/>])"), F.lit(1))).alias("i", "tag"))
    # A place in a block is one number, so that a task aggregates its tags by hash, a row for each name, and sorts none.
    place = F.shiftleft("at", 30) + F.col("i")
    tags = named.groupBy("path", "block", "tag").agg(F.count("*").alias("n"), F.bool_or(F.array_contains("parents", F.col("tag"))).alias("parent"), F.min(place).alias("place"))
    tags = tags.groupBy("path", "tag").agg(F.sum("n").alias("n"), F.bool_or("parent").alias("parent"), F.min(F.struct("block", "place")).alias("first"))
    tags = written(tags, "tags")
    roots = tags.groupBy("path").agg(F.min("first").alias("root"))
    rank = F.when(F.col("first") == F.col("root"), 2).when(F.col("parent") & (F.col("n") > 1), 0).when(F.col("parent"), 1).otherwise(3)
    return tags.join(roots, "path").groupBy("path").agg(F.min_by("tag", F.struct(rank.alias("rank"), "first")).alias("tag"))


def _leaf_cells(value: Column, kind: T.DataType, name: str) -> Column:
    """(name, value) of all leaves of a nested column, one for each element of a list; text beside attributes has its element's name."""
    if isinstance(kind, T.StructType):
        below = lambda f: name if f.name == "_VALUE" else f"{name}.{f.name}" if name else f.name
        return F.concat(*[_leaf_cells(value[f.name], f.dataType, below(f)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        each = F.flatten(F.transform(value, lambda x: _leaf_cells(x, kind.elementType, name)))
        return F.coalesce(each, F.array().cast("array<struct<name:string,value:string>>"))
    return F.array(F.struct(F.lit(name).alias("name"), value.cast("string").alias("value")))


def read_xml_groups(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Cells of XML files as (path, tag, row_idx, name, value): one read of Spark's XML source for all files of one row element.

    Names are paths below the row, joined by points; attributes have a leading underscore, and elements that repeat in a row give a cell each.
    Values stay text; an empty element is an empty text. The source streams a file through one task, so a row, but no file, must fit memory. The
    list of files and their row elements comes to the driver, as the source's own listing of files does. No files give no rows. File names with
    glob characters are an error, since the source's own inference reads them as patterns.
    """
    files: dict[str, list[str]] = {}
    for r in xml_row_tags(spark, path, glob).collect():
        files.setdefault(r["tag"], []).append(unquote(r["path"]))
    parts = []
    for tag, paths in sorted(files.items()):
        options = {"rowTag": tag, "inferSchema": "false", "multiLine": "true", "ignoreNamespace": "true"}
        read = spark.read.format("xml").options(**options).load(sorted(paths))
        row = F.struct(*[F.col(f"`{c}`") for c in read.columns])
        cells = _leaf_cells(row, T.StructType(read.schema.fields), "")
        placed = read.select(F.col("_metadata.file_path").alias("path"), F.lit(tag).alias("tag"), F.monotonically_increasing_id().alias("at"), cells.alias("cells"))
        parts.append(placed.select("path", "tag", "at", F.inline("cells")).where("value IS NOT NULL"))
    if not parts:
        return spark.createDataFrame([], "path string, tag string, row_idx long, name string, value string")
    # A file's rows are numbered one after the other by the task that reads it.
    cells = written(reduce(DataFrame.unionByName, parts), "xml")
    begin = cells.groupBy("path").agg(F.min("at").alias("begin"))
    return cells.join(begin, "path").select("path", "tag", (F.col("at") - F.col("begin")).alias("row_idx"), "name", "value")


def _numbered(text: Column) -> Column:
    """Decimal and hexadecimal character references as characters."""
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(1)))
    code = lambda r: F.when(r.rlike("^[xX]"), F.substring(r, 2, 10)).otherwise(F.hex(r.cast("long")))
    return F.aggregate(refs, text, lambda acc, r: F.replace(acc, F.concat(F.lit("&#"), r, F.lit(";")), F.decode(F.unhex(F.lpad(code(r), 8, "0")), "UTF-32")))


def unescape(text: Column) -> Column:
    out = text
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.replace(_numbered(out), F.lit("&amp;"), F.lit("&"))


def html_cells(pages: DataFrame, id_col: str = "path", html: str = "html") -> DataFrame:
    """Cell texts of every <table>; unclosed rows and cells end at the next one. Output (id, table_idx, row_idx, col_idx, value)."""
    every = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    tables = pages.select(id_col, F.posexplode(every(html, r"(?is)<table\b[^>]*>(.*?)</table>")).alias("table_idx", "t"))
    rows = tables.select(id_col, "table_idx", F.posexplode(every("t", r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|$)")).alias("row_idx", "r"))
    cells = rows.select(id_col, "table_idx", "row_idx", F.posexplode(every("r", r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dh]>|$)")).alias("col_idx", "c"))
    text = F.trim(F.regexp_replace(unescape(F.regexp_replace("c", r"(?s)<[^>]*>", "")), r"\s+", " "))
    return cells.select(id_col, "table_idx", "row_idx", "col_idx", text.alias("value"))


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    """Column by alias: equal ignoring case and blanks first, then contained."""
    names = {c.strip().lower(): c for c in df.columns}
    wanted = [c.strip().lower() for c in candidates]
    hit = next((names[w] for w in wanted if w in names), None)
    return hit or next((orig for w in wanted for low, orig in names.items() if w in low), None)


def rename_by_alias(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Native tables: columns renamed to their role, others dropped."""
    found = {role: find_column(df, names) for role, names in aliases.items()}
    return df.select(*[F.col(f"`{c}`").alias(role) for role, c in found.items() if c])
