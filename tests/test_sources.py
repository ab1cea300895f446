from __future__ import annotations

import tempfile
from pathlib import Path

from sitemetrics.sources import files as FS


def test_manifest_and_delimited_files(spark):
    root = Path(tempfile.mkdtemp(prefix="files-"))
    (root / "a.csv").write_bytes(b"\xef\xbb\xbfDate;Name\n2026-07-05;\"x;\"\"y\"\"\nz\"\n\n1;2\n")
    (root / "b.txt").write_bytes("Caf\xe9\t1\n".encode("latin-1"))
    (root / "c.xlsx").write_bytes(b"PK\x03\x04rest")
    (root / "d.bin").write_bytes(b"%PDF-1.7")
    m = {Path(r["path"]).name: r for r in FS.manifest(FS.read_files(spark, str(root))).collect()}
    assert (m["a.csv"]["format"], m["a.csv"]["encoding"], m["a.csv"]["delimiter"]) == ("csv", "utf-8-sig", ";")
    assert (m["b.txt"]["encoding"], m["b.txt"]["delimiter"]) == ("latin-1", "\t")
    assert m["c.xlsx"]["format"] == "excel" and m["d.bin"]["format"] == "pdf" and m["d.bin"]["delimiter"] is None
    texts = FS.read_files(spark, str(root), "*.[ct][sx][vt]").select("path", FS.decoded("content").alias("text"))
    got = {(Path(r["source"]).name, r["row_idx"], r["col_idx"]): r["value"] for r in FS.delimited_cells(texts).collect()}
    assert got[("a.csv", 0, 0)] == "Date" and got[("a.csv", 1, 1)] == 'x;"y"\nz' and got[("a.csv", 2, 0)] == "" and got[("a.csv", 3, 1)] == "2"
    assert got[("b.txt", 0, 0)] == "Café"


def test_long_and_odd_lines(spark):
    long = ",".join(["v" * 50] * 3000)
    text = f'{long}\n5" pipe,ok\n'
    df = spark.createDataFrame([("p", text)], "path string, text string")
    cells = FS.delimited_cells(df)
    assert cells.where("row_idx = 0").count() == 3000
    assert [r["value"] for r in cells.where("row_idx = 1").orderBy("col_idx").collect()] == ['5" pipe', "ok"] or cells.where("row_idx = 1").count() == 1


def test_json_and_xml(spark):
    root = Path(tempfile.mkdtemp(prefix="json-"))
    (root / "a.json").write_text('{"meta": 1, "records": [{"a": {"b": 1, "c": [1, 2]}, "d": "x"}, {"a": {"b": 2}, "d": "y"}]}')
    rows = FS.read_json(spark, str(root / "a.json")).orderBy("d").collect()
    assert [r["a.b"] for r in rows] == [1, 2] and rows[0]["a.c"] == "[1,2]"
    (root / "a.xml").write_text("<root><title>t</title><row><a>1</a><b>x &amp; y</b></row><row><a>2</a></row></root>")
    text = spark.createDataFrame([("p", (root / "a.xml").read_text())], "path string, text string")
    got = {(r["row_idx"], r["name"]): r["value"] for r in FS.xml_cells(text).collect()}
    assert got == {(0, "a"): "1", (0, "b"): "x & y", (1, "a"): "2"}
    assert FS.read_xml(spark, str(root / "a.xml"), "row").count() == 2


def test_html_tables_with_open_tags(spark):
    html = "<p>x</p><TABLE><tr><th>A<th>B</tr><tr><td>1 <b>&amp;</b> 2</td><td>3</td></table><table><tr><td>z</td></tr></table>"
    got = {(r["table_idx"], r["row_idx"], r["col_idx"]): r["value"] for r in FS.html_cells(spark.createDataFrame([("p", html)], "path string, html string")).collect()}
    assert got == {(0, 0, 0): "A", (0, 0, 1): "B", (0, 1, 0): "1 & 2", (0, 1, 1): "3", (1, 0, 0): "z"}


def test_column_aliases(spark):
    df = spark.createDataFrame([(1, 2)], "`Report Date` int, `Total Revenue (INR)` int")
    assert FS.find_column(df, ["revenue"]) == "Total Revenue (INR)" and FS.find_column(df, ["report date"]) == "Report Date" and FS.find_column(df, ["x"]) is None


def test_xml_of_other_shapes(spark):
    files = {
        "one": "<root><row><a>1</a><b>&#233;&#x41;&apos;</b></row></root>",
        "prefix": "<n:root xmlns:n='u'><n:row><n:a>1</n:a></n:row><n:row><n:a>2</n:a></n:row></n:root>",
        "leaves": "<root><meta><k>p</k><k>q</k></meta><row><a>1</a></row><row><a>2</a></row></root>",
        "cdata": "<root><!-- <row> --><row><a><![CDATA[x < y & z]]></a></row><row><a>2</a></row></root>",
        "flat": "<rec><a>1</a><b>2</b></rec>",
    }
    got = {}
    for r in FS.xml_cells(spark.createDataFrame(list(files.items()), "path string, text string")).orderBy("path", "row_idx", "name").collect():
        got.setdefault(r["path"], []).append((r["row_idx"], r["name"], r["value"]))
    assert got == {
        "one": [(0, "a", "1"), (0, "b", "éA'")], "prefix": [(0, "a", "1"), (1, "a", "2")], "leaves": [(0, "a", "1"), (1, "a", "2")],
        "cdata": [(0, "a", "x < y & z"), (1, "a", "2")], "flat": [(0, "a", "1"), (0, "b", "2")],
    }


def test_xml_groups_of_many_shapes(spark, tmp_path):
    files = {
        "one.xml": "<root><row><a>1</a><b>&#233;&#x41;&apos;</b></row></root>",
        "a prefix.xml": "<n:root xmlns:n='u'><n:row><n:a>1</n:a></n:row><n:row><n:a>2</n:a></n:row></n:root>",
        "leaves.xml": "<root><meta><k>p</k><k>q</k></meta><row i='7'><a>1</a></row>\n<row><a>2</a><a>3</a><c/><d u='x'>4</d><d><d>5</d></d></row></root>",
        "cdata.xml": "<root><!-- <rec><x></x></rec> --><row><a><![CDATA[x < y </z> & z]]></a></row><row><a>2</a></row></root>",
        "flat.xml": "<rec><a>1</a><b>2</b></rec>", "long.xml": "<list>" + "".join(f"<e n='{k}'><v>{'w' * (k % 50)}x</v></e>\n" for k in range(400)) + "</list>",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in sizes:
            spark.conf.set(k, "256")
        got = {}
        for r in FS.read_xml_groups(spark, str(tmp_path)).collect():
            got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["row_idx"], r["name"], r["value"]))
        assert FS.read_xml_groups(spark, str(tmp_path), "no*").count() == 0
    finally:
        for k, v in sizes.items():
            spark.conf.set(k, v)
    long = [(k, n, v) for k in range(400) for n, v in (("_n", str(k)), ("v", "w" * (k % 50) + "x"))]
    assert {k: sorted(v) for k, v in got.items()} == {
        "one.xml": [(0, "a", "1"), (0, "b", "éA'")], "a%20prefix.xml": [(0, "a", "1"), (1, "a", "2")],
        "leaves.xml": [(0, "_i", "7"), (0, "a", "1"), (1, "a", "2"), (1, "a", "3"), (1, "c", ""), (1, "d", "4"), (1, "d._u", "x"), (1, "d.d", "5")], "cdata.xml": [(0, "a", "x < y </z> & z"), (1, "a", "2")],
        "flat.xml": [(0, "a", "1"), (0, "b", "2")], "long.xml": sorted(long),
    }


def test_xml_tags_are_counted_without_a_sort(spark, tmp_path, monkeypatch):
    """What a task holds follows the element names, not the elements: the aggregate over the pieces is by hash."""
    (tmp_path / "a.xml").write_text("<r><head><t>x</t></head>" + "".join(f"<row><k>{k}</k></row>" for k in range(3000)) + "</r>")
    plans, write = [], FS.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(FS, "written", seen)
    assert [r["tag"] for r in FS.xml_row_tags(spark, str(tmp_path)).collect()] == ["row"]
    lowest = [line for line in plans[0].splitlines() if "Aggregate" in line][-1]
    assert "HashAggregate" in lowest
