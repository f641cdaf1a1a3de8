import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessaline.operators import graph, regions, rules
from tessaline.sources import files, sinks, workbooks
from tessaline.streaming import events

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


@pytest.fixture
def book(tmp_path):
    """Three sheets in another order than their parts, a column that is one shared formula, and an array formula."""
    column = "".join(f'<row r="{r}"><c r="E{r}"><f t="shared"{" ref=" + chr(34) + "E11:E16" + chr(34) if r == 11 else ""} si="5">{"D11%7" if r == 11 else ""}</f></c></row>' for r in range(11, 17))
    sheets = {
        "plan": f'<sheetData>{column}</sheetData><mergeCells count="2"><mergeCell ref="B2:D3"/><mergeCell ref="F9:F12"/></mergeCells>',
        "raw": '<sheetData><row r="4"><c r="A4" t="s"><v>2</v></c><c r="B4" t="b"><v>1</v></c></row></sheetData>',
        "calc": '<sheetData><row r="7"><c r="H7"><f t="array" ref="H7:H9">plan!E11:E13*2</f><v>4</v></c><c r="J7"><f>NOW()</f></c></row></sheetData>',
    }
    order = [("Überblick", "calc", ""), ("Plan 24", "plan", ""), ("Rohdaten", "raw", ' state="veryHidden"')]
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        names = "".join(f'<sheet name="{name}" sheetId="{k + 4}"{state} r:id="x{k}"/>' for k, (name, _, state) in enumerate(order))
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>{names}</sheets><definedNames><definedName name=\"quota\" hidden=\"1\">0.19</definedName><definedName name=\"Area\" localSheetId=\"2\">Rohdaten!$A$4:$B$4 </definedName></definedNames></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="x{k}" Target="worksheets/{part}.xml"/>' for k, (_, part, _) in enumerate(order)) + "</Relationships>")
        for part, body in sheets.items():
            z.writestr(f"xl/worksheets/{part}.xml", f"<worksheet {NS}>{body}</worksheet>")
    return str(tmp_path)


def test_workbook(spark, book):
    parts = workbooks.parts(spark, book)
    assert {(r.name, r.path, r.state) for r in workbooks.sheets(parts).collect()} == {("Überblick", "xl/worksheets/calc.xml", "visible"), ("Plan 24", "xl/worksheets/plan.xml", "visible"), ("Rohdaten", "xl/worksheets/raw.xml", "veryHidden")}
    assert {(r.name, r.formula, r.local_sheet_id, r.hidden) for r in workbooks.defined_names(parts).collect()} == {("quota", "=0.19", None, True), ("Area", "=Rohdaten!$A$4:$B$4", 2, False)}
    cells = workbooks.formula_cells(parts)
    assert {(r.sheet, r.row, r.col, r.kind, r.formula) for r in cells.collect() if r.shared_index is None} == {("Überblick", 7, 8, "array", "=plan!E11:E13*2"), ("Überblick", 7, 10, "normal", "=NOW()")}
    made = regions.regions(regions.shared_cells(cells.select("sheet", "row", "col", "kind", "shared_index", "shared_ref", "formula"))).collect()
    assert {(r.sheet, r["range"], r["count"]) for r in made} == {("Plan 24", "E11:E16", 6), ("Überblick", "H7", 1), ("Überblick", "J7", 1)}
    assert workbooks.cells(parts).count() == 10 and sorted(r.ref for r in workbooks.merged_ranges(parts).collect()) == ["B2:D3", "F9:F12"]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/m.bas").write_bytes(b"a\r\nb\r\n")
    (tmp_path / "src/n.txt").write_text("no")
    assert [tuple(r) for r in files.source_files(spark, str(tmp_path / "src")).collect()] == [("m.bas", "a\nb\n")]
    sheets = spark.createDataFrame([(0, "A b"), (1, "x"), (2, "x")], "index int, name string")
    assert [r.path for r in sinks.sheet_paths(sheets.withColumn("index", F.lit(1))).orderBy("path").collect()] == ["001-A-b", "001-x", "001-x-2"]
    sinks.write_jsonl(sheets, str(tmp_path / "out"))
    assert files.jsonl(spark, str(tmp_path / "out"), sheets.schema).count() == 3
    (tmp_path / "bad.jsonl").write_text('{"index": 1}\nnope\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.jsonl(spark, str(tmp_path / "bad.jsonl"), sheets.schema).collect()
    with pytest.raises(ValueError, match="not written"):
        sinks.write_checked(sheets, str(tmp_path / "no"), files.canonical(sheets, ["name"], sheets.where("index < 1")))
    sinks.write_by_sheet(sheets.select(F.col("name").alias("sheet"), "index"), sheets.where("index < 2"), str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"sheet_path=000-A-b", "sheet_path=001-x"}
    assert json.loads(sinks.envelope(sheets, "list").first().json)["command"] == "list"


def test_directives_and_expectations(spark):
    docs = spark.createDataFrame([("f", "x = 1 ' zap:disable-line R1, r2\n' zap:disable-next-line R3\ny")], "file string, text string")
    assert {tuple(r)[1:] for r in rules.directives(docs, ["file"], "text", "zap").collect()} == {(1, 1, "line", "R1"), (1, 1, "line", "R2"), (2, 3, "next-line", "R3")}
    expected = spark.createDataFrame([("f", "A", None), ("f", None, "x"), ("g", "A", "q")], "file string, code string, severity string")
    actual = spark.createDataFrame([("f", "A", "x"), ("f", "A", "y"), ("g", "B", "q")], "file string, code string, severity string")
    assert {tuple(r) for r in rules.match_expectations(expected, actual, ["file"], ["code", "severity"]).collect()} == {("f", 2, 2, 2), ("g", 1, 1, 0)}
    findings = spark.createDataFrame([("f", "GEN", 1, 9), ("f", "SPEC", 4, 4), ("g", "GEN", 1, 9)], "file string, code string, s int, e int")
    assert rules.recovered(findings, F.col("code") == "GEN", ["file"], "s", "e").count() == 2


def test_strong_components_of_loops_and_chains(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "node long")
    got = {r.node: (r.component, r.size, r.cyclic) for r in graph.strong_components(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got[1] == got[2] == got[3] == (1, 3, True) and got[4] == got[5] == (4, 2, True)
    assert got[6] == (6, 1, True) and got[7] == (7, 1, False) and got[9] == (9, 1, False)


def run(stream, tmp_path, name):
    q = stream.option("checkpointLocation", str(tmp_path / f"ckpt-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_upsert_stream(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/table"
    schema = "k string, generation long, v string, complete boolean"
    for i, rows in enumerate([[("a", 1, "old", True), ("b", 5, "b5", True)], [("a", 2, "new", True), ("b", 4, "stale", True), ("c", 1, "half", False)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        run(events.upsert_stream(spark.readStream.schema(schema).json(str(source)), out, ["k"], "generation", "complete"), tmp_path, "upsert")
        assert events.current(spark, out) is not None and i >= 0
    assert {(r.k, r.v) for r in events.current(spark, out).collect()} == {("a", "new"), ("b", "b5")}


def test_streamed_sessions_and_last_n(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{folder}/events.parquet")
    source = tmp_path / "events"
    batch.withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    closed = events.streamed_sessions(stream, "user_id", "ts", 30, 60)
    run(closed.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "sessions")), tmp_path, "sessions")
    got = {(r.user_id, r.start_ts, r.n) for r in spark.read.parquet(str(tmp_path / "sessions")).collect()}
    want = {(r.user_id, r.start_ts, r.n) for r in events.sessions(batch.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "event_id", 30).collect()}
    assert got and len(got - want) <= 1 and len(got) >= len(want) - 5
    seen = {}
    run(events.last_n_stream(stream, "event_type", "event_id", "event_id", 20).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r.key: r for r in df.collect()})), tmp_path, "last")
    for kind, n in batch.groupBy("event_type").count().collect():
        newest = sorted(r.event_id for r in batch.where(F.col("event_type") == kind).select("event_id").collect())[-20:]
        assert seen[kind].total == n and [int(x) for x in seen[kind].latest] == newest


def test_broken_json_is_dropped(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("{oops",), ("",)], "value string")
    assert [r.a for r in events.parsed(lines, "a int").collect()] == [1]
