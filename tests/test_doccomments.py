"""Documentation comments, code-only detectors, projections and lists that stay rows."""

from pyspark.sql import functions as F

from tessaline.functions import scalars
from tessaline.operators import calls, diff, doccomments, graph, ranking, rules

SOURCE = """Option Explicit
''' Adds up what a depot holds.
'''
''' Counts closed days too.
'''
''' Args:
'''     depot: Where to look.
'''     upTo: Last day.
''' Returns:
'''     The sum.
'''       indented
''' See  Also:
'''     Nowhere
Public Function Total(ByVal depot As String, Optional upTo As Date) As Double
End Function
''' Args:
'''     naem: one letter turned.
'''     Name: right.
'''     NAME: again.
'''     zzz: far off.
''' Returns:
'''     nothing, as it is a Sub.
'@Description("Says ""hello"".")

Private Sub Greet(name As String)
End Sub
''' Belongs to nothing.
x = 1
'''"""


def test_blocks_and_what_is_wrong_with_them(spark):
    docs = spark.createDataFrame([("a", SOURCE), ("b", None), ("c", "Sub S()\nEnd Sub")], "file string, text string")
    found = {r.start_line: r for r in doccomments.doc_blocks(docs, ["file"], "text").collect()}
    assert sorted(found) == [2, 16, 27, 29]
    a = found[2]
    assert (a.end_line, a.declaration_line, a.name, a.kind, a.parameters) == (13, 14, "Total", "function", ["depot", "upTo"])
    assert (a.summary, a.body) == ("Adds up what a depot holds.", "Counts closed days too.")
    assert [tuple(x) for x in a.args] == [("depot", "Where to look."), ("upTo", "Last day.")] and a.sections == {"returns": "The sum.\n  indented", "see also": "Nowhere"}
    b = found[16]
    assert (b.declaration_line, b.name, b.kind, b.summary) == (25, "Greet", "sub", 'Says "hello".')
    assert found[27].declaration_line is None and found[29].summary == ""
    wrong = {(r.line, r.code, r.name, r.suggestion) for r in doccomments.validate(doccomments.doc_blocks(docs, ["file"], "text"), ["file"]).collect()}
    assert wrong == {(16, "VB040", "naem", "name"), (16, "VB041", "NAME", None), (16, "VB040", "zzz", None), (16, "VB042", "Greet", None), (27, "VB043", None, None), (29, "VB043", None, None)}


def test_statements_and_code_only_detectors(spark):
    lines = ["a = 1: b = \"x:y\"\"z\" :: c", "' all: comment", "", "Label:", 'd = "open ', None]
    got = [[tuple(s) for s in r[0]] if r[0] is not None else None for r in spark.createDataFrame([(x,) for x in lines], "line string").select(scalars.statements(F.col("line"))).collect()]
    assert got == [[(1, "a = 1"), (8, 'b = "x:y""z"'), (24, "c")], [], [], [(1, "Label")], [(1, 'd = "open')], None]
    docs = spark.createDataFrame([("f", "MsgBox 1\nx = \"MsgBox\" ' MsgBox\n' MsgBox\nMsgBox 2 ' quiet")], "file string, text string")
    hits = lambda **kw: sorted(r.line_no for r in rules.detect_lines(docs, ["file"], "text", {"D": "MsgBox"}, **kw).collect())
    assert hits() == [1, 2, 3, 4] and hits(code_only=True) == [1, 4] and hits(code_only=True, ignore={"D": "quiet"}) == [1, 4]


def test_what_the_compiler_would_say(spark):
    diagnostics = spark.createDataFrame([("f", "L1", 5), ("f", "L2", 700), ("f", "A1", 12), ("f", "no", 5), ("g", "L1", 5)], "file string, code string, line int")
    catalogue = spark.createDataFrame([("L1", "lint", ["lint", "analyze"], True, True, "error"), ("L2", "lint", ["lint"], True, False, "warning"), ("A1", "flow", ["analyze"], True, True, "hint")], "code string, family string, surfaces array<string>, compile_equivalent boolean, preflight_blocking boolean, default_severity string")
    procedures = spark.createDataFrame([("f", "Outer", 1, 900), ("f", "Inner", 10, 20), ("f", "Late", 901, 950)], "file string, name string, start_line int, end_line int")
    got = {(r.file, r.code): (r.severity, r.procedure, r.analyze, r.preflight) for r in rules.compile_equivalent(diagnostics, catalogue, procedures, ["file"]).collect()}
    assert got == {("f", "L1"): ("error", "Outer", True, True), ("f", "L2"): ("warning", "Outer", False, False), ("f", "A1"): ("hint", "Outer", True, False), ("g", "L1"): ("error", None, True, True)}


def test_edges_that_are_scanned_and_names_that_are_asked(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (2, 3, "c"), (3, 4, "d"), (5, 1, "e"), (6, 5, "f")], "src long, dst long, at string")
    one = spark.createDataFrame([(1,)], "node long")
    seen = lambda direction, depth: "".join(sorted(r["at"] for r in graph.scanned_edges(one, edges, direction, depth).collect()))
    assert (seen("callees", 0), seen("callees", 1), seen("callees", 2), seen("callees", 3)) == ("", "a", "abc", "abcd")
    assert (seen("callers", 1), seen("callers", 2), seen("both", 1), seen("both", 2)) == ("be", "abef", "abe", "abcef")
    symbols = spark.createDataFrame([("Run", 1), ("run", 2), ("Stop", 3)], "name string, node long")
    got = sorted((r.name, r.status, r.node or 0) for r in graph.targets(spark.createDataFrame([("RUN",), ("stop",), ("go",)], "name string"), symbols, "name").collect())
    assert got == [("RUN", "ambiguous", 1), ("RUN", "ambiguous", 2), ("go", "missing", 0), ("stop", "matched", 3)]


def test_lists_totals_and_roots(spark):
    want, got = (spark.createDataFrame(x, "rule string, line int") for x in ([("A", 1), ("A", 1), ("A", 2), (None, 9)], [("A", 1), ("A", 5), ("A", 4), ("B", 7)]))
    rows = {(r.rule, r.line): (r.kind, r.n, r.place, r.missing, r.unexpected) for r in diff.delta_rows(diff.multiset_delta(want, got), ["rule"], ["line"]).collect()}
    assert rows == {("A", 1): ("missing", 1, 1, 2, 2), ("A", 2): ("missing", 1, 2, 2, 2), ("A", 4): ("unexpected", 1, 1, 2, 2), ("A", 5): ("unexpected", 1, 2, 2, 2), (None, 9): ("missing", 1, 1, 1, 0), ("B", 7): ("unexpected", 1, 1, 0, 1)}
    gone = spark.createDataFrame([(5, False), (7, True), (9, None)], "size long, failed boolean")
    assert tuple(ranking.removal_totals(gone, "size", "failed").first()) == (3, 1, 14) and tuple(ranking.removal_totals(gone.limit(0), "size", "failed").first()) == (0, 0, 0)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 5)], "src long, dst long")
    components = graph.strong_components(spark.createDataFrame([(n,) for n in range(1, 7)], "node long"), edges)
    accesses = spark.createDataFrame([("f", 3, "read"), ("f", 3, "read"), ("f", 5, "write"), ("g", 6, "read")], "field string, procedure long, kind string")
    roots = spark.createDataFrame([("main", 1), ("event", 4), ("api", 2)], "root string, node long")
    found = {(r.field, r.kind, r.root, r.cyclic) for r in calls.state_roots(accesses, edges, roots, components, ["field"]).collect()}
    assert found == {("f", "read", "main", True), ("f", "read", "api", True), ("f", "write", "event", False)}
