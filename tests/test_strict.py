"""Faults of JSON lines are named by file and line, whatever pieces the files are read in."""

import json

import pytest

from tessaline.sources import sinks, strict

SCHEMA = "project string, n int, note string"


@pytest.fixture
def pieces(spark):
    """Small pieces, so that every file is read in several."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def line(p, n, **more):
    return json.dumps({"project": p, "n": n, **more})


def test_line_numbers_over_pieces(spark, tmp_path, pieces):
    texts = {"a.jsonl": [line(f"é{k}", k) if k % 7 else "" for k in range(400)], "b.jsonl": [line("z", k, note="x" * (k % 90)) for k in range(150)], "c.jsonl": []}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n" * bool(lines))
    rows = strict.numbered_lines(spark, str(tmp_path))
    assert rows.select("file", "block").distinct().count() > 20
    got = {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in rows.collect()}
    assert got == {(name, k + 1): text for name, lines in texts.items() for k, text in enumerate(lines)}
    assert strict.strict_jsonl(spark, str(tmp_path), SCHEMA).count() == sum(bool(x) for lines in texts.values() for x in lines)


def test_faults_are_named(spark, tmp_path, pieces):
    good = [line("a", k) for k in range(60)]
    bad = {5: '{"project": "a", "n": }', 17: "[1, 2]", 23: line("a", 22, other=1), 31: '{"n": "many"}', 40: line("a", 39, note="y" * 5000), 44: "   ", 50: line("a", 3), 51: line("a", 3)}
    (tmp_path / "x.jsonl").write_text("\n".join(bad.get(k + 1, text) for k, text in enumerate(good)))
    found = strict.checked_jsonl(spark, str(tmp_path / "x.jsonl"), SCHEMA, ["project", "n"], most_bytes=4000).where("problem IS NOT NULL").collect()
    problems = {r.line_no: r.problem for r in found}
    assert set(problems) - {18, 32} == {5, 17, 23, 31, 40, 50, 51} and all(r.file.endswith("/x.jsonl") for r in found)
    assert problems[40] == "has more than 4000 bytes" and problems[23] == "has a field that isn't known: other" and all("JSON" in problems[k] for k in (5, 17, 31))
    assert problems[50] == "belongs before line 49" and problems[51] == "repeats the key of line 50"
    with pytest.raises(Exception, match=r"x\.jsonl:5: the line isn't a JSON object"):
        (tmp_path / "y").mkdir()
        (tmp_path / "y/x.jsonl").write_text("\n".join([*good[:4], bad[5], *good[5:]]))
        strict.strict_jsonl(spark, str(tmp_path / "y"), SCHEMA).collect()


def test_order_holds_across_pieces(spark, tmp_path, pieces):
    (tmp_path / "in").mkdir()
    for name in ("p", "q"):
        (tmp_path / f"in/{name}.jsonl").write_text("\n".join("\n" * (k % 40 == 3) + line("a", k) for k in range(300)))
    assert strict.strict_jsonl(spark, str(tmp_path / "in"), SCHEMA, ["project", "n"]).count() == 600
    turned = [line("a", k) for k in range(300)]
    turned[150], turned[151] = turned[151], turned[150]
    (tmp_path / "in/r.jsonl").write_text("\n".join(turned))
    wrong = strict.checked_jsonl(spark, str(tmp_path / "in"), SCHEMA, ["project", "n"]).where("problem IS NOT NULL").collect()
    assert [(r.line_no, r.problem) for r in wrong] == [(152, "belongs before line 151")]


def test_a_set_is_published_only_if_all_are_sound(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    none, some = one.limit(0), two.limit(1)
    with pytest.raises(ValueError, match="two"):
        sinks.write_checked_set({"one": (one, none), "two": (two, some)}, str(tmp_path / "set"))
    assert not (tmp_path / "set").exists()
    sinks.write_checked_set({"one": (one, none), "two": (two, none)}, str(tmp_path / "set"))
    sinks.write_checked_set({"one": (two, none)}, str(tmp_path / "set"))
    assert spark.read.json(str(tmp_path / "set/one")).count() == 5 and not (tmp_path / "set/two").exists()
