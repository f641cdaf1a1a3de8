"""License scans against a plain version, with nulls, ties, empties, long texts and clashing names."""

import re
from collections import Counter

from tessaline.llm import licenses

MIT = licenses.TEMPLATES["MIT-permission"]
WARRANTY = licenses.TEMPLATES["MIT-warranty"]


def plain(text, templates=licenses.TEMPLATES, at_least=0.8):
    lines = [" ".join(re.findall("[a-z0-9]+", line.lower())) for line in (text or "").split("\n")]
    parts = [p for p in re.split("\n\n+", "\n".join(lines).strip("\n"))]
    units = lines + ([" ".join(x for x in lines if x)] if len(lines) > 1 else [])
    units += [p.replace("\n", " ") for p in parts if "\n" in p] if len(parts) > 1 else []
    bigrams = lambda t: Counter(zip(t.split(), t.split()[1:], strict=False))
    units = [b for u in units if (b := bigrams(u))]
    names, dices = [], []
    for b in units:
        each = []
        for name, t in templates.items():
            c = bigrams(" ".join(re.findall("[a-z0-9]+", t.lower())))
            each.append((-2 * (b & c).total() / (b.total() + c.total()), name))
        if each and -min(each)[0] >= at_least:
            names.append(min(each)[1])
            dices.append(-min(each)[0])
    return len(units), len(names), ",".join(sorted(set(names))), round(max(dices), 6) if dices else None


def wrapped(text, width, mark):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join(mark + x for x in [*lines, line])


TEXTS = [
    None,
    "",
    "\n\n",
    "licensed",
    "All rights reserved.",
    "all   RIGHTS reserved\nall rights reserved",
    "Released under the MIT license\nand more of it than that line says",
    "This work is licensed under the GNU General Public License, version 3!",
    wrapped(MIT, 70, "# ") + "\n#\n" + wrapped(WARRANTY, 70, "# ") + "\n\nimport os\nprint(1)",
    "MIT License\n\nCopyright (c) 2020 X\n\n" + wrapped(MIT, 78, "") + "\n\n" + wrapped(WARRANTY, 78, ""),
    "x = 1\n\n" + wrapped(licenses.TEMPLATES["Zlib-text"], 60, "// ") + "\n\ny = 2",
    wrapped(licenses.TEMPLATES["BSD-2-Clause-text"], 79, " * ").replace("HOLDER", "OWNER"),
    ("word other words " * 40_000) + "\nLicensed under CC BY-SA 4.0.",
    "É licensed under CC BY NC 4.0",
    "Unless required by law\n" + licenses.TEMPLATES["Apache-2.0-header"],
]


def test_scan_matches_plain(spark):
    rows = [(i, t, "x", i, 0, [i]) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "x", 1, 0, None), (4, TEXTS[4], "x", 1, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, unit string, row_no int, template int, pairs array<int>")
    got = licenses.scan(docs)
    assert got.columns == ["doc_id", "n_units", "n_matches", "licenses", "best_dice"]
    want = [(i, *plain(t)) for i, t, *_ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any("MIT-permission" in w[3] and "MIT-warranty" in w[3] for w in want) and any("Zlib-text" in w[3] for w in want) and any("BSD-2-Clause-text" in w[3] for w in want)


def test_no_rows_and_no_templates(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.")], "doc_id long, text string")
    assert licenses.scan(docs.limit(0)).count() == 0
    assert [tuple(r) for r in licenses.scan(docs, {}).collect()] == [(1, 1, 0, "", None)]
