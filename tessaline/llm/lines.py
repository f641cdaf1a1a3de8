"""Fuzzy line dedup: MinHash, banding, exact Jaccard, components, one line of each kept.

A line's signature is taken over all its character shingles (SHINGLE code points each);
lines that agree in a band are candidates, and a pair counts if the Jaccard similarity of
the same shingles is SIMILARITY or more. Only column functions are used.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.llm.words import WORD
from tessaline.operators.components import connected_components

SIMILARITY = 0.8
SHINGLE = 5
#: A signature is a square of GRID * GRID minima; its rows and its lines of SLOPES slopes,
#: wrapped, are the bands. Two bands hardly share minima, so a pair right at SIMILARITY
#: agrees in some band with probability 0.99, one at 0.9 with 0.9998.
GRID, SLOPES = 5, 3
#: Minima that a candidate pair must share before its texts are compared; a pair right at
#: SIMILARITY shares fewer with probability 0.0015.
AGREE = 14
#: Members of a bucket that are all paired. Lines of larger ones are banded anew by further
#: squares, each wider by WIDER, so pairs that are less similar part (0.997, 0.98 and 0.92 at SIMILARITY).
ALL_PAIRS = 128
WIDER = 3
#: Times that lines are banded anew; what is large even then is paired in blocks of BLOCK members.
LEVELS = 3
BLOCK = 64
#: Shingles that a row hashes before its minima meet those of its line's other rows.
STEP = 4
#: Words of 64 bits in a bitmap of a line's shingles.
BITMAP = 32
#: Rows of one long that may be broadcast.
IDS = 1_000_000


def _masks(n: int, seed: int = 5) -> list[int]:
    """n random numbers of 64 bits, signed."""
    rng = random.Random(seed)
    return [rng.getrandbits(64) - (1 << 63) for _ in range(n)]


def _bands(grid: int) -> list[list[int]]:
    """The places of a square's rows and lines."""
    side = range(grid)
    return [[grid * i + j for j in side] for i in side] + [[grid * j + (i + slope * j) % grid for j in side] for slope in range(SLOPES) for i in side]


def _last(code_points: Column, size: int = SHINGLE) -> Column:
    """Where a line's last shingle begins, from 1: code_points has four bytes for each; a shorter line is its own shingle."""
    return F.greatest(F.floor(F.length(code_points) / 4).cast("int") - size + 1, F.lit(1))


def _hashed(code_points: Column, place: Column, size: int = SHINGLE) -> Column:
    return F.xxhash64(F.substring(code_points, place * 4 - 3, F.lit(4 * size)))


def shingles(line: Column, size: int = SHINGLE) -> Column:
    """The hashes of the distinct character shingles of a line."""
    # the outer transform binds the code points, which the inner one would work out anew for each place
    cut = lambda b: F.array_distinct(F.transform(F.sequence(F.lit(1), _last(b, size)), lambda p: _hashed(b, p, size)))
    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), cut), F.lit(0))


def alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether the Jaccard similarity of two sets reaches the threshold."""
    return F.size(F.array_intersect(a, b)) * (1 + similarity) >= similarity * (F.size(a) + F.size(b)) - 1e-9


def _occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, line_no (from 0) and line of the lines that have a word."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(WORD))


def _places(texts: DataFrame) -> DataFrame:
    """texts (id, line, perhaps doc_id) with STEP shingle hashes h0, h1, ... a row instead of line; p is the first one's place in the line, from 1.

    Shingles are cut out of four-byte code points, so a place is found at once, and a row
    takes STEP of them (the last one again where a line ends), since to look its line up
    costs more than to hash one.
    """
    others = [c for c in texts.columns if c != "line"]
    rows = texts.select(*others, F.encode("line", "UTF-32").alias("b"))
    rows = rows.select(*others, "b", F.explode(F.sequence(F.lit(1), _last(F.col("b")), F.lit(STEP))).alias("p"))
    return rows.select(*others, "p", *(_hashed(F.col("b"), F.least(F.col("p") + k, _last(F.col("b")))).alias(f"h{k}") for k in range(STEP)))


def _banded(rows: DataFrame, also: list[Column], seed: int = 5, grid: int = GRID) -> DataFrame:
    """id, also, minima, bands of rows (id, h0, h1, ... of its shingles), a row per id.

    also are further aggregates. Each mask gives a shingle's hash two new ones of 32 bits,
    so every minimum has a permutation of its own. Minima are taken by a plain aggregate
    before and after the shuffle; no text and no shingle is shuffled, and a line that is
    everywhere is one row from each task.
    """
    hashes = [c for c in rows.columns if c[0] == "h"]
    least = lambda x: F.least(*x) if len(x) > 1 else x[0]
    mixed = [[F.xxhash64(F.col(h).bitwiseXOR(F.lit(m))) for h in hashes] for m in _masks((grid * grid + 1) // 2, seed)]
    halves = [half for m in mixed for half in (least([F.shiftrightunsigned(x, 32) for x in m]), least([x.bitwiseAND(F.lit(0xFFFFFFFF)) for x in m]))]
    signed = rows.groupBy("id").agg(*also, *(F.min(h).alias(f"m{k}") for k, h in enumerate(halves[: grid * grid])))
    minima = F.array(*((F.col(f"m{k}") - F.lit(1 << 31)).cast("int") for k in range(grid * grid)))
    return _with_bands(signed.withColumn("minima", minima).drop(*(f"m{k}" for k in range(grid * grid))), grid)


def _with_bands(signed: DataFrame, grid: int = GRID) -> DataFrame:
    """signed with the bands of its minima.

    One short expression runs over the bands' places: one for each band makes generated
    code that is too long for the JVM to compile.
    """
    places = F.array(*(F.array(*(F.lit(k) for k in band)) for band in _bands(grid)))
    hashed = lambda at, no: F.xxhash64(no, *(F.get("minima", F.get(at, F.lit(k))) for k in range(grid)))
    return signed.withColumn("bands", F.transform(places, hashed))


def _signed(found: DataFrame) -> DataFrame:
    """id, first_doc, n, minima, bands of the distinct lines of found."""
    return _banded(_places(found.select(F.xxhash64("line").alias("id"), "line", "doc_id")), [F.min("doc_id").alias("first_doc"), F.count_if(F.col("p") == 1).alias("n")])


def _buckets(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of a bucket's first and another member, and the members (band, n, id) of buckets with more than two.

    keys has band and id, and component where lines are connected already; then a bucket of
    one component is left out, and the first is paired with members of others only.
    """
    known = "component" in keys.columns
    ends = [F.min("component").alias("c"), F.max("component").alias("d"), F.min_by("component", "id").alias("lo_component")] if known else []
    shared = keys.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), *ends)
    shared = storage.save(shared.where("n > 1 AND c <> d" if known else "n > 1"), "buckets")
    members = storage.save(keys.join(storage.broadcast_if_small(shared.where("n > 2").drop("hi", "c", "d"), IDS), "band"), "members")
    pairs = shared.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    return pairs.union(members.where("component <> lo_component" if known else "id <> lo").select("lo", "id")), members.select("band", "n", "id")


def _agree(a: Column, b: Column) -> Column:
    """Whether two marks share AGREE minima; each of their longs holds seven of them in bytes of seven bits."""
    packed = -(-GRID * GRID // 7)
    differ = lambda k: F.bit_count((F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))) + F.lit(0x7F7F7F7F7F7F7F)).bitwiseAND(F.lit(0x80808080808080)))
    return reduce(add, map(differ, range(packed))) <= GRID * GRID - AGREE


def _mark(minima: Column) -> Column:
    """Seven bits of each minimum, which tell nearly as well whether two agree; bytes that are left over are zero."""
    part = lambda k: F.shiftleft(F.get(minima, F.lit(k)).bitwiseAND(F.lit(127)).cast("long"), 8 * (k % 7))
    return F.array(*(reduce(add, (part(k) for k in range(at, min(at + 7, GRID * GRID)))) for at in range(0, GRID * GRID, 7)))


@dataclass(frozen=True)
class Judged:
    """How pairs are judged: kept is made of a line once and stored, shingles gives its set of hashes, rows deals those of a table (id, line) out as (id, h0, ...), agree tells from two marks whether a pair can be worth while, and wider is by how much each further square is."""

    kept: Callable[[Column], Column] = lambda line: line
    shingles: Callable[[Column], Column] = shingles
    rows: Callable[[DataFrame], DataFrame] = _places
    agree: Callable[[Column, Column], Column] = _agree
    wider: int = WIDER


def _texts(ids: DataFrame, found: DataFrame, judged: Judged) -> DataFrame:
    """id, line (what is kept of it) of the distinct ids; the texts come from a pass over found (line)."""
    texts = found.select(F.xxhash64("line").alias("id"), "line").join(storage.broadcast_if_small(ids, IDS), "id", "left_semi")
    return storage.save(texts.groupBy("id").agg(F.any_value("line").alias("line")).select("id", judged.kept(F.col("line")).alias("line")), "texts")


def _bitmaps(rows: DataFrame) -> DataFrame:
    """id, bits of rows (id, h0, ...): n, how many hashes there are at most, and a bitmap of them in words w0, w1, ..."""
    hashes = [c for c in rows.columns if c[0] == "h"]
    # all words in one aggregate: a line's rows are in one task, so that the shuffle takes a row for each line
    word, bit = "{0} & %d AS at_{0}" % (BITMAP - 1), "shiftleft(1L, CAST({0} >> 5 & 63 AS INT)) AS bit_{0}"
    rows = rows.selectExpr("id", *(x.format(h) for h in hashes for x in (word, bit)))
    of = lambda k: reduce(Column.bitwiseOR, (F.when(F.col(f"at_{h}") == k, F.col(f"bit_{h}")).otherwise(F.lit(0).cast("long")) for h in hashes))
    rows = rows.groupBy("id").agg((F.count("*") * len(hashes)).alias("n"), *(F.bit_or(of(k)).alias(f"w{k}") for k in range(BITMAP)))
    return rows.select("id", F.struct("n", *(f"w{k}" for k in range(BITMAP))).alias("bits"))


def _can_be_alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether two sets' bits leave room for that Jaccard similarity; true of all that reach it.

    A bit of one bitmap alone is a hash of that set alone at least, so what is counted in
    one only is no more than there is, and what may be common no less.
    """
    alone = lambda x, y: reduce(add, (F.bit_count(x[f"w{k}"].bitwiseAND(F.bitwise_not(y[f"w{k}"]))) for k in range(BITMAP)))
    left, right = alone(a, b), alone(b, a)
    return F.least(a["n"] - left, b["n"] - right) * (1 - similarity) >= similarity * (left + right) - 1e-9


def _worth(a: Column, b: Column, judged: Judged, similarity: float, marked: bool) -> Column:
    """Whether a pair of rows (mark, if marked, and bits) is to be compared."""
    bound = _can_be_alike(a["bits"], b["bits"], similarity)
    return judged.agree(a["mark"], b["mark"]) & bound if marked else bound


def _in_blocks(members: DataFrame, block: int, worth: Callable[[Column, Column], Column]) -> DataFrame:
    """The pairs (a, b) of members (band, n, id, component, mark, bits) in a bucket that are of two components and worth while.

    Pairs of blocks are the unit of work; a pair becomes a row only if it passes.
    """
    dealt = members.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    units = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    row = F.struct("id", "component", "block", *(c for c in ("mark", "bits") if c in members.columns))
    met = dealt.select("band", row.alias("r"), F.explode(units).alias("u")).groupBy("band", "u").agg(F.collect_list("r").alias("m"))
    asked = lambda a: F.filter("m", lambda b: (b["id"] > a["id"]) & (a["component"] != b["component"]) & ((F.col("u.i") == F.col("u.j")) | (a["block"] != b["block"])) & worth(a, b))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(asked(a), lambda b: F.struct(a["id"].alias("a"), b["id"].alias("b")))))
    return met.select(F.explode(pairs).alias("p")).select("p.*")


def _distinct(pairs: DataFrame) -> DataFrame:
    return storage.save(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def _of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows (id, ...) that pairs (a, b) name; others would be shuffled for nothing."""
    ids = storage.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
    return rows.join(storage.broadcast_if_small(ids, IDS), "id", "left_semi")


def _plausible(pairs: DataFrame, marks: DataFrame, worth: Callable[[Column, Column], Column]) -> DataFrame:
    """The pairs (a, b) whose marks (id, ...) are worth comparing."""
    marks = _of(marks, pairs)
    left, right = (marks.select(F.col("id").alias(k), F.struct(*(c for c in marks.columns if c != "id")).alias(f"{k}_mark")) for k in "ab")
    return storage.save(pairs.join(left, "a").join(right, "b").where(worth(F.col("a_mark"), F.col("b_mark"))).select("a", "b"), "plausible")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingles: Callable[[Column], Column]) -> DataFrame:
    """The pairs (a, b) whose lines, in texts (id, line), have shingles that similar."""
    texts = _of(texts, pairs)
    left, right = (texts.select(F.col("id").alias(k), F.col("line").alias(f"{k}_line")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", shingles(F.col("a_line")).alias("x"), shingles(F.col("b_line")).alias("y"))
    # exploding keeps the test above the columns x and y: a filter would be pushed below and work them out again for each use
    return storage.save(both.select(F.explode(F.when(alike(F.col("x"), F.col("y"), similarity), F.array(F.struct("a", "b")))).alias("p")).select("p.*"), "similar")


def _narrowed(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a written table that ids (id) name, written in its place."""
    found = storage.save(table.join(ids, "id", "left_semi"), "narrowed")
    storage.drop(table)
    return found


def similar(lines: DataFrame, found: DataFrame, similarity: float = SIMILARITY, judged: Judged = Judged()) -> DataFrame:  # noqa: B008
    """Edges (a, b) that connect what the candidates among lines (id, bands, perhaps mark) connect.

    Every member of a bucket is compared with the bucket's first. Lines that are then in
    one component, by whatever bucket, are connected already, so only pairs of two
    components are compared after that. In buckets of up to ALL_PAIRS they all are, of
    which those that can't be similar by their marks and bitmaps never leave their block.
    Lines of larger ones of several components are banded anew by more minima a band, and
    the new buckets are treated in the same way. What is large after LEVELS times is paired
    whole, in blocks. The texts of pairs whose marks agree and of members of buckets of more
    than two are fetched once. ids are hashes of found's lines.
    """
    keys, joined, texts, marks = lines.select("id", F.explode("bands").alias("band")), None, None, None
    worth = lambda a, b: _worth(a, b, judged, similarity, "mark" in lines.columns)
    for level in range(LEVELS + 1):
        with storage.passing() as keep:
            pairs, members = _buckets(keys)
            pairs = _distinct(pairs)
            if texts is None:
                if "mark" in lines.columns:  # most pairs go by their marks, which need no texts
                    pairs = _plausible(pairs, lines.select("id", "mark"), lambda a, b: judged.agree(a["mark"], b["mark"]))
                ids = storage.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(members.select("id")).distinct(), "ids")
                texts = _texts(ids, found, judged)
                marks = _bitmaps(judged.rows(texts))
                if "mark" in lines.columns:
                    marks = marks.join(lines.select("id", "mark"), "id")
                marks = storage.save(marks, "marks")
            with storage.passing() as verified:
                verified.append(_verified(_plausible(pairs, marks, worth), texts, similarity, judged.shingles))
            first = verified[0]
            with storage.passing() as stars:
                stars.append(storage.save(connected_components(first if joined is None else edges.union(first)).withColumnRenamed("node", "id"), "joined"))
            storage.drop(joined)
            joined = stars[0]
            edges = joined.select(F.col("id").alias("a"), F.col("component").alias("b"))
            marked = storage.save(members.join(joined, "id", "left").select("band", "n", "id", F.coalesce("component", "id").alias("component")), "marked")
            unsettled = marked.groupBy("band").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("band")
            open_ = storage.save(marked.join(storage.broadcast_if_small(storage.save(unsettled, "unsettled")), "band", "left_semi"), "open")
            large = F.col("n") > ALL_PAIRS if level < LEVELS else F.lit(False)
            with storage.passing() as verified:
                met = _distinct(_in_blocks(open_.where(~large).join(marks, "id"), BLOCK, worth))
                verified.append(_verified(met, texts, similarity, judged.shingles))
            others = verified[0]
            edges = edges.union(others)
            rest = open_.where(large)
            more = rest.limit(1).count() > 0
            if more:
                named = storage.save(rest.select("id", "component").distinct(), "rest")
                asked = storage.broadcast_if_small(named.select("id"), IDS)
                if 2 * named.count() <= texts.count():  # further levels ask for no others
                    texts, marks = _narrowed(texts, asked), _narrowed(marks, asked)
                cut = storage.save(_banded(judged.rows(texts.join(asked, "id", "left_semi")), [], 100 + level, GRID + judged.wider * (level + 1)).select("id", "bands"), "cut")
                keys = named.join(cut, "id").select("id", "component", F.explode("bands").alias("band"))
                keep += [named, cut]
            keep += [marks, texts, joined, others]
        if not more:
            break
    return edges


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, dropped (line numbers from 0, ascending) of the texts that lose lines.

    Of each component of equal or similar lines one stays: the line whose first document
    has the smallest id, then the smallest hash, where it stands first in that document.
    Lines without a word are never dropped. A null id comes after all others. Rows that
    agree in id and text are one document, so each keeps what one would.
    """
    with storage.passing() as keep:
        found = _occurrences(docs, doc_id, text)
        lines = storage.save(_signed(found).drop("bands"), "lines")
        roots = connected_components(similar(_with_bands(lines).select("id", "bands", _mark(F.col("minima")).alias("mark")), found, similarity)).withColumnRenamed("node", "id")
        acted = storage.save(lines.select("id", "first_doc", "n").join(storage.broadcast_if_small(roots), "id", "left").where("n > 1 OR component IS NOT NULL").select("id", "first_doc", F.coalesce("component", "id").alias("root")), "acted")
        storage.drop(lines)
        stays = storage.save(acted.groupBy("root").agg(F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "id"))["id"].alias("stays")), "stays")
        acts = storage.save(acted.join(storage.broadcast_if_small(stays), "root").select("id", F.when(F.col("id") == F.col("stays"), F.struct(F.col("first_doc").alias("doc_id"))).alias("keep")), "acts")
        hits = found.select("doc_id", "text_hash", "line_no", F.xxhash64("line").alias("id")).join(storage.broadcast_if_small(acts, IDS), "id")
        first = F.col("line_no") == F.min("line_no").over(Window.partitionBy("doc_id", "text_hash", "id"))
        lost = hits.withColumn("first", first).where(~(F.col("first") & F.coalesce(F.struct("doc_id") == F.col("keep"), F.lit(False))))
        keep.append(storage.save(lost.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("dropped")), "dropped"))
    return keep[0]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs with their texts less the dropped lines, all columns as they were.

    A null text stays null, an empty one empty; a text whose lines all go is empty.
    """
    key, hashed, dropped = storage.fresh(docs, "_key", "_hash", "_dropped")
    gone = decide(docs, doc_id, text, similarity).toDF(key, hashed, dropped)
    if sum(gone.agg(F.count("*"), F.coalesce(F.sum(F.size(dropped)), F.lit(0))).first()) <= IDS:  # rows and numbers: some 40 MB at most
        gone = F.broadcast(gone)
    rows = docs.join(gone, docs[doc_id].eqNullSafe(gone[key]) & (F.xxhash64(docs[text]) == gone[hashed]), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(dropped, i)), "\n")
    return rows.select(*(F.when(F.col(dropped).isNull(), F.col(c)).otherwise(left).alias(c) if c == text else docs[c] for c in docs.columns))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers, comma-joined) of each row of docs.

    A null text has no lines, an empty one has one. Repeated ids and rows each give a row.
    Other columns are not read; an empty table gives no rows.
    """
    gone = decide(docs, doc_id, text, similarity)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.alias("r").join(gone.alias("g"), F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.text_hash") == F.col("g.text_hash")), "left")
    n = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return rows.select("r.doc_id", "n_lines", n.alias("n_dropped"), F.coalesce(F.array_join(F.transform("dropped", lambda i: i.cast("string")), ","), F.lit("")).alias("dropped"))
