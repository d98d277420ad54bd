"""SimHash, exact and substring dedup, and decontamination against brute force."""

from __future__ import annotations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from provisio.llm import decontaminate, exact_dedup, near_copies, simhash, substring_dedup
from provisio.llm.graph import components
from provisio.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_simhash_query(spark, rows):
    assert got(QUERIES["op2_simhash_near_dedup"](spark, FOLDER), "doc_id", "fingerprint", "component_id") == brute.simhash(rows())


def test_simhash_odd_rows(docs, odd):
    assert got(simhash.near_duplicates(docs(odd)), "doc_id", "fingerprint", "component_id") == brute.simhash(odd)
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("limit", [0, 1, 3, 5])
def test_links_are_whole(spark, limit, monkeypatch):
    """Every component of a dense cluster among random fingerprints, with small blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(limit)
    fps = set(rng.integers(-(1 << 63), (1 << 63) - 1, 300).tolist())
    for base in list(fps)[:12]:
        for _ in range(40):
            flip = int(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)))
            v = (base ^ flip) & (1 << 64) - 1
            fps.add(v - (1 << 64) if v >> 63 else v)
    values = sorted(fps)
    a = np.array(values, np.int64).view(np.uint64)
    root = list(range(len(a)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[:i]) <= limit).tolist():
            root[find(i)] = find(j)
    want: dict = {}
    for i, v in enumerate(values):
        want.setdefault(find(i), set()).add(v)
    distinct = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found: dict = {}
    for r in components(simhash.links(distinct, limit), "a", "b").collect():
        found.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_thresholds_sum(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, simhash.CELLS, (200, simhash.PARTS))
    counts = np.stack([np.bincount(values[:, p], minlength=simhash.CELLS) for p in range(simhash.PARTS)])
    counts[0, values[0, 0]] += 100_000
    limits = simhash.allocate(values, counts, 3)
    assert (limits.sum(axis=1) == 3 - simhash.PARTS + 1).all()
    assert limits[0, 0] == -1 and (limits >= -1).all() and (limits <= 1).all()


def test_drop_near_duplicates(docs):
    text = " ".join(f"word{i}" for i in range(400))
    near = text.replace("word17 ", "other ")
    kept = simhash.drop_near_duplicates(docs([(5, text), (3, near), (9, "quite another text of a few words"), (None, "")]))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 9]
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_copies_by_brute_force(docs, odd):
    """Copies with few and many changes (most further apart than 3 bits), chains of them, and odd rows."""
    rng = np.random.default_rng(11)
    pairs, number = [], 100
    for _ in range(12):
        words = rng.choice([f"w{i}" for i in range(400)], rng.integers(5, 300)).tolist()
        chain = list(words)
        for share in (0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1, 0.03, 0.03):
            copy = [f"n{rng.integers(1 << 30)}" if rng.random() < share else w for w in words]
            chain = [f"n{rng.integers(1 << 30)}" if rng.random() < 0.02 else w for w in chain]
            pairs += [(number, " ".join(copy)), (number + 5000, " ".join(chain))]
            number += 1
    pairs += odd
    kept = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in near_copies.drop_near_copies(docs(pairs)).collect())
    assert kept == brute.near(pairs)
    assert len(kept) < sum(1 for _ in simhash.drop_near_duplicates(docs(pairs)).collect())
    assert near_copies.drop_near_copies(docs([])).count() == 0


def test_near_dedup_stage(spark, rows):
    """The stage of the pipeline against brute force on a whole table."""
    import corpus_pipeline

    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute.near(rows())


def test_near_copies_without_stars(docs, odd, monkeypatch):
    """The join alone finds every link, and one round of stars leaves the rest to it."""
    rng = np.random.default_rng(12)
    words = [rng.choice([f"w{i}" for i in range(300)], 60).tolist() for _ in range(6)]
    pairs = [(i, " ".join(f"n{rng.integers(1 << 30)}" if rng.random() < 0.03 else w for w in words[i % 6])) for i in range(120)] + odd
    want = brute.near(pairs)
    for rounds in (0, 1):
        monkeypatch.setattr(near_copies, "ROUNDS", rounds)
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in near_copies.drop_near_copies(docs(pairs)).collect()) == want


def test_near_copies_by_fingerprints(docs, odd, monkeypatch):
    """Fingerprints are linked as in ``simhash``, and near copies within the limit are found by them alone."""
    text = " ".join(f"word{i}" for i in range(400))
    pairs = [(5, text), (3, text.replace("word17 ", "other ")), (9, "quite another text of a few words"), *odd]
    rows = docs([(i, t) for i, (_, t) in enumerate(pairs)]).withColumnRenamed("doc_id", "row")
    roots = {r["node"]: r["root"] for r in components(near_copies.fingerprint_pairs(rows), "a", "b").collect()}
    want = {d: least for d, _, least in brute.simhash([(i, t) for i, (_, t) in enumerate(pairs)])}
    assert {i: roots.get(i, i) for i in range(len(pairs))} == want
    real = near_copies.marks
    monkeypatch.setattr(near_copies, "marks", lambda rows: real(rows).withColumn("tokens", F.array().cast("array<bigint>")))
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs(pairs[:3])).collect()) == [3, 9]


def test_drop_duplicates_of_repeated_rows(docs):
    """Of wholly equal rows, of rows of one id and of rows without an id one stays: the longest, then the least id."""
    pairs = [(12, "a b"), (12, "a b"), (13, "a  b"), (12, "a   b"), (12, "a   b"), (None, "c"), (None, "c"), (7, "d"), (7, "d"), (8, None), (8, None), (9, "")]
    out = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.drop_duplicates(docs(pairs)).collect()), key=repr)
    assert out == sorted([(12, "a   b"), (None, "c"), (7, "d"), (8, None)], key=repr)
    clash = docs(pairs, extra="__row bigint, range int, run int, key string, kept boolean")
    left = exact_dedup.drop_duplicates(clash)
    assert left.columns == clash.columns and left.count() == 4 and left.filter("__row IS NOT NULL").count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (None, 3)], "a bigint, b bigint")
    assert {(r["node"], r["root"]) for r in components(links, "a", "b").collect()} == {(i, 0) for i in range(201)} | {(500, 500), (501, 500)}


def test_exact_query(spark, rows):
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got(QUERIES["op3_exact_dedup"](spark, FOLDER), *names) == sorted(brute.exact(rows()), key=repr)


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_exact_across_ranges(docs, ranges):
    """A group of copies that covers several ranges is one group."""
    pairs = [(i, "same text " + " " * (i % 5)) for i in range(300)] + [(1000 + i, f"text {i // 2}") for i in range(60)] + [(2000, None), (2001, "\t")]
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got(exact_dedup.duplicates(docs(pairs), ranges), *names) == sorted(brute.exact(pairs), key=repr)


@pytest.mark.parametrize("spread", [True, False])
@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_exact_repeated_rows_across_ranges(docs, ranges, spread, monkeypatch):
    """Repeated rows and rows without an id in one group over several ranges, also where their keys are equal."""
    if not spread:
        monkeypatch.setattr(exact_dedup.F, "rand", lambda seed=None: exact_dedup.F.lit(0.0))
        splitters = [r["key"] for r in exact_dedup._prepared(docs([(i, "same text") for i in range(0, 40, 4)] + [(None, "same text")])).orderBy("key").collect()]
        monkeypatch.setattr(exact_dedup, "_splitters", lambda *_: splitters[:ranges - 1] + splitters[-1:])
    pairs = [(i // 10, "same text") for i in range(400)] + [(None, "same text")] * 200 + [(2000 + i, f"text {i // 2}") for i in range(40)]
    out = exact_dedup.duplicates(docs(pairs), ranges).collect()
    same = [r for r in out if r["doc_id"] is None or r["doc_id"] < 2000]
    assert len(out) == len(pairs) and {(r["keep_id"], r["group_size"]) for r in same} == {(0, 600)} and sum(r["kept"] for r in same) == 1
    assert sum(r["kept"] for r in out) == 21
    if spread and ranges == 64:
        keys = [r["key"] for r in exact_dedup._prepared(docs(pairs)).filter("doc_id IS NULL").collect()]
        assert len(set(keys)) > 190


def test_exact_odd_rows(docs, odd):
    out = exact_dedup.duplicates(docs(odd)).collect()
    assert len(out) == len(odd)
    assert sum(r["kept"] for r in out) == len({brute.re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in odd})
    twins = [r for r in out if r["doc_id"] == 12]
    assert sorted(r["kept"] for r in twins) == [False, True] and {r["group_size"] for r in twins} == {2}
    assert {r["keep_id"] for r in out if r["doc_id"] in (6, 7, 8, None)} == {7}
    assert exact_dedup.duplicates(docs([])).count() == 0
    assert exact_dedup.drop_duplicates(docs(odd)).filter("doc_id IS NULL").count() == 0


def test_substring_query(spark, rows):
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(QUERIES["op9_substring_dedup"](spark, FOLDER), *names) == brute.repeats(rows())


def test_substring_odd_rows(docs, odd):
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(substring_dedup.remove_repeats(docs(odd)), *names) == brute.repeats(odd)
    assert substring_dedup.remove_repeats(docs([])).count() == 0


def test_substring_random(docs):
    """Few different words make many branching repeats; the span is short."""
    rng = np.random.default_rng(5)
    pairs = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 60)))) for i in range(120)]
    pairs += [(200 + i, "q " * 9 + " ".join(rng.choice(list("abcdefgh"), 30)) + " p" * 20) for i in range(30)]
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    for span in (5, 12):
        assert got(substring_dedup.remove_repeats(docs(pairs), span), *names) == brute.repeats(pairs, span)


def test_leaks_query(spark, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(QUERIES["op10_benchmark_decontamination"](spark, FOLDER), *names) == brute.leaks(rows(), items)


@pytest.mark.parametrize("piece", [60, 8 << 20])
def test_leaks_odd_rows(spark, docs, odd, piece):
    """Short items, repeated items, null items and nearly every window in a piece of its own."""
    items = [(1, "A b"), (2, "x x x x x x x x x x x"), (3, None), (4, "!!"), (2, "c d"), (10, "one"), (11, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x13 w14x14 w15x15")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    hit = decontaminate.decontaminate(docs(odd), bench, piece_bytes=piece)
    found = sorted(((r["doc_id"], r["hit"]["n_words"], tuple(r["hit"]["items"])) for r in hit.collect()), key=repr)
    want = sorted(((d, n, i) for d, n, _, _, i, _ in _named(odd, items)), key=repr)
    assert found == want
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontaminate.report(docs(odd), bench), *names) == brute.leaks(odd, items)
    none = bench.filter(F.lit(False))
    assert decontaminate.report(docs(odd), none).filter("contaminated").count() == 0
    assert decontaminate.report(docs([]), bench).count() == 0


def _named(docs, items):
    """Brute-force rows with the item names instead of their digest."""
    for one in docs:
        (row,) = brute.leaks([one], items)
        names = sorted({str(i) for i, t in items if brute.leaks([one], [(i, t)])[0][5]})
        yield (*row[:4], tuple(names), row[5])
