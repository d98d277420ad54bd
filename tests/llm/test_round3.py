"""Quality rules, conversation repair and phrases against brute force."""

from __future__ import annotations

import random
import tracemalloc

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provisio.llm import conversations, phrases, quality_rules
from provisio.llm.queries import ORACLES, QUERIES
from tools.check import compare

FOLDER = "/root/testdata/sf0.01"
BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
AUDIT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def con_over(folder):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def test_quality_query(spark, rows):
    name = "op11_quality_rules"
    text, ok = compare(spark, con_over(FOLDER), QUERIES[name], ORACLES[name], FOLDER)
    assert ok, text
    assert got(QUERIES[name](spark, FOLDER), BASE) == brute.quality(rows())


def test_quality_odd_rows(docs, odd):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b\tc\n d\x0be #x |".split(" ")) for _ in range(rng.randrange(60))) for _ in range(200)]
    pairs = [*odd, *((100 + i, t) for i, t in enumerate(texts)), (7000, "w\n\n \nw\nw"), (7001, "漢😀 " * 30), (7002, "a b c d e a b c d e f g")]
    assert got(quality_rules.report(docs(pairs)), BASE) == brute.quality(pairs)
    assert quality_rules.report(docs([])).count() == 0


def test_quality_rules_decide(spark, docs):
    """Each rule of the table by a text on either side of its threshold."""
    clean = " ".join(f"The cat{i} and a dog went{i} to a house in{i} town" for i in range(12))

    def lines(others):
        """``others`` lines and four equal ones, 3 of them repeated, between them."""
        return "\n".join(f"the line number {i}" + "\nsame" * (i < 4) for i in range(others))

    cases = [
        (1, clean, ""), (2, clean.replace("cat", "c#t"), ""), (3, clean.replace("cat", "c##t"), "symbols"),
        (4, " ".join(f"word{i}" for i in range(60)), "stop_words"), (5, " ".join(f"word{i}" for i in range(49)), ""),
        (6, " ".join("a" for _ in range(12)), "repeated_windows,word_length"),
        (7, lines(7), ""), (8, lines(6), ""), (9, lines(5), "repeated_lines"),
        (10, None, "few_words"),
    ]
    table = docs([(i, t) for i, t, _ in cases]).withColumn("lang", F.lit("en"))
    out = {r["doc_id"]: r for r in quality_rules.report(table).collect()}
    for i, _, failed in cases:
        assert out[i]["failed"] == failed and out[i]["kept"] == (failed == ""), (i, out[i])
    left = quality_rules.drop_poor(table.withColumn("kept", F.lit("own")))
    assert left.columns == [*table.columns, "kept"] and {r["doc_id"] for r in left.collect()} == {1, 2, 5, 7, 8}
    unknown = quality_rules.report(docs([(4, cases[3][1])]).withColumn("lang", F.lit("xx"))).first()
    assert unknown["kept"] and unknown["n_stop_words"] is None


def test_quality_plan(spark):
    """One pass without shuffle or Python."""
    plan = QUERIES["op11_quality_rules"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


TALK = "conv_id bigint, turn bigint, role string, text string, edit int, gaps string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], TALK).repartition(5)


def wanted(held):
    return sorted(((c, *brute.repaired(rows)) for c, rows in held.items()), key=repr)


def test_conversation_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_conversation_repair"](spark, FOLDER), AUDIT) == wanted(brute.damage(rows))


def random_talks(n, most, seed):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for _ in range(rng.randrange(most)):
            out.append((
                rng.choice([conv, conv, conv, None]), rng.choice([None, *range(8)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                rng.choice(["a.", "b!", "c", "", " \n", None, "d?", "é漢.", "x" * 3000 + ". \t"]),
            ))
    return out


def test_conversation_odd_rows(spark):
    rows = random_talks(150, 12, 5)
    held: dict = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got(conversations.report(talks(spark, rows)), AUDIT) == wanted(held)
    assert got(conversations.report(talks(spark, rows), held=64), AUDIT) == wanted(held)
    assert got(conversations.report(conversations.damaged(talks(spark, rows))), AUDIT) == wanted(brute.damage(rows))
    assert conversations.report(talks(spark, [])).count() == 0
    assert conversations.repair(talks(spark, [])).count() == 0


def test_conversation_giant_across_batches(spark):
    """One conversation of many batches, spilled; its state goes on from batch to batch."""
    rng = random.Random(8)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"say {i}.", f"say {i}", "same."])) for i in range(9000)]
    held = {1: [(t, r, x) for _, t, r, x in rows]}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        assert got(conversations.report(talks(spark, rows), held=4096), AUDIT) == wanted(held)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_conversation_pieces(monkeypatch):
    """Back-pointers read in many pieces say the same."""
    monkeypatch.setattr(conversations, "PIECE", 3)
    rng = random.Random(9)
    for n in (0, 1, 2, 3, 4, 7, 30):
        rows = [(i, rng.choice(["user", "assistant", "system"]), f"t{i}.") for i in range(n)]
        program = conversations.Repair(4)
        for turn, role, text in rows:
            program.add(turn, role, text, 0)
        assert program.report() == brute.repaired(rows)


def test_cheapest_edits_by_enumeration():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool", ""]), "x") for i in range(rng.randrange(4))]
        faults = [rng.choice([0, 0, 1, 2, 3]) for _ in rows]
        program = conversations.Repair()
        for (turn, role, text), fault in zip(rows, faults):
            program.add(turn, role, text, fault)
        assert program.report()[5:7] == brute.all_edits(rows, faults)


def test_repaired_turns(spark):
    """The rows of the repaired conversations give the digest of the report."""
    rows = random_talks(60, 10, 6)
    sums = {r["conv_id"]: r["repaired_sha256"] for r in conversations.report(talks(spark, rows)).collect()}
    lines: dict = {c: [] for c in sums}
    for r in conversations.repair(talks(spark, rows)).orderBy("conv_id", "place").collect():
        assert r["place"] == len(lines[r["conv_id"]])
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: brute.sha("\n".join(x)) for c, x in lines.items()} == sums


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_phrase_query(spark):
    name = "op13_phrase_mining"
    text, ok = compare(spark, con_over(FOLDER), QUERIES[name], ORACLES[name], FOLDER)
    assert ok, text


def babble(n, seed):
    """Few words in many orders, in texts of all kinds."""
    rng = random.Random(seed)
    words = ["a", "B", "dé", "x\x1cy", "New", "york"]
    return [
        (rng.choice(["en", "de", None, "und"]), rng.choice([None, "", " . "]) if rng.random() < 0.05 else
         "".join(rng.choice(words) + rng.choice([*[" "] * 12, "  ", "\t", ". ", ",", "\n", " ! ", "\r\n"]) for _ in range(rng.randrange(80))))
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def talk(spark):
    pairs = babble(250, 11) + [("en", " ".join(["new york"] * 400))]
    wide = "lang string, text string, n int, phrase string, word string"
    return pairs, spark.createDataFrame([(*p, None, None, None) for p in pairs], wide).repartition(4).cache()


@pytest.mark.parametrize("bounds", [{}, {"words": 3}, {"held": 64}, {"words": 4, "held": 40}, {"first": 5}])
def test_phrases_within_bounds(talk, bounds, monkeypatch):
    """The same rows whether words have numbers, containers burst, tasks spill or texts are cut, or not."""
    monkeypatch.setattr(phrases, "PART_WORDS", 500)
    pairs, table = talk
    want = brute.phrases(pairs, first=bounds.get("first", 2000))
    assert len(want) >= 15
    assert got(phrases.collocations(table, **bounds), PHRASE) == sorted(want, key=repr)


def test_phrases_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


def test_chunks_cut_no_word():
    rng = random.Random(2)
    for _ in range(300):
        texts = ["".join(rng.choice(["ab", " ", "c", ".", "\n", "longer"]) for _ in range(rng.randrange(40))).encode() for _ in range(4)]
        for size in (1, 5, 16, 1000):
            words = [w for c, _ in phrases.chunks(texts, size) for w in phrases.tokens(c) if w != b"."]
            whole = [w for t in texts for w in phrases.tokens(t) if w != b"."]
            assert sorted(words) == sorted(whole)


def test_phrases_of_cut_texts(monkeypatch):
    """A text in many chunks counts like the whole text."""
    words = [f"w{i}".encode() for i in range(6)]
    rng = random.Random(5)
    text = b" ".join(rng.choice([*words, b"w1.", b"w2\nw3", b"rare"]) for _ in range(900))
    counted = []
    for size in (7, 50, 1 << 20):
        task = phrases.Task(words[:4], np.array([0]), np.ones(phrases.OTHERS, bool), 1 << 20)
        for chunk, goes_on in phrases.chunks([text], size):
            task.count("en", chunk, goes_on)
        (run,) = [phrases.summed(list(t.root.runs())) for t in task.tries.values()]
        counted.append(([c.tolist() for c in run], sorted(task.texts.items())))
    assert counted[0] == counted[1] == counted[2]


def test_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 50)
    rng = np.random.default_rng(1)
    trie, want = phrases.Trie(), {}
    runs = []
    for step in range(30):
        first = np.where(rng.random(400) < 0.4, 7, rng.integers(1, 60, 400))
        hi, lo = first << phrases.BITS | rng.integers(1, 9, 400), rng.integers(0, 40, 400) << phrases.BITS
        trie.add(hi, lo)
        for key in zip(hi.tolist(), lo.tolist()):
            want[key] = want.get(key, 0) + 1
        if step % 7 == 6:
            assert isinstance(trie.root, phrases.Node)
            runs += trie.spill(300)
            assert trie.size <= 300
    runs += trie.spill(0)
    assert all((np.diff(hi) >= 0).all() for hi, _, _ in runs)
    hi, lo, n = phrases.summed([phrases.unpack(phrases.pack(*r)) for r in runs])
    assert dict(zip(zip(hi.tolist(), lo.tolist()), n.tolist())) == want


def test_phrases_memory_of_a_batch():
    """Words and sequences of a large batch are counted without all of its texts and arrays at once."""
    words = [b"w%d" % i for i in range(40)]
    text = b" ".join(words * 36).decode()
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 2000), pa.array([text] * 4000)], ["lang", "text"])
    task = phrases.Task(words, np.array([0]), None, phrases.HELD)
    tracemalloc.start()
    try:
        rows = [r for b in task.run(iter([batch])) for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {r["lang"] for r in rows} == {"en", "de"}
    assert peak < 4 * batch.nbytes
