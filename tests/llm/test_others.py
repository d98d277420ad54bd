"""Packing, toxicity, HTML, URLs, pseudonyms, sharding and the pipeline."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from provisio.llm import html_main, packing, pseudonyms, sharding, toxicity, url_rules
from provisio.llm.common import vocabulary
from provisio.llm.queries import KEY, QUERIES, SHARDS

FOLDER = "/root/testdata/sf0.01"
VOCABULARY = vocabulary("word_bpe_49k.json")


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def well_packed(rows, tokens=2048, documents=None, cost=None):
    """Every sequence is gapless from 0 and within its capacities; returns their number."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= tokens
        assert documents is None or len(held) <= documents
        assert cost is None or sum(n * n for _, n in held) <= cost
    return len(by)


def test_packing_query(spark, rows):
    out = QUERIES["op7_best_fit_packing"](spark, FOLDER).collect()
    want = brute.pieces(Tokenizer.from_file(VOCABULARY), rows())
    assert sorted((tuple(r[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out), key=repr) == want
    least = -(-sum(p[3] for p in want) // 2048)
    assert well_packed(out) <= least + 2


def test_packing_odd_rows(docs, odd):
    out = packing.pack(docs(odd), VOCABULARY)
    assert got(out, "doc_id", "piece", "start", "length", "ids_crc32") == brute.pieces(Tokenizer.from_file(VOCABULARY), odd)
    well_packed(out.collect())
    assert packing.pack(docs([]), VOCABULARY).count() == 0


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_packing_capacities(docs, rule):
    pairs = [(i, "a " * (i % 37)) for i in range(300)]
    out = packing.pack(docs(pairs), VOCABULARY, 64, documents=3, cost=2000.0, rule=rule).collect()
    assert len(out) == 300
    well_packed(out, 64, 3, 2000)
    with pytest.raises(ValueError):
        packing.plan_bins({50: 1}, 64, 3, 100.0)


def test_encoder_chunks(rows):
    """Chunk by chunk equals the whole text, whatever the characters."""
    whole = Tokenizer.from_file(VOCABULARY)
    rng = np.random.default_rng(1)
    symbols = list("aB1'é ̀Σς\t\n\x0b\x1c\x85\u00a0\u2028漢😀.-_<|>ßÿÀ×÷²ª") + ["'ll", "'S", "<|endoftext|>", "  ", "İ", "ﬁ", "\u0345"]
    texts = ["".join(rng.choice(symbols, rng.integers(0, 40))) for _ in range(3000)] + [r[1] for r in rows()[:300]]
    encoder = packing.Encoder(VOCABULARY)
    encoder.chunks.most = encoder.words.most = 50
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def auc(pairs):
    pairs = sorted(pairs)
    values = np.array([p for p, _ in pairs])
    rank = np.searchsorted(values, values, "left") + np.searchsorted(values, values, "right")
    y = np.array([y for _, y in pairs])
    n, m = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() / 2 - n * n / 2) / (n * m)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = QUERIES["op8_toxicity"](spark, folder).collect()
    assert len(out) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [(r["score"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert auc(held) > 0.85
    assert np.mean([y for s, y in held if s >= 0.5]) > 0.9


def test_nearest_is_exact():
    """Block-max search against all cosines."""
    rng = np.random.default_rng(2)
    terms = {f"t{i}".encode(): i for i in range(40)}
    index = toxicity.Index(terms, rng.uniform(1, 5, 40))
    texts = [[f"t{i}".encode() for i in rng.integers(0, 40, rng.integers(1, 8))] for _ in range(500)]
    vectors = [index.vector(t) for t in texts]
    index.load(vectors, [1] * 500, [0] * 500, list(range(500)))
    for q in vectors[:60]:
        dense = np.zeros(40)
        dense[q[0]] = q[1]
        sims = np.array([dense[vectors[i][0]] @ vectors[i][1] for i in index.ids])
        best = np.lexsort((np.arange(500), -np.round(sims, 12)))[:9]
        best = best[sims[best] > 0]
        found, values = index.nearest(*q, 9)
        assert found.tolist() == best.tolist() and np.allclose(values, sims[best])


def test_every_labelled_row_counts(spark, docs):
    """Rows that share a passage with others, or their text with a row of the other label, stay examples."""
    passage = " ".join(f"passage{i}" for i in range(40))
    pairs = [(i, f"{passage} {' '.join(f'own{i}x{j}' for j in range(60))} {'slur' if i % 2 else 'calm'}") for i in range(100)]
    pairs += [(1000 + i, f"{t} slur") for i, t in pairs[:20:2]]
    labels = spark.createDataFrame([(i, int("slur" in t)) for i, t in pairs], "doc_id bigint, toxic int")
    index = toxicity.fit(docs(pairs), labels)
    assert index.rows.sum() == len(pairs) and index.toxic.sum() == 60


def test_few_labelled_rows_have_terms(spark, docs):
    """The test knows no least number of rows."""
    pairs = [(i, f"own{i} {'slur' if i % 2 else 'calm'}") for i in range(16)]
    index = toxicity.fit(docs(pairs), spark.createDataFrame([(i, i % 2) for i, _ in pairs], "doc_id bigint, toxic int"))
    assert set(index.terms) == {b"slur", b"calm"}


def test_terms_by_likelihood_ratio(spark, docs):
    """Terms, without a cut on their number, against a plain count; of two texts of one id the least is the example."""
    rng = np.random.default_rng(5)
    bad = rng.integers(0, 4, 400) == 0
    texts = [" ".join([f"w{j}" for j in rng.integers(0, 300, 30)] + [f"t{j}" for j in rng.integers(0, 2500, 400)] * bool(b)) for b in bad]
    index = toxicity.fit(docs([*enumerate(texts), (0, "~ zzz")]), spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad)], "doc_id bigint, toxic int"))
    words = [set(t.split()) for t in texts]
    n, total, kept = len(texts), int(bad.sum()), set()
    every = Counter(w for own in words for w in own)
    mine = Counter(w for own, b in zip(words, bad) if b for w in own)
    for w, held in every.items():
        a = mine[w]
        cells = [(a, held * total), (held - a, held * (n - total)), (total - a, (n - held) * total), (n - total - held + a, (n - held) * (n - total))]
        if 2 * sum(o * np.log(o * n / e) for o, e in cells if o) >= 2 * np.log(len(every)):
            kept.add(w.encode())
    assert set(index.terms) == kept and len(kept) > 2048


def test_toxicity_odd_rows(spark, docs, odd):
    labels = spark.createDataFrame([(4, 1), (5, None), (6, 0), (6, 1), (None, 1), (999, 1)], "doc_id bigint, toxic int")
    out = toxicity.report(docs(odd), labels).collect()
    assert len(out) == len(odd) and all(0 <= r["score"] <= 1 for r in out)
    none = labels.filter(F.lit(False))
    assert {r["score"] for r in toxicity.report(docs(odd), none).collect()} == {0.0}
    assert toxicity.report(docs([]), labels).count() == 0
    kept = toxicity.drop_toxic(docs(odd), none)
    assert kept.count() == len(odd) and kept.columns == docs(odd).columns


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


PAGES = [
    ("<nav><a>menu</a></nav><article><h1>A &amp; B</h1><p>x  y\n z<p>second<br>line</article><footer>f</footer>", "A & B\nx y z\nsecond line"),
    ("<div class='ad'>buy</div><article><p><b>open<br><p>next &#233;&eacute;</article>", "open\nnext éé"),
    ("<header>site</header><main><header><h1>T</h1></header><p>t</p><aside>s</aside><form>f<p>g</p></form></main>", "T\nt"),
    ("<article><p>a</p><section id=comments><article><p>c</p></article></section></article>", "a"),
    ("<article><p>a</p></article><div class='comment-list'><article>c</article></div>", "a"),
    ("<div id='cookie-notice'>n</div><p>no article</p><ul><li>i</li><li>j</ul><table><tr><td>1<td>2</table>", "no article\ni\nj\n1\n2"),
    ("<article>x<!-- <p>c</p> --><script>var t='</p>';</script>y &lt;p&gt; 1 < 2</article>", "xy <p> 1 < 2"),
    ("<article><p>cut <b>short", "cut short"),
    ("</p></div><article></b><p>stray</p></article></article>", "stray"),
    ("", ""),
]


@pytest.mark.parametrize("body,text", PAGES)
def test_main_text(body, text):
    assert html_main.main_text(page(body)) == text


@pytest.mark.parametrize("body,text", [
    ("<main><h1>T</h1><p>lead</p><article><p>a</p></article><p>body</p></main>", "T\nlead\na\nbody"),
    ("<div><p>the body of the page lies in a div</p></div><article><p>teaser</p></article>", "the body of the page lies in a div\nteaser"),
    ("<div class='content has-sidebar'><p>text</p></div><div class='sidebar'>s</div>", "text"),
    ("<div class='no-sidebar with-comments'><p>text</p></div>", "text"),
    ("<div class='sidebar-left'><div class='widget-page'><article><p>text</p></article></div></div>", "text"),
    ("<div class='page-header'><main><p>text</p></main></div>", "text"),
    ("<p>text</p><div class='comments'><article>c</article></div>", "text"),
])
def test_article_text_stays(body, text):
    assert html_main.main_text(page(body)) == text


def test_templates_of_layouts_and_small_hosts(spark):
    """Unmarked boilerplate goes on hosts with two layouts and on small hosts; shared passages of articles stay."""
    rows = [(i, "http://two.example/", page(f"<div><p>layout {i % 2}</p></div><div><p>own {i}</p></div>")) for i in range(20)]
    rows += [(100 + i, "http://small.example/", page(f"<div><p>banner</p></div><article><p>shared passage</p><p>own {i}</p></article>")) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_main.extract(df).collect()}
    assert out == {i: f"own {i}" for i in range(20)} | {100 + i: f"shared passage\nown {i}" for i in range(4)}


@pytest.mark.parametrize("body,text", [
    ("<article><p>a</p><div class='search-results'><p>found</p></div></article>", "a\nfound"),
    ("<article><p>a</p><p class='share-price'>9</p><p id='social-history'>h</p></article>", "a\n9\nh"),
    ("<article><p>a</p><div class='share-buttons'>s</div><div class='ad-300x250'>b</div><ul id='related-posts'><li>r</ul><p class='comments'>c</p></article>", "a"),
    ("<h1>T</h1><p>lead</p><article><p>the longer body</p></article><div>chrome</div>", "T\nlead\nthe longer body"),
    ("<div><p>far</p></div><article><p>the longer body</p></article>", "the longer body"),
])
def test_names_in_articles_and_leads(body, text):
    assert html_main.main_text(page(body)) == text


def test_shared_headings_and_cells_stay(spark):
    """Headings, cells and items that articles share are theirs; menus and whole tables that recur are not."""
    inner = "<h2>Summary</h2><p>own {0}</p><table><tr><td>key {0}</td><td>yes</td></tr></table><ul><li>yes</li><li>item {0}</li></ul>"
    menu = "<div><ul><li><a>Home</a></li><li><a>News</a></li>{}</ul></div><table><tr><td>site</td><td>table</td></tr></table>"
    # Each page marks another entry of its menu, so that the menu differs as a whole.
    rows = [(i, f"http://a.example/{i}", page(menu.format(f"<li><b>{i}</b></li>") + f"<div>{inner.format(i)}</div>")) for i in range(12)]
    rows += [(100 + i, "http://b.example/", page(f"<article>{inner.format(i)}</article>")) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_main.extract(df).collect()}
    own = "Summary\nown {0}\nkey {0}\nyes\nyes\nitem {0}"
    assert out == {i: f"{i}\n{own.format(i)}" for i in range(12)} | {100 + i: own.format(i) for i in range(12)}


def test_templates_against_counter(spark):
    """Template hashes by Spark against a plain count of all pages."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("url", "html")
    held = {}
    for r in pages.collect():
        host = (r["url"] or "").partition("://")[2].split("/")[0].split("?")[0].split("#")[0].lower()
        number, marks = html_main.subtree_hashes(r["html"])
        held.setdefault(host, {})[number] = marks
    want = {}
    for host, found in held.items():
        n = Counter(m for marks in found.values() for m in marks)
        kept = {m for m, c in n.items() if (c >= 10 and c >= 0.9 * len(found) if m & 1 else c >= 3 and c >= 0.25 * len(found))}
        if kept:
            want[host] = kept
    assert {r["host"]: set(r["marks"]) for r in html_main.templates(pages).collect()} == want


def test_templates(spark):
    """A block that most pages of a host share goes there and stays elsewhere; copies of one page are one page."""
    rows = [(i, f"http://A.example/{i}", page(f"<div><p>unmarked banner</p></div><div><p>own {i}</p></div>")) for i in range(20)]
    rows += [(100 + i, "http://b.example/same", page("<div><p>unmarked banner</p></div><div><p>copied</p></div>")) for i in range(20)]
    rows += [(300 + i, "http://d.example/", page(f"<nav>{i}</nav><article><p>{'shared by half' if i % 2 else i}</p></article>")) for i in range(30)]
    rows += [(200, None, None), (201, "x", ""), (202, "http://c.example", page("<p>" + "deep <i>" * 5000 + "</p>"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    out = {r["page_id"]: r["text"] for r in html_main.extract(df).collect()}
    assert {out[i] for i in range(20)} == {f"own {i}" for i in range(20)}
    assert {out[100 + i] for i in range(20)} == {"unmarked banner\ncopied"}
    assert all(out[300 + i] == ("shared by half" if i % 2 else str(i)) for i in range(30))
    assert out[200] == "" and out[201] == "" and out[202].count("deep") == 5000
    assert html_main.extract(df.limit(0)).count() == 0


def test_html_query(spark):
    """The generated pages keep their text in one article of headings and paragraphs."""
    import html as references

    rows = QUERIES["op1_html_extraction"](spark, FOLDER).collect()
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        blocks = [" ".join(references.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(brute.UPPER)
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.LIST if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_query(spark):
    out = {r["page_id"]: r for r in QUERIES["op5_url_filters"](spark, FOLDER).collect()}
    source = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()
    assert len(out) == len(source)
    for r in source:
        host, path, rule, verdict = judged(r["url"])
        mine = out[r["page_id"]]
        assert (mine["host"], mine["path"], mine["rule"]) == (host, path, rule)
        assert mine["verdict"] == (verdict or ("block" if mine["because"] else "allow"))


def test_url_rules_mined(spark):
    """Planted tokens are mined, by confidence and support, and found again; odd URLs are judged."""
    urls = [(i, f"http://{'spam' if i % 4 == 0 else 'fine'}-{i % 7}.site.org/{'pills' if i % 4 == 0 else 'news'}/{i}") for i in range(400)]
    urls += [(1000, "http://new.org/pills/9"), (1001, None), (1002, "no scheme"), (1003, "HTTP://WWW.Example.COM/en/?q#z"), (1004, "a://b://c/d"), (1005, "x://net"), (1005, "x://net")]
    pages = spark.createDataFrame(urls, "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("tokens", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(None, 0), (5, None)], "doc_id bigint, quality int")
    rules = {tuple(r["antecedent"]): r["confidence"] for r in url_rules.mine(pages, labels).collect()}
    assert rules[("path=pills",)] == 1.0 and all(len(a) == 1 for a, c in rules.items() if c == 1.0 and "path=pills" in a)
    out = {r["page_id"]: r for r in url_rules.judge(pages, labels).collect()}
    for i, url in urls:
        host, path, rule, verdict = judged(url)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule)
        assert out[i]["verdict"] == (verdict or ("block" if "pills" in (url or "") else "allow"))
    assert url_rules.judge(pages, labels).count() == len(urls)
    assert url_rules.judge(pages.limit(0), labels).count() == 0
    assert url_rules.judge(pages, labels.limit(0)).filter("because IS NOT NULL").count() == 0


def test_permutation():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pseudonyms.permute(v, size, b"k", "t") for v in range(size)) == list(range(size))
    assert [pseudonyms.permute(v, 1000, b"k", "t") for v in range(9)] != [pseudonyms.permute(v, 1000, b"j", "t") for v in range(9)]


def test_pseudonyms_keep_format():
    text = "pay 4539 1488 0343 6467 or 4539-1488-0343-6467 not 4539148803436468, call +1 (017) 555-7713, host 97.51.17.173 not 300.1.1.1, " \
           "born 1987-02-28 or 28.02.1987 not 1987-02-30, DE89 3704 0044 0532 0130 00, ab.34@mail7.example.com, token = \"b44e15e09fd311c3cf3163b66d5a9875\""
    new, found = pseudonyms.pseudonymise(text, b"k")
    assert dict(found) == {"card": 2, "phone": 1, "ipv4": 1, "date": 2, "iban": 1, "email": 1, "secret": 1}
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", new)
    digits = [re.sub(r"\D", "", c) for c in cards]
    assert digits[0] == digits[1] != "4539148803436467" and pseudonyms.luhn(digits[0][:-1]) == int(digits[0][-1])
    iso, dotted = re.search(r"born (\d{4}-\d\d-\d\d) or (\d\d\.\d\d\.\d{4})", new).groups()
    assert iso == "-".join(reversed(dotted.split("."))) != "1987-02-28"
    assert "4539148803436468" in new and "300.1.1.1" in new and "1987-02-30" in new
    assert re.sub(r"[a-z]", "a", re.sub(r"[0-9a-f]{32}|\d", "9", new)) == re.sub(r"[a-z]", "a", re.sub(r"[0-9a-f]{32}|\d", "9", text)) or len(new) >= len(text) - 12
    again, _ = pseudonyms.pseudonymise(text, b"k")
    assert again == new and pseudonyms.pseudonymise(text, b"other")[0] != new


def test_pseudonym_query(spark, docs, odd):
    out = QUERIES["op6_pii_pseudonyms"](spark, FOLDER).collect()
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(out) == len(source)
    for r in out:
        assert (r["text"], dict(r["found"])) == pseudonyms.pseudonymise(source[r["doc_id"]], KEY)
    assert sum(r["n_values"] for r in out) > 20
    small = pseudonyms.pseudonyms(docs(odd), KEY)
    assert small.count() == len(odd) and [r["text"] for r in small.filter("doc_id = 1").collect()] == [None]
    assert pseudonyms.pseudonyms(docs([]), KEY).count() == 0


def claimed(shards, slots):
    """Turns written out with full preference lists."""
    import xxhash

    lists = []
    for s in shards:
        offset, step = xxhash.xxh64_intdigest(s.encode(), 1) % slots, xxhash.xxh64_intdigest(s.encode(), 2) % (slots - 1) + 1
        lists.append([(offset + j * step) % slots for j in range(slots)])
    owner: dict = {}
    while len(owner) < slots:
        for i, order in enumerate(lists):
            if len(owner) < slots:
                owner[next(x for x in order if x not in owner)] = i
    return [owner[i] for i in range(slots)]


def test_sharding(spark, docs, odd):
    assert sharding.fill(list("abcde"), 101) == claimed(list("abcde"), 101)
    table = sharding.fill(SHARDS)
    sizes = Counter(table)
    assert len(sizes) == len(SHARDS) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill(SHARDS[:-1])
    moved = sum(SHARDS[a] != SHARDS[b] for a, b in zip(table, fewer))
    assert moved < 3 * sizes[len(SHARDS) - 1] + 0.05 * len(table)
    for bad in (["a", "a"], []):
        with pytest.raises(ValueError):
            sharding.fill(bad)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 100)
    out = QUERIES["op4_sharding"](spark, FOLDER)
    assert out.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    keyed = out.withColumn("want", F.expr(f"pmod(xxhash64(doc_id), {sharding.SLOTS})")).collect()
    assert all(r["slot"] == r["want"] and r["shard"] == SHARDS[table[r["slot"]]] for r in keyed)
    small = sharding.place(docs(odd), SHARDS)
    assert small.count() == len(odd) and small.filter("shard IS NULL").count() == 0
    assert sharding.place(docs([]), SHARDS).count() == 0


def test_pipeline(spark, tmp_path):
    """Every stage against brute force on the rows that reach it."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, FOLDER)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            scored = toxicity.report(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
            assert left == {r["doc_id"] for r in scored.filter("predicted = 0").collect()}
        elif name == "exact_dedup":
            assert left == {d for d, _, _, kept, _ in brute.exact(before) if kept}
        elif name == "simhash_near_dedup":
            assert left == set(brute.near(before))
        elif name == "benchmark_decontamination":
            assert left == {r[0] for r in brute.leaks(before, items) if not r[5]}
        else:
            assert left == {d for d, _ in before}
            well_packed(docs.collect())
    whole = corpus_pipeline.run(spark, FOLDER)
    assert got(whole, "doc_id", "piece", "ids_crc32") == got(docs, "doc_id", "piece", "ids_crc32")
