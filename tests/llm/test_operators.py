"""The training-data operators against brute force, on small and odd inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlens.llm import bpe, chat, html_text, mixing, neighbours, quality, simhash, vector_dedup
from draftlens.llm.common import components
from draftlens.llm.repeated_bytes import repeated_bytes
from draftlens.llm.substring_dedup import maximal_repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slice int, kept string"


def odd(spark):
    """Nulls, empty texts, repeated rows and ids, clashing column names."""
    rnd, rows = random.Random(5), []
    for i in range(60):
        base = rows[rnd.randrange(len(rows))][1] or "" if rows and rnd.random() < 0.7 else ""
        at = rnd.randrange(len(base) + 1)
        text = " ".join(rnd.choice("ab é") for _ in range(rnd.randrange(150))) + base[at:at + 400]
        rows.append((i, rnd.choice([None, "", " \t"]) if rnd.random() < 0.2 else text, "en", f"s{i % 4}", 1, 7, "x"))
    rows += [rows[3], (3, "other text", None, None, None, None, None), (None, None, None, None, None, None, None),
             (None, "y " * 300, "en", None, 1, 1, None), (None, "y " * 300, "en", None, 1, 1, None)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_substring_dedup(spark):
    docs = odd(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    seen, want = set(), {}
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s:s + 20])
            if key in seen:
                gone[s:s + 20] = [True] * 20
            seen.add(key)
        want[doc] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in maximal_repeats(docs).collect()} == want


def test_substring_dedup_odd_rows(spark):
    got = maximal_repeats(odd(spark)).collect()
    assert len(got) == odd(spark).count()
    assert maximal_repeats(odd(spark).limit(0)).collect() == []


@pytest.mark.parametrize("length", [200, 64, 9])
def test_repeated_bytes(spark, length):
    docs = [(r.doc_id, (r.text or "").encode()) for r in odd(spark).collect()]
    count = Counter(b[s:s + length] for _, b in docs for s in range(len(b) - length + 1))
    want = []
    for doc, b in docs:
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                cover[s:s + length] = True
        opens = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        want.append((doc, len(b), int(cover.sum()), opens, bytes(np.frombuffer(b, np.uint8)[~cover])))
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in repeated_bytes(odd(spark), length=length).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert repeated_bytes(odd(spark).limit(0)).collect() == []


def test_simhash(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == odd(spark).count()
    fps = {r.fp % 2**64 for r in rows}
    link = {a: {b for b in fps if bin(a ^ b).count("1") <= 4} for a in fps}
    for r in rows:
        reach, new = set(), {r.fp % 2**64}
        while new:
            reach |= new
            new = set().union(*(link[x] for x in new)) - reach
        ids = [x.doc_id for x in rows if x.fp % 2**64 in reach and x.doc_id is not None]
        assert r.component_id == min(ids, default=None)
    assert simhash.near_duplicates(odd(spark).limit(0)).collect() == []


def test_simhash_dense_blocks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 50)
    rnd, fps = random.Random(1), set()
    base = [rnd.getrandbits(64) for _ in range(5)]
    for i in range(600):
        x = base[i % 5]
        for _ in range(rnd.randrange(8)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x - 2**64 if x >= 2**63 else x)
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    root = {x: x for x in fps}
    changed = True
    order = sorted(fps)
    close = {a: [b for b in order if bin((a ^ b) % 2**64).count("1") <= 4] for a in order}
    while changed:
        changed = False
        for a in order:
            low = min(root[b] for b in close[a])
            if low < root[a]:
                root[a], changed = low, True
    assert {x: got.get(x, x) for x in fps} == root


def test_bpe(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as P

    name = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(name[0], "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "<|endoftext|> it's", "ab" * 3000, " \n\t x　日本 1234", "é" * 700, "the the  the"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe.encode(docs, *name, decoded_col="decoded").collect()
    assert {r.doc_id: r.ids for r in rows} == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.decoded).decode() for r in rows} == {i: t or "" for i, t in enumerate(texts)}


def test_mixing(spark):
    docs = odd(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        s = by.setdefault(r.source, [r.target, 0, r.source_size])
        s[1] += r.taken
    assert all(abs(t - n) <= 1 and t <= 3 * size for t, n, size in by.values())
    mixed = mixing.apply(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(n for _, n, _ in by.values())
    assert mixing.mix(docs.limit(0)).collect() == []


def test_quality_rejects_junk_and_keeps_the_rest(spark, data):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    even = labels.where("doc_id % 2 = 0")
    held_out = quality.select(docs, even).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rate = {r.quality: r.kept for r in held_out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.98 and rate[0] < 0.05


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, 0)], "doc_id long, quality int")
    assert quality.select(odd(spark), labels).count() == odd(spark).count()
    assert quality.select(odd(spark), labels.limit(0)).where("not kept").count() == 0
    assert quality.select(odd(spark).limit(0), labels).count() == 0


def test_html():
    page = html_text.Page("<body><header>x</header><p>a <b>b<p>c&amp;d&nbsp;e</b> 1 < 2</p><ul><li>q<li>r</ul><div class='comments'>no</div>"
                          "<script>if(a</b)</script>z<!-- c --><form>f</form><pre>k\n l</pre>")
    assert page.text() == "a b\n\nc&d e 1 < 2\n\nq\n\nr\n\nz\n\nk l"


@pytest.mark.parametrize(("html", "text"), [
    ("<div class='content has-sidebar'><article><p>Main text</p></article></div>", "Main text"),
    ("<article class='post comments-open'><p>Main</p></article>", "Main"),
    ("<div class='no-sidebar'><p>x y z</p></div>", "x y z"),
    ("<article><p>Long main text of it</p><section id='share-prices'><p>prices</p></section><div class='comments'><p>no</p></div></article>",
     "Long main text of it\n\nprices"),
    ("<div class='related'><article>teaser</article></div><article><p>The main article of it</p></article>", "The main article of it"),
    ("<div id='sidebar'><p>Nearly everything on this page is in here</p></div><p>rest</p>", "Nearly everything on this page is in here\n\nrest"),
    ("<div class='ad-300x250'>buy</div><p>words that stay here</p>", "words that stay here"),
])
def test_html_names(html, text):
    assert html_text.Page(html).text() == text


def plain_main_text(rows, least):
    """Hashes counted host by host in plain Python."""
    from collections import defaultdict
    from urllib.parse import urlsplit

    host = lambda u: (urlsplit(u or "").hostname or "").lower()
    pages = defaultdict(set)
    for _, url, html in rows:
        if html is not None:
            for h in html_text.Page(html).hashes():
                pages[host(url), h].add(html)
    found = lambda u: frozenset(h for (name, h), p in pages.items() if name == host(u) and len(p) >= least)
    return sorted((-1 if i is None else i, html_text.Page(html or "").text(found(url))) for i, url, html in rows)


def test_html_templates(spark):
    menu = "<div><a>Home</a> <a>News</a></div>"
    hosts = [("small", 4), ("large", 40), ("few", 3)]  # judged alike, but for too few pages
    rows = [(100 * k + i, f"http://{h}.example/x", f"<body>{menu * (i < 6)}<div>Own {h} {i}</div><p class=p{i}>By the same author</p></body>")
            for k, (h, n) in enumerate(hosts) for i in range(n)]
    rows += [(700 + i, "http://art.example/", f"<div>Top</div><article><p>Said often</p><p>own {i}</p><section>Read more</section></article>") for i in range(5)]
    rows += [(7, None, None), (8, "http://h.example/y", ""), rows[0], rows[0], (None, "x", "<p>no id"), (9, "http://long.example/", "<p>" + "word " * 300_000)]
    df = spark.createDataFrame([(*r, "t", 1, "h") for r in rows], "page_id long, url string, html string, text string, key int, host string")
    got = sorted((-1 if r.page_id is None else r.page_id, r.text) for r in html_text.main_text(df).collect())
    assert got == plain_main_text(rows, html_text.MIN_PAGES)
    text = dict(got)
    assert text[0] == "Own small 0" and text[100] == "Own large 0" and text[200].startswith("Home News")
    assert text[701] == "Said often\n\nown 1" and text[8] == text[7] == ""
    assert html_text.main_text(df.limit(0)).collect() == []


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", r"a<b>\l \b"), (1, 1, "assistant", "</turn>"), (1, 2, "assistant", None), (1, None, "a>b", "<next/>"), (None, 1, None, ""), (2, 1, "user", "x"), (2, 1, "user", "x")]
    rows = chat.chat_format(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    rows = rows.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("segments")).alias("loss")).collect()
    assert {r.conv_id: [tuple(x) for x in r.t] for r in rows} == {
        1: [("a>b", "<next/>"), ("user", r"a<b>\l \b"), ("assistant", "</turn>"), ("assistant", "")], None: [("", "")], 2: [("user", "x"), ("user", "x")]}
    assert {r.conv_id: r.loss for r in rows} == {1: "</turn>", None: "", 2: ""}


def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in base[i % 30] + rng.normal(size=8) * 0.15], i % 3) for i in range(300)]
    nan = float("nan")
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [nan] * 8, 1), (303, [None] * 8, 1), (304, rows[0][1], 0), rows[5], (306, rows[7][1], None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def plain(spark):
    return [(r.vec_id, np.array(r.embedding), r.label) for r in vectors(spark).collect()
            if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]


def cosine(a, b):
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_nearest(spark):
    known = {v: x for v, x, _ in plain(spark)}
    want = {q: [v for _, v in sorted((-round(cosine(x, y), 12), v) for v, y in known.items() if v != q)[:5]] for q, x in known.items() if q % 50 == 0}
    df = vectors(spark)
    got = {}
    for r in neighbours.nearest(df, df["vec_id"] % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want
    assert neighbours.nearest(df.limit(0), df["vec_id"] % 50 == 0).collect() == []


def test_vector_dedup(spark):
    rows = plain(spark)
    out = vector_dedup.near_duplicates(vectors(spark)).collect()
    assert len(out) == vectors(spark).count()
    links = Counter()
    for i, (v, x, a) in enumerate(rows):
        for j, (w, y, b) in enumerate(rows):
            links[v] += i != j and a is not None and a == b and cosine(x, y) >= 0.93
    found = sum(r.n_links for r in out if r.vec_id != 5)
    true = sum(n for v, n in links.items() if v != 5)
    assert 0.9 * true <= found <= true
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert vector_dedup.near_duplicates(vectors(spark).limit(0)).collect() == []


def test_pipeline(spark, data):
    import corpus_pipeline as P

    rows = P.run(spark, data)
    assert rows.count() > 0
    assert [n for n, _ in P.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "byte-level BPE"]
    empty = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, data)
    assert empty.count() == 0


def test_nearest_relaxed(spark):
    """Recall falls as the pruning radius shrinks, and one restores all."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 6))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for q in range(0, 3000, 50):
        score = u @ u[q]
        score[q] = -9
        want[q] = set(np.argsort(-score)[:5].tolist())
    recall = {}
    for factor in (0.0, 0.5, 0.8, 1.0):
        got = neighbours.nearest(df, df["vec_id"] % 50 == 0, factor=factor).collect()
        recall[factor] = sum(r.vec_id in want[r.query_id] for r in got) / (5 * len(want))
    assert recall[1.0] == 1 and recall[0.8] >= 0.95 and recall[0.5] >= 0.7
    assert recall[0.0] <= recall[0.5] <= recall[0.8] <= recall[1.0]


def test_repeated_bytes_deals_one_id_by_text(spark):
    from draftlens.llm.substring_dedup import sliced

    docs = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert sliced(docs, "doc_id", "text", 32, by_text=True).select("slice").distinct().count() == 32


def test_slices_follow_bytes(spark):
    from draftlens.llm.common import partitions, slices

    docs = spark.range(100).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    assert slices(docs, "text", size=10_000) == 100 and slices(docs, "text") == 4 * partitions(spark) == slices(docs.limit(0), "text")
