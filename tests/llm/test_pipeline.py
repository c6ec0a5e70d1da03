"""The whole pipeline against a plain version of every stage, on one small input."""

import base64
import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from draftlens.llm import quality, rolling
from draftlens.llm.common import row_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECE = re.compile(rb"[\t-\r ]+|[0-9a-z\x80-\xff]+|[^\t-\r 0-9a-z\x80-\xff]+")
PRIOR, SHARE = 80, 0  # few texts, so the good model must start from little


def corpus():
    """Good texts, junk, exact and near copies, shared passages, odd rows."""
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeéou日") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = say(60)
    texts = [say(rnd.randint(90, 160)) for _ in range(70)]
    for i in range(0, 70, 9):
        texts[i] = f"{texts[i]} {passage}\n{say(40)}"
    texts += [texts[5], texts[5], texts[7].upper(), texts[11].replace(" ", "\t ", 3)]
    for i in range(20, 32):  # one word of a long text changes few bits, if any
        parts = texts[i].split()
        parts[rnd.randrange(len(parts))] = "other"
        texts.append(" ".join(parts))
    junk = len(texts)
    texts += ["".join(rnd.choice("$#%&* 0123456789<>") for _ in range(700)) for _ in range(12)]
    texts += [None, None, "", "   \n", "one", "ok " * 120]
    rows = [(i, t, "xx", [None, "a", "b", "B", "é"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    rows.append((None, say(50), None, "a", 1))
    return rows, [(i, 1, 0) for i in range(0, 70, 2)] + [(i, 0, 0) for i in range(junk, junk + 6)] + [(None, 1, 0), (10**6, 1, 0)]


def features(text):
    parts = [p for p in PIECE.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if p.strip()]
    one = [int(rolling.word_hashes(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]))[0]) for p in parts]
    two = [0 if a == b else int(rolling.mix(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) for a, b in zip(one[:-1], one[1:], strict=True)]
    return [h % quality.BUCKETS for h in one + two]


def importances(rows, labels):
    good_ids = {i for i, q, _ in labels if q == 1 and i is not None}
    found = [features(r[1]) for r in rows]
    raw, good = Counter(), Counter()
    for r, f in zip(rows, found, strict=True):
        raw.update(f)
        if r[0] in good_ids:
            good.update(f)
    n, n_raw, n_good = quality.BUCKETS, sum(raw.values()), sum(good.values())
    prior = quality.PRIOR + quality.SHARE * n_good

    def weight(b):
        share = (raw[b] + 1) / (n_raw + n)
        return math.log((good[b] + prior * share) / (n_good + prior) / share)

    return [math.fsum(map(weight, f)) * quality.SPAN / (len(f) + quality.SPAN) for f in found]


def keep_good(rows, labels, noise):
    importance = importances(rows, labels)
    key = [x + noise[r[0]] for x, r in zip(importance, rows, strict=True)]
    k = sum(x >= -2 for x in importance)
    cut = sorted(key, reverse=True)[k - 1]
    return [r for r, x in zip(rows, key, strict=True) if x >= cut]


def fingerprint(text):
    parts = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(parts[i:i + 4]) for i in range(max(1, len(parts) - 3))] if parts else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def keep_one(rows):
    prints = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            group[i] = min(group[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4)
    members = defaultdict(list)
    for r, g in zip(rows, group, strict=True):
        members[g].append(r)
    return [min(m, key=lambda r: (r[0] is None, r[0] or 0)) for m in members.values()]


def cut_repeats(rows, length=200):
    raw = [(r[1] or "").encode() for r in rows]
    count = Counter(b[s:s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, raw, strict=True):
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                gone[s:s + length] = [True] * length
        kept, at = [], 0
        for c in r[1] or "":
            size = len(c.encode())
            if not any(gone[at:at + size]):
                kept.append(c)
            at += size
        out.append((r[0], None if r[1] is None else "".join(kept), *r[2:]))
    return out


def mix(rows, hashes):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    size = {s: sum(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s) for s in sources}
    target, free = {}, set(sources)
    while True:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * size[s]}
        if not full:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in full}
        free -= full
    out = []
    for s in sources:
        goal = math.floor(target[s] + 0.5)
        epochs, rest = divmod(goal, size[s]) if size[s] else (0, 0)
        order = [r for r in rows if r[3] == s]
        order.sort(key=lambda r: hashlib.md5(f"mix:{f'row:{hashes[r]}' if r[0] is None else r[0]}".encode()).hexdigest())
        for r in order:
            w = WORD.findall(r[1] or "")
            out += [r] * (epochs if w else 0)
            if 0 < rest < len(w):
                out.append((r[0], " ".join(w[:rest]), *r[2:]))
            elif w and rest:
                out.append(r)
            rest -= min(rest, len(w))
    return out


def test_importance_as_shipped(spark):
    """Every weight of the model as it is set, short and long texts by one formula."""
    rows, labels = corpus()
    rows.append((500, "long " + " ".join(f"w{i % 97}" for i in range(60_000)), None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = quality.select(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = {r[:2]: x for r, x in zip(rows, importances(rows, labels), strict=True)}
    assert len(got) == len(rows) and all(abs(r.importance - want[r.doc_id, r.text]) < 1e-6 for r in got)


def test_buckets_grow(spark):
    small = spark.range(10).select(F.lit("word " * 10).alias("text"))
    large = spark.range(300).select(F.repeat(F.lit("word "), 400_000).alias("text"))
    assert quality.buckets(small, "text") == quality.BUCKETS < quality.buckets(large, "text") <= quality.MOST
    assert quality.buckets(small.limit(0), "text") == quality.BUCKETS


def test_quality_workers_take_little_memory(spark, monkeypatch):
    """Neither pass of the classifier lists the n-grams of a whole batch at once, or keeps much for later stages."""
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    passes = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: passes.append(run) or spark.createDataFrame([], schema))
    weights = quality.scored(docs, np.arange(quality.BUCKETS) / quality.BUCKETS)
    quality._counts(docs, "doc_id", "text", np.array([1]), quality.BUCKETS)
    assert weights.columns == [*docs.columns, "importance"]
    texts = [None, "", *(f"word {i} " * (i % 50) + "and, so on " * 300 for i in range(3000))]
    whole = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts), "source": pa.array(["x"] * len(texts))})
    assert whole.nbytes > 10 << 20
    for run, columns in zip(passes, (["doc_id", "text", "source"], ["doc_id", "text"]), strict=True):
        monkeypatch.setattr(rolling, "_POWERS", {})
        tracemalloc.start()
        out = list(run(iter([whole.select(columns)])))
        kept, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert most < 120 << 20 and kept < 40 << 20, (most, kept)
        if "source" in columns:
            got = pa.Table.from_batches(out)
            assert got.select(columns).equals(pa.Table.from_batches([whole]))
            alone = [pa.Table.from_batches(run(iter([whole.slice(i, 1)])))["importance"][0].as_py() for i in (0, 1, 2, 1500, 3001)]
            assert alone == [got["importance"][i].as_py() for i in (0, 1, 2, 1500, 3001)]


def test_pipeline_with_clashing_names(spark, tmp_path):
    """Columns named like what the stages make pass through all but the last one unchanged."""
    rows, labels = corpus()
    extra = "_row _key _nth _n _j _taken _copy row key kept importance doc size share rest slice component_id".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in extra})
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.where("doc_id IS NOT NULL").collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in extra), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_equals_its_plain_version(spark, tmp_path, monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    monkeypatch.setattr(quality, "PRIOR", PRIOR)
    monkeypatch.setattr(quality, "SHARE", SHARE)
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    noise = {r[0]: r[1] for r in docs.select("doc_id", quality.gumbel(docs["doc_id"], 17)).collect()}

    kept = keep_good(rows, labels, noise)
    single = keep_one(kept)
    cut = cut_repeats(single)
    left = spark.createDataFrame(cut, docs.schema)
    hashes = {tuple(r)[:-1]: r[-1] for r in left.select("*", row_hash(left)).collect()}
    mixed = mix(cut, hashes)
    # Every stage has something to do here.
    assert len(rows) > len(kept) > len(single) and cut != single and len(mixed) != len(cut)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r[0], r[3], r[1], tuple(own.encode_ordinary(r[1]))) for r in mixed)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert Counter((r.doc_id, r.source, r.text, tuple(r.ids)) for r in got) == want
