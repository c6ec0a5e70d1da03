"""License scans, centroid clustering and hard negatives against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlens.llm import centroids, hard_negatives, license_scan

LIST = "vec_id long, embedding array<double>, label int, vec string, cluster string, shard int"


def plain_places(text, templates, base, idf):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    out = []
    for is_base, label, t, at, key, must in license_scan.all_templates(templates, base):
        for i in range(len(words) - len(key) + 1):
            if words[i:i + len(key)] == key:
                s = i - at
                have = sum(idf[w] for j, w in enumerate(t) if 0 <= s + j < len(words) and words[s + j] == w)
                score = have / sum(idf[w] for w in t)
                holds = is_base or (score >= 0.8 and all(s + o >= 0 and words[s + o:s + o + len(p)] == p for o, p in must))
                out.append((i, is_base, label, None if is_base else score, holds))
    return len(words), sorted(out, key=str)


def test_license_scan(spark):
    texts = ["Released under the MIT License.", "mit license mit license MIT-LICENSE", "der MIT Lizenz mit license", None, "", " \n",
             "Licensed under the Apache License, Version 2.0", "the GNU General Public License, version 3 general public license", "under the Apache license version 3",
             "All Rights reserved all rights", "LICENSED under CC BY-NC 4.0 licensed under cc by 4 0", "free software", "\u212Ait license mit licen\u0130e",
             "Released under the MIT License.", "é" * 50, "mit license " * 3000, "word " * 200_000 + "mit license"]
    rows = [(i, t, "x", 1, []) for i, t in enumerate(texts)] + [(None, "mit license", None, None, None), (0, "mit license", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, found int, hits array<int>")
    split = [set(re.split(r"[^a-z0-9\x80-\U0010ffff]+", (r[1] or "").lower())) for r in rows]
    vocabulary = {w for t in license_scan.all_templates() for w in t[2]}
    idf = {w: license_scan.weight(len(rows), sum(w in s for s in split)) for w in vocabulary}
    got = sorted(((r.doc_id, r.n_words, sorted(map(tuple, r.places), key=str)) for r in license_scan.license_scan(docs).collect()), key=str)
    want = sorted(((r[0], *plain_places(r[1], license_scan.TEMPLATES, license_scan.BASE, idf)) for r in rows), key=str)
    assert got == want
    assert sum(p[1] for _, _, ps in got for p in ps) > 3000
    assert license_scan.license_scan(docs.limit(0)).collect() == []


def test_license_scan_other_templates(spark):
    """A key phrase inside a template, a mandatory phrase before it, one word only."""
    templates = (("a", "x y z", "y", ("x y",)), ("b", "q q r", "q r", ()))
    docs = spark.createDataFrame([(1, "y"), (2, "x y z x y"), (3, "q q r q r"), (4, "z y x")], "doc_id long, text string")
    got = {r.doc_id: [(p.start, p.label, p.whole) for p in r.places] for r in license_scan.license_scan(docs, templates=templates, base=()).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, "a", False)], 2: [(1, "a", True), (4, "a", False)], 3: [(1, "b", True), (3, "b", False)], 4: [(1, "a", False)]}


def test_nearest_centroid_walk():
    rng = np.random.default_rng(1)
    for k, spread in ((1, 5), (8, 3), (8, 1000), (5, 0)):
        x, c = rng.integers(-spread - 1, spread + 2, (500, 6)), rng.integers(-spread, spread + 1, (k, 6))
        best, far = centroids.nearest(x, c)
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (best == d.argmin(1)).all() and (far == d.min(1)).all()


def plain_clusters(rows, k=8, dims=64, rounds=10):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    return [(i, j, d, sum(e for _, o, e in out if o == j), sum(e for _, _, e in out), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out]


def test_centroid_clustering(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(120)]
    rows += [rows[3], rows[3], (5, rows[9][1]), (None, rows[1][1]), (200, None), (201, [1.0] * 63), (202, [None] * 64), (203, [float("nan")] * 64),
             (204, [float("inf")] + [0.0] * 63), (205, [0.0] * 64), (206, [-100.0] * 64), (207, [])]
    df = spark.createDataFrame([(i, v, 0, "x", "y", 1) for i, v in rows], LIST)
    got = [tuple(int(v) if k in (3, 4) else v for k, v in enumerate(r)) for r in centroids.cluster(df)[0].collect()]
    assert sorted(got, key=str) == sorted(plain_clusters(rows), key=str)


def test_centroid_clustering_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 64), (3, [1e300] * 64)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.cluster, r.distance) for r in centroids.cluster(df)[0].collect()}
    assert got[1] == got[2] and got[1][1] == 0 and got[3][1] == 0
    assert centroids.cluster(df.limit(0))[0].collect() == []
    assert [f.name for f in centroids.cluster(df.limit(0))[0].schema] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain_negatives(rows, anchors):
    dims = max(len(v) for _, v, _ in rows)
    x = np.array([np.floor(256 * np.array(list(v) + [0.0] * (dims - len(v)))) for _, v, _ in rows]).astype(object)
    ids, labels, out = [i for i, _, _ in rows], [n for _, _, n in rows], []
    for a in range(len(rows)):
        if not anchors(ids[a]):
            continue
        score = [int((x[a] * x[b]).sum()) for b in range(len(rows))]
        order = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (-score[b], ids[b]))
        for p in [b for b in order if labels[b] == labels[a]][:5]:
            hard = [b for b in order if labels[b] != labels[a] and 80 * score[p] <= 100 * score[b] <= 100 * score[p]][:5]
            out += [(ids[a], ids[p], r + 1, ids[b], score[p], score[b]) for r, b in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims", "copies", "grain"), [(700, 8, 0, 0), (500, 3, 260, 0), (400, 5, 0, 1), (300, 1, 0, 0)])
def test_hard_negatives(spark, monkeypatch, n, dims, copies, grain):
    """Cells, shards in parts, blocks of anchors; copies and ties."""
    for name, value in (("SHARD", 50), ("CELL", 6), ("ASKS", 7), ("FIRST", 8), ("MORE", 16)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dims)) + 0.5
    x[:copies] = x[0]
    x = np.round(x, grain) if grain else x
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "a", "b", 0) for r in rows], LIST)
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 9 == 0).collect()))
    assert got == plain_negatives(rows, lambda i: i % 9 == 0) and len(got) > 100


def test_hard_negatives_odd_rows(spark):
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [1.0], 2), (3, [0.9, 0.6, 0.0], 2), (100, [0.0, 0.0], 1), (200, [-1.0, -1.0], 3)]
    odd = [(4, None, 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 1), rows[1]]
    df = spark.createDataFrame([(*r, "a", "b", 0) for r in rows + odd], LIST)
    assert sorted(map(tuple, hard_negatives.mine(df).collect())) == plain_negatives(rows, lambda i: i % 100 == 0)
    assert hard_negatives.mine(df.limit(0)).collect() == []
    assert hard_negatives.mine(df.where("label is null")).collect() == []
    big = spark.createDataFrame([(0, [1e300], "a"), (1, [1e300], "a"), (2, [1e299], "b")], "vec_id long, embedding array<double>, label string")
    assert [(r.positive_id, r.negative_id) for r in hard_negatives.mine(big).collect()] == [(1, 2)]
