import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlens.functions import kernels as N
from draftlens.operators import scoring as G
from draftlens.operators import statistics as T
from draftlens.operators import store as S
from draftlens.operators.joins import dealt, packed
from draftlens.sources.tables import Tables

METRICS = ("user", "rouge-l", "rouge-w", "rouge-1", "rouge-2", "rouge-3", "rouge-4")


def table_lcs(a, b, f=None):
    """The textbook tables: plain LCS, or weighted with f."""
    c = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    w = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            if x == y:
                k = w[i - 1][j - 1]
                c[i][j] = c[i - 1][j - 1] + (f(k + 1) - f(k) if f else 1)
                w[i][j] = k + 1
            else:
                c[i][j] = max(c[i - 1][j], c[i][j - 1])
    return c[-1][-1]


def word_pairs(seed, count, size, letters="abcdef"):
    rng = random.Random(seed)
    side = lambda: [rng.choice(letters) for _ in range(rng.randint(0, size))]
    return [(side(), side()) for _ in range(count)]


def test_lcs_and_wlcs_match_the_tables():
    pairs = word_pairs(1, 300, 25) + word_pairs(2, 5, 120)
    got = N.weighted_lcs(pairs)
    for (a, b), w in zip(pairs, got):
        assert N.lcs_length(a, b) == table_lcs(a, b)
        assert w == pytest.approx(table_lcs(a, b, lambda k: k**1.2))


def test_wlcs_groups_do_not_mix(monkeypatch):
    pairs = word_pairs(3, 60, 30)
    alone = [N.weighted_lcs([p])[0] for p in pairs]
    monkeypatch.setattr(N, "WLCS_CELLS", 64)
    assert N.weighted_lcs(pairs) == pytest.approx(alone)


def test_shared_grams_match_counting():
    for a, b in word_pairs(4, 100, 20, "abc"):
        for n, got in zip((1, 2, 3, 4), N.shared_grams(a, b)):
            grams = lambda t: [tuple(t[i:i + n]) for i in range(len(t) - n + 1)]
            left, right = grams(a), grams(b)
            assert got == sum(min(left.count(g), right.count(g)) for g in set(left))


def test_greedy_matches_brute_force():
    rng = random.Random(5)

    def brute(published, generated):
        left, found = set(range(len(generated))), []
        for i, s in enumerate(published):
            best, hit = 0, None
            for j in sorted(left):
                o = len(N._grams(s, 3) & N._grams(generated[j], 3))
                if o > best:
                    best, hit = o, j
            if hit is not None:
                found.append((i, hit))
                left.remove(hit)
        return found

    for _ in range(300):
        say = lambda: " ".join(rng.choice("xyz") for _ in range(rng.randint(0, 9)))
        a, b = ([say() for _ in range(rng.randint(0, 8))] for _ in range(2))
        assert N.greedy_matches(a, b) == brute(a, b)
    assert N.greedy_matches(["a b c", "a b c", "a b c"], ["a b c", "a b c"]) == [(0, 0), (1, 1)]


def test_edit_ops():
    h, r, matched, ops = N.edit_ops("The old oak fell.", "An old oak slowly fell!")
    assert (h, r, matched) == (4, 5, 3)
    assert [(o["op"], o["text"]) for o in ops] == [
        ("delete", "The"), ("insert", "An"), ("keep", "old oak"), ("insert", "slowly"), ("keep", "fell")]
    assert N.edit_ops("the a of", "the a of")[2] == 0  # only stop words shared
    assert N.edit_ops("", "")[:3] == (0, 0, 0)


@pytest.mark.parametrize("skip", [False, True])
def test_long_and_short_texts_are_matched_alike(skip):
    """No rule for popular tokens of long texts, unless it is asked for."""
    rng = random.Random(6)
    h = " ".join(rng.choice("pq") + str(rng.randint(0, 9)) for _ in range(260))
    r = " ".join(rng.choice("pq") + str(rng.randint(0, 9)) for _ in range(260))
    want = sum(b - a for tag, a, b, *_ in SequenceMatcher(None, h.split(), r.split(), autojunk=skip).get_opcodes() if tag == "equal")
    assert N.edit_ops(h, r, skip)[2] == want


def test_p_values():
    # r, n and two-sided p from the t distribution tables.
    got = N.pearson_p(np.array([0.5, 0.632, 0.0, 1.0, 0.3]), np.array([10, 10, 9, 5, 2]))
    assert got[0] == pytest.approx(0.1411, abs=1e-4)
    assert got[1] == pytest.approx(0.05, abs=2e-4)
    assert list(got[2:]) == [1.0, 0.0, 1.0]


PAIRS = [
    (1, "s1", "The quick brown fox jumps over lazy dogs.", "A quick brown fox leaps over lazy cats."),
    (2, "s2", "Same words stay.", "Same words stay."),
    (3, "s3", "", "Something new."),
    (4, "s4", "the a of", "the a of"),
    (5, "s5", "red red red blue", "red blue blue red"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "id long, suggestion_id string, generated string, finalized string").repartition(3, "id")


def test_native_and_fused_ngrams_agree(pairs):
    cols = ["suggestion_id"] + [f"rouge_{n}_{x}" for n in (1, 2, 3, 4) for x in "prf"]
    native = sorted(map(tuple, G.rouge_n(pairs).select(cols).collect()))
    fused = sorted(map(tuple, G.score_edits(pairs, G.ROUGE_N).select(cols).collect()))
    assert native == fused
    assert len(native) == len(PAIRS)


def test_score_values(pairs):
    rows = {r.suggestion_id: r for r in G.score_edits(pairs).collect()}
    one = rows["s1"]  # content words: quick brown fox jumps lazy dogs / quick brown fox leaps lazy cats
    assert one.rouge_1_p == pytest.approx(4 / 6) and one.rouge_2_r == pytest.approx(2 / 5)
    assert one.rouge_3_f == pytest.approx(1 / 4) and one.rouge_4_p == 0
    assert one.rouge_l_p == pytest.approx(4 / 6)
    assert one.rouge_w_p == pytest.approx(((3**1.2 + 1) / 6**1.2) ** (1 / 1.2))
    assert one.user_p == pytest.approx(5 / 8)
    same = rows["s2"]
    assert [same[f"{G.column_of(m)}_f"] for m in METRICS] == pytest.approx([1, 1, 1, 1, 1, 1, 0])
    assert all(rows["s3"][f"{G.column_of(m)}_f"] == 0 for m in METRICS)
    assert all(rows["s4"][f"{G.column_of(m)}_f"] == 0 for m in METRICS)
    assert rows["s5"].rouge_1_p == pytest.approx(3 / 4)
    for row in rows.values():
        for m in METRICS:
            assert all(0 <= row[f"{G.column_of(m)}_{x}"] <= 1 for x in "prf")
        assert row.rouge_l_p <= row.rouge_1_p + 1e-12


def test_correlations(spark):
    schema = "model_name string, relevance double, likeability double, rouge_1 double"
    rows = [("a", 1.0, 5.0, 10.0), ("a", 2.0, 5.0, 20.0), ("a", 3.0, 5.0, 29.0), ("b", 4.0, None, 41.0), ("b", None, 5.0, 3.0)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.metric1, r.metric2): r for r in T.correlations(df, ("relevance", "likeability", "rouge-1")).collect()}
    assert got["relevance", "rouge-1"].r == pytest.approx(np.corrcoef([1, 2, 3, 4], [10, 20, 29, 41])[0, 1])
    constant = got["relevance", "likeability"]
    assert constant.n == 3 and constant.r is None and constant.p is None
    by = {(r.model_name, r.metric1, r.metric2): r for r in T.correlation_flags(
        T.correlations(df, ("relevance", "likeability", "rouge-1"), by_model=True)).collect()}
    single = by["b", "relevance", "rouge-1"]
    assert single.n == 1 and single.r is None and single.p05 is None
    assert ("b", "relevance", "likeability") not in by
    assert by["a", "relevance", "rouge-1"].p05


def test_matches_stay_one_task_free_of_repeats(spark):
    line = "Many words repeat here."
    text = " ".join([line] * 2000)
    df = spark.createDataFrame([("s", text, text)], "suggestion_id string, generated string, finalized string")
    got = T.sentence_match(df)
    assert got.count() == 2000 and got.where("published <> generated").count() == 0


def test_packed_tasks_cost_alike(spark):
    """On a skewed table the longest task is within twice the median, but for one costly row."""
    rng = random.Random(4)
    rows = [(i, int(rng.paretovariate(0.9) * 100)) for i in range(4000)]
    total = sum(n for _, n in rows)
    rows = [(i, min(n, total // 64)) for i, n in rows]
    df = spark.createDataFrame(rows, "id long, n long")
    out = packed(df, F.col("n").cast("double"), F.col("n"), "id", task_bytes=1 << 40)
    sums = [r[0] for r in out.groupBy(F.spark_partition_id()).agg(F.sum("n")).collect()]
    assert out.count() == len(rows) and sorted(map(tuple, out.collect())) == rows
    assert max(sums) <= 2 * np.median(sums) + max(n for _, n in rows)
    by_bytes = packed(df, F.col("n").cast("double"), F.col("n"), "id", task_bytes=total // 200)
    assert by_bytes.rdd.getNumPartitions() >= 100
    assert packed(df.limit(0), F.col("n").cast("double"), F.col("n"), "id").count() == 0


def test_correlations_of_pairs(spark):
    """Pairwise complete rows, by one aggregate; a row for each metric, not for each pair."""
    table = spark.createDataFrame([("a", 1.0, 2.0, None), ("a", 2.0, 1.0, 3.0), ("b", 3.0, 5.0, 4.0)], "model_name string, relevance double, fluency double, rouge_1 double")
    matrix = T.correlations(table, ("relevance", "fluency", "rouge-1"))
    assert matrix._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    got = {(r.metric1, r.metric2): (r.n, r.r) for r in matrix.collect()}
    assert got["relevance", "fluency"] == (3, pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1]))
    assert got["fluency", "rouge-1"] == (2, pytest.approx(1.0))


def test_p_of_many_pairs():
    """For large n the t distribution is normal; no digits are lost there."""
    from math import erfc, sqrt

    for n, r in ((10**7, 5e-4), (10**9, 5e-5), (10**12, 2e-6)):
        t = r * sqrt((n - 2) / (1 - r * r))
        assert N.pearson_p(np.array([r]), np.array([n]))[0] == pytest.approx(erfc(t / sqrt(2)), rel=1e-4)


def test_increments_store_each_score_once(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = lambda *ids: spark.createDataFrame([(i, 0.5) for i in ids], "suggestion_id string, user_p double")
    assert S.stored_increments(spark, path) is None
    for name, ids in (("a", "xy"), ("b", "yz"), ("b", "yz"), ("a", "xy")):
        S.write_increment(rows(*ids), path, name)
    assert sorted(r.suggestion_id for r in S.stored_increments(spark, path).collect()) == ["x", "y", "z"]


def by_counting(rows):
    """ROUGE-1..4 of each id by plain counting, the texts of an id taken as one."""
    from collections import Counter

    counts, out = {}, []
    for uid, name, *texts in rows:
        names, sides = counts.setdefault(uid, (set(), ({}, {})))
        names.add(name)
        for side, text in zip(sides, texts):
            words = [w for w in (text or "").split() if w not in N._STOP]
            for n in G.ORDERS:
                side.setdefault(n, Counter()).update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    for names, (h, r) in counts.values():
        row = [max((x for x in names if x is not None), default=None)]
        for n in G.ORDERS:
            m, hn, rn = sum((h[n] & r[n]).values()), sum(h[n].values()), sum(r[n].values())
            p, q = m / hn if hn else 0.0, m / rn if rn else 0.0
            row += [p, q, 2 * p * q / (p + q) if p + q else 0.0]
        out.append(tuple(row))
    return sorted(out, key=str)


def native_rows(spark, rows):
    df = spark.createDataFrame(rows, "id long, suggestion_id string, generated string, finalized string")
    return sorted((tuple(r) for r in G.rouge_n(df).collect()), key=str)


def odd_texts(seed, count):
    """Texts of few and of many words, short and long, equal, unlike, repeated, empty and missing."""
    rng = random.Random(seed)
    for i in range(count):
        words = ["b", "bb", "c", "bc", "e", "the"] if i % 2 else [f"w{j}" for j in range(40)]
        side = lambda: " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 9, 60))))
        h = side()
        yield rng.choice((h, None, h + " " + h)), rng.choice((h, side(), side() + " " + h, h + " " + side() + " " + h, None))


def test_native_ngrams_match_counting(spark):
    rows = [(i, f"s {i}", h, r) for i, (h, r) in enumerate(odd_texts(8, 400))]
    got, want = native_rows(spark, rows), by_counting(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert g[1:] == pytest.approx(w[1:])


def test_native_ngrams_of_ids_that_repeat(spark):
    """Pairs of one id, a missing one too, count as one text; other ids stay apart."""
    rng = random.Random(9)
    ids = [None, None, None, 1, 1, 2, 2, 2, 3]
    rows = [(ids[i] if i < len(ids) else 100 + i, rng.choice(("s#", "a b", None)), h, r) for i, (h, r) in enumerate(odd_texts(10, 40))]
    got, want = native_rows(spark, rows), by_counting(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert g[1:] == pytest.approx(w[1:])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_native_ngrams_do_not_move(spark, data):
    """No gram is a row, and texts move once, also where no join is broadcast."""
    rows = [(i, f"s{i}", "red oak red", "red oak") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, suggestion_id string, generated string, finalized string").repartition(3)
    assert exchanges(G.rouge_n(df)) == exchanges(df) == 1
    t, kept = Tables(spark, data), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # One of documents and one of labels.
        assert exchanges(G.rouge_n(G.edit_pairs(t.suggestion_by_id, in_place=True))) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_suggestions_dealt_by_id_are_the_suggestions(spark, data, tmp_path):
    t = Tables(spark, data)
    assert sorted(map(str, t.suggestion_by_id.collect())) == sorted(map(str, t.suggestion.collect()))
    t.suggestion.limit(30).write.parquet(str(tmp_path / "suggestion.parquet"))
    stored = Tables(spark, str(tmp_path))
    assert sorted(map(str, stored.suggestion_by_id.collect())) == sorted(map(str, stored.suggestion.collect()))


def test_dealt_tasks_hold_whole_keys_of_bounded_bytes(spark):
    df = spark.createDataFrame([(i % 500, 100) for i in range(4000)], "id long, n long")
    out = dealt(df, F.col("n"), "id", task_bytes=4000)
    assert out.rdd.getNumPartitions() == 100 and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    assert out.select("id", F.spark_partition_id().alias("t")).distinct().count() == 500
    assert dealt(df.limit(0), F.col("n"), "id").count() == 0
