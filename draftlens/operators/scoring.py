"""Edit scores between generated and published text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens.functions.kernels import WLCS_POWER, edit_counts, edit_scores, gram_matches, lcs_score, wlcs_score
from draftlens.functions.text import content_words, let, word_ngrams
from draftlens.operators.joins import MOST_RANKED, null_safe, packed
from draftlens.sources.wordlists import STOPWORDS

ORDERS = (1, 2, 3, 4)
# The automatic metrics in report order.
AUTO_METRICS = ("user", "rouge-l", "rouge-w", "rouge-1", "rouge-2", "rouge-3", "rouge-4")


def column_of(metric: str) -> str:
    """``rouge-1`` as a column prefix: ``rouge_1``."""
    return metric.replace("-", "_")


def prf(matched: Column, h_total: Column, r_total: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where a side is empty."""
    zero = F.lit(0.0)
    p = F.when(h_total > 0, matched / h_total).otherwise(zero)
    r = F.when(r_total > 0, matched / r_total).otherwise(zero)
    return p, r, f1(p, r)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def edit_pairs(suggestion: DataFrame, stored: DataFrame | None = None, in_place: bool = False) -> DataFrame:
    """Finalized suggestions as (id, suggestion_id, generated, finalized), spread over tasks of like cost.

    Suggestions with stored scores are left out before any text moves. This one
    exchange carries each text once. The kernels cost the product of both lengths,
    so pairs are packed by an estimate of it: the square of the generated text's
    length, which needs no published text. That column is read once more for it.
    With ``in_place`` pairs stay where they are, for suggestions that were dealt to tasks
    before (``Tables.suggestion_by_id``) and scores whose cost follows the length.
    """
    done = suggestion.where("is_finalized").select("id", F.col("uuid").alias("suggestion_id"), "generated", "finalized")
    if stored is not None:
        done = done.join(stored.select("suggestion_id"), "suggestion_id", "left_anti")
    if in_place:
        return done
    length = F.coalesce(F.length("generated"), F.lit(0)).cast("double") + 1
    return packed(done, length * length, 2 * F.coalesce(F.octet_length("generated"), F.lit(0)), "id")


def _content(pairs: DataFrame, *keep: str) -> DataFrame:
    """Both texts without stop words, as words with single spaces."""
    words = lambda c: content_words(F.col(c), STOPWORDS)
    return pairs.select("id", "suggestion_id", *keep, words("generated").alias("h"), words("finalized").alias("r"))


def _count(words: str) -> Column:
    return F.when(F.col(words) == "", 0).otherwise(F.size(F.split(words, " ")))


def rouge_n(pairs: DataFrame) -> DataFrame:
    """ROUGE-1..4: clipped n-gram matches of stop-word-free text.

    The native form: the grams of a pair are sorted and counted within its row, so none
    moves and none is held beyond its pair. Pairs of one id count as one text. Ids that
    several pairs have are looked up first, by one job over narrow rows; only their
    grams meet in an exchange. ``score_edits`` with the same metrics is faster; a test
    holds both equal.
    """
    several = pairs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    ids = several.count()
    if not ids:
        return _grams_in_row(pairs)
    several = F.broadcast(several) if ids <= MOST_RANKED else several
    alone, together = (null_safe(pairs, several, ["id"], how) for how in ("left_anti", "left_semi"))
    return _grams_in_row(alone).unionByName(_grams_by_id(together))


def _grams_in_row(pairs: DataFrame) -> DataFrame:
    """ROUGE-1..4 of each pair on its own."""
    raw = _content(pairs).select("suggestion_id", _sorted_matches(F.col("h"), F.col("r")).alias("m"),
                                 *[F.coalesce(_count(x), F.lit(0)).alias(f"{x}n") for x in "hr"])
    return raw.select("suggestion_id", *[c for n in ORDERS for c in _named(
        f"rouge_{n}", *prf(F.col(f"m.m{n}"), F.col("hn") - n + 1, F.col("rn") - n + 1))])


def _sorted_matches(h: Column, r: Column) -> Column:
    """Clipped matches of 1- to 4-grams (m1 to m4) of two texts with single spaces.

    A run of four words begins at each word; marks that no word holds fill the last
    ones and differ by text, so they match nothing. One sort serves all orders: runs that
    begin with the same n words are neighbours, and a run of ``r`` ends with a space and
    so comes right after those of ``h`` that equal it. Where the two meet, one of each
    is taken out, a match in every order. What is left is walked once.
    """
    most, space = ORDERS[-1], F.lit(" ")
    runs = lambda text, mark: word_ngrams(F.concat(F.coalesce(text, F.lit("")), F.lit(f" {mark}" * (most - 1))), most)
    of_r = lambda run: F.endswith(run, space)
    both = F.sort_array(F.concat(runs(h, "#"), F.transform(runs(r, "$"), lambda run: F.concat(run, space))))

    def left(runs: Column) -> Column:
        apart = lambda run, i: F.when(of_r(run), F.concat(F.get(runs, i - 1), space) != run).otherwise(
            F.concat(run, space) != F.get(runs, i + 1))
        return F.filter(runs, lambda run, i: F.coalesce(apart(run, i), F.lit(True)))

    def walked(runs: Column, met: Column) -> Column:
        zero = F.struct(*[F.lit(0).alias(f"b{n}") for n in ORDERS], *[met.alias(f"m{n}") for n in ORDERS])
        steps = F.transform(runs, lambda run, i: F.when(of_r(run), -_shared(run, F.get(runs, i - 1)) - 1).otherwise(
            _shared(run, F.get(runs, i - 1)) + 1))
        return F.aggregate(steps, zero, _walk)

    return let(both, lambda runs: let(left(runs), lambda rest: walked(rest, F.shiftright(F.size(runs) - F.size(rest), 1))))


def _shared(run: Column, before: Column) -> Column:
    """How many words two runs share from their start; 0 without a run before."""
    same = lambda n: F.substring_index(run, " ", n) == F.substring_index(before, " ", n)
    count = F.lit(ORDERS[-1] - 1)
    for n in reversed(ORDERS[:-1]):
        count = F.when(same(n), count).otherwise(n - 1)
    return F.when(same(ORDERS[-1]), ORDERS[-1]).otherwise(count)


def _walk(state: Column, step: Column) -> Column:
    """The state after one more run: for each order the open runs of its stretch and the matches so far.

    ``step`` is one more than the words shared with the run before, negative for a run of
    ``r``. Open runs (b1 to b4) count up for ``h`` and down for ``r``; a run that meets open
    ones of the other text is a match. Orders above the shared words begin anew.
    """
    def after(shared: int, sign: int) -> Column:
        opened = lambda n: state[f"b{n}"] + sign if n <= shared else F.lit(sign)
        hit = lambda n: state[f"b{n}"] < 0 if sign > 0 else state[f"b{n}"] > 0
        found = lambda n: F.when(hit(n), state[f"m{n}"] + 1).otherwise(state[f"m{n}"]) if n <= shared else state[f"m{n}"]
        return F.struct(*[opened(n).alias(f"b{n}") for n in ORDERS], *[found(n).alias(f"m{n}") for n in ORDERS])

    def side(sign: int) -> Column:
        out = after(ORDERS[-1], sign)
        for shared in range(ORDERS[-1]):
            out = F.when(step == sign * (shared + 1), after(shared, sign)).otherwise(out)
        return out

    return F.when(step > 0, side(1)).otherwise(side(-1))


def _grams_by_id(pairs: DataFrame) -> DataFrame:
    """ROUGE-1..4 of the pairs of each id taken as one.

    Grams are counted by (id, gram); a gram's spaces tell its order, so it is not part
    of the key. One more row per pair, of order 0, carries the suggestion id, so texts
    without n-grams keep a row too.
    """
    h, r = F.col("h"), F.col("r")
    part = lambda side, grams: F.struct(F.lit(side).alias("side"), grams.alias("grams"))
    lists = _content(pairs).select("id", F.inline(F.array(
        part(0, F.array(F.concat(F.lit("#"), "suggestion_id"))),
        *[part(side, word_ngrams(text, n)) for n in ORDERS for side, text in ((0, h), (1, r))])))
    grams = lists.select("id", "side", F.explode("grams").alias("gram"))
    counts = grams.groupBy("id", "gram").agg(F.sum(1 - F.col("side")).alias("h"), F.sum("side").alias("r"))
    named = F.startswith("gram", F.lit("#"))
    spaces = F.length("gram") - F.length(F.replace("gram", F.lit(" "), F.lit("")))
    counts = counts.withColumn("n", F.when(named, 0).otherwise(spaces + 1))
    of = lambda n, value: F.sum(F.when(F.col("n") == n, value).otherwise(0))
    sums = counts.groupBy("id").agg(
        F.max(F.when(F.col("n") == 0, F.substr("gram", F.lit(2)))).alias("suggestion_id"),
        *[
            agg
            for n in ORDERS
            for agg in (
                of(n, F.least(h, r)).alias(f"m{n}"), of(n, h).alias(f"h{n}"), of(n, r).alias(f"r{n}"),
            )
        ])
    out = ["suggestion_id"]
    for n in ORDERS:
        p, rec, f = prf(F.col(f"m{n}"), F.col(f"h{n}"), F.col(f"r{n}"))
        out += [p.alias(f"rouge_{n}_p"), rec.alias(f"rouge_{n}_r"), f.alias(f"rouge_{n}_f")]
    return sums.select(*out)


def _named(metric: str, p: Column, r: Column, f: Column) -> list[Column]:
    return [p.alias(f"{metric}_p"), r.alias(f"{metric}_r"), f.alias(f"{metric}_f")]


ROUGE_N = tuple(f"rouge-{n}" for n in ORDERS)


def score_edits(pairs: DataFrame, metrics=AUTO_METRICS) -> DataFrame:
    """The given metrics of each pair, in one Arrow pass over the texts.

    ROUGE-L and ROUGE-W follow Lin (2004) over whole texts without stop words;
    for W a run of k matches weighs k**1.2 and ratios are taken back by the
    inverse power. The user score counts tokens kept in runs with a content
    word against both token counts, stop words included. ROUGE-1..4 equal
    ``rouge_n``; since the texts pass through Python anyway, counting here saves
    exploding them into grams and a join.
    """
    texts = _content(pairs, "generated", "finalized")
    h, r = F.col("h"), F.col("r")
    kernels = {}
    for metric in metrics:
        if metric in ROUGE_N:
            kernels["grams"] = gram_matches(h, r)
        elif metric == "rouge-l":
            kernels["lcs"] = lcs_score(h, r)
        elif metric == "rouge-w":
            kernels["wlcs"] = wlcs_score(h, r)
        else:
            kernels["s"] = edit_counts(F.col("generated"), F.col("finalized"))
    raw = texts.select("suggestion_id", _count("h").alias("hn"), _count("r").alias("rn"),
                       *[c.alias(name) for name, c in kernels.items()])
    hn, rn = F.col("hn"), F.col("rn")
    back = lambda total: F.when(
        total > 0, F.least(F.lit(1.0), F.pow(F.col("wlcs") / F.pow(total.cast("double"), F.lit(WLCS_POWER)), F.lit(1.0 / WLCS_POWER)))
    ).otherwise(F.lit(0.0))
    out = []
    for metric in metrics:
        name = column_of(metric)
        if metric in ROUGE_N:
            n = int(metric[-1])
            out += _named(name, *prf(F.get("grams", F.lit(n - 1)), hn - n + 1, rn - n + 1))
        elif metric == "rouge-l":
            out += _named(name, *prf(F.col("lcs"), hn, rn))
        elif metric == "rouge-w":
            out += _named(name, back(hn), back(rn), f1(back(hn), back(rn)))
        else:
            out += _named(name, *prf(F.col("s.matched"), F.col("s.h_tokens"), F.col("s.r_tokens")))
    return raw.select("suggestion_id", *out)


def rouge_l(pairs: DataFrame) -> DataFrame:
    return score_edits(pairs, ("rouge-l",))


def rouge_w(pairs: DataFrame) -> DataFrame:
    return score_edits(pairs, ("rouge-w",))


def user_score(pairs: DataFrame) -> DataFrame:
    return score_edits(pairs, ("user",))


def diff_ops(pairs: DataFrame) -> DataFrame:
    """The edits of each pair in order, one row each."""
    ops = pairs.select("suggestion_id", edit_scores(F.col("generated"), F.col("finalized")).alias("s"))
    return ops.select("suggestion_id", F.posexplode("s.ops").alias("pos", "o")).select(
        "suggestion_id", "pos", "o.op", "o.tokens", "o.text")


def diff_summary(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """Token totals of each kind of edit by model.

    Totals per suggestion come first, so the join to models is narrow.
    """
    per = diff_ops(pairs).groupBy("suggestion_id", "op").agg(
        F.count("*").alias("edits"), F.sum("tokens").alias("tokens"))
    return per.join(models, "suggestion_id").groupBy("model_name", "op").agg(
        F.sum("edits").alias("edits"), F.sum("tokens").alias("tokens"))
