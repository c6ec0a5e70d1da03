"""Statistics over scores: means, correlations, histograms, the edit table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.functions.kernels import match_sentences, pearson_p_value
from draftlens.functions.text import split_sentences
from draftlens.operators.reports import RATING_TYPES, type_ordinal
from draftlens.operators.scoring import AUTO_METRICS, column_of

# The correlated metrics in report order.
CORRELATED = ("relevance", "likeability", "fluency", "coherence", "rouge-1", "rouge-2", "rouge-3",
              "rouge-4", "rouge-l", "rouge-w", "user")


def metric_table(keys: DataFrame, feedback: DataFrame, scores: DataFrame) -> DataFrame:
    """One narrow row per finalized suggestion and model, one column per metric.

    Ratings are numbers (an empty one is missing); automatic metrics are
    precision in percent.
    """
    rating = lambda t: F.when(F.length(t) > 0, F.col(t).try_cast("double")).alias(t)
    present = [m for m in AUTO_METRICS if f"{column_of(m)}_p" in scores.columns]
    auto = scores.select(
        "suggestion_id", *[(100 * F.col(f"{column_of(m)}_p")).alias(column_of(m)) for m in present])
    rows = keys.select(F.col("uuid").alias("suggestion_id"), "model_name")
    rated = feedback.select("suggestion_id", *[rating(t) for t in RATING_TYPES])
    return rows.join(rated, "suggestion_id", "left").join(auto, "suggestion_id", "left")


def avg_auto_metrics(table: DataFrame, metrics=AUTO_METRICS) -> DataFrame:
    """Mean, sample deviation and count of each automatic metric by model."""
    long = table.select("model_name", F.inline(F.array(*[
        F.struct(F.lit(m).alias("type"), F.col(column_of(m)).alias("score")) for m in metrics])))
    return long.groupBy("type", "model_name").agg(
        F.round(F.avg("score"), 2).alias("avg_rating"),
        F.round(F.stddev_samp("score"), 2).alias("rating_stddev"),
        F.count("score").alias("feedback_count"),
    )


def ratings_board(human: DataFrame, auto: DataFrame) -> DataFrame:
    """Human and automatic means as sections by type, best first."""
    order = RATING_TYPES + AUTO_METRICS
    both = human.unionByName(auto)
    return both.withColumn("section", type_ordinal(F.col("type"), order)).orderBy(
        "section", F.desc("avg_rating"), "model_name")


def ratings_rank(board: DataFrame, type: str) -> DataFrame:
    """One rating table, best model first."""
    return board.where(F.col("type") == type).orderBy(F.desc("avg_rating"), "model_name")


def correlations(table: DataFrame, metrics=CORRELATED, by_model: bool = False) -> DataFrame:
    """Pearson r and two-sided p of every pair of metrics.

    A row gives one row for each metric, beside all later ones, not one for each pair;
    one aggregate holds their co-moments over complete rows: counts, covariances and
    variances, which Spark merges from task to task as central moments. (One row for
    all 55 pairs needs 220 aggregates, whose code takes longer to compile than the
    whole job on small tables.) r is NULL for fewer than two rows or a constant column.
    """
    by, cols = ["model_name"] if by_model else [], [column_of(m) for m in metrics]
    later = range(1, len(cols))
    # As SQL: hundreds of column calls would cost more than the job.
    rows = [f"named_struct('i', {i}, 'x', {cols[i]}, " + ", ".join(f"'y{j}', {cols[j] if j > i else 'CAST(NULL AS DOUBLE)'}" for j in later) + ")" for i in range(len(cols) - 1)]
    sums = []
    for j in later:
        x, y = f"CASE WHEN y{j} IS NOT NULL THEN x END", f"CASE WHEN x IS NOT NULL THEN y{j} END"
        sums += [f"count({x}) AS n{j}", f"covar_pop({x}, {y}) AS c{j}", f"var_pop({x}) AS u{j}", f"var_pop({y}) AS v{j}"]
    moments = table.select(*by, F.expr(f"inline(array({', '.join(rows)}))")).groupBy(*by, "i").agg(*map(F.expr, sums))
    names = "array(" + ", ".join(f"'{m}'" for m in metrics) + ")"
    pairs = ", ".join(f"named_struct('metric1', get({names}, i), 'metric2', '{metrics[j]}', 'n', n{j}, 'q', try_divide(c{j}, sqrt(u{j} * v{j})))" for j in later)
    long = moments.select(*by, F.expr(f"inline(array({pairs}))")).where("n > 0")
    # greatest and least skip NULL, so an undefined r is kept out of them.
    r = F.when((F.col("n") >= 2) & F.col("q").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("q"))))
    return long.select(*by, "metric1", "metric2", "n", r.alias("r")).withColumn("p", pearson_p_value(F.col("r"), F.col("n")))


def correlation_flags(matrix: DataFrame) -> DataFrame:
    """Which correlations are significant at 5 and at 1 percent."""
    return matrix.withColumn("p05", F.col("p") < 0.05).withColumn("p01", F.col("p") < 0.01)


def sentence_match(pairs: DataFrame) -> DataFrame:
    """Published sentences and the generated sentence each one came from (from 0)."""
    sentences = pairs.select(
        "suggestion_id",
        match_sentences(split_sentences(F.col("finalized")), split_sentences(F.col("generated"))).alias("m"),
    )
    return sentences.select("suggestion_id", F.inline("m"))


def sentence_histogram(matches: DataFrame, models: DataFrame, model_name: str | None = None) -> DataFrame:
    """How often each generated sentence position was kept, by model (from 1)."""
    rows = matches.join(models, "suggestion_id")
    if model_name is not None:
        rows = rows.where(F.col("model_name") == model_name)
    return rows.groupBy("model_name", (F.col("generated") + 1).alias("position")).agg(
        F.count("*").alias("matches"))


def histogram_total(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy("model_name").agg(F.sum("matches").alias("matches"))


def edit_row(keys: DataFrame, feedback: DataFrame, scores: DataFrame) -> DataFrame:
    """One wide row per edit: game, model, ratings, and all scores in percent."""
    names = [c for c in scores.columns if c != "suggestion_id"]
    percent = scores.select("suggestion_id", *[(100 * F.col(c)).alias(c) for c in names])
    rows = keys.select(F.col("uuid").alias("suggestion_id"), "model_name", "game_pid")
    return rows.join(feedback, "suggestion_id", "left").join(percent, "suggestion_id")


def edit_rank(edits: DataFrame, model_name: str | None = None,
              metrics=("rouge-4", "rouge-l", "rouge-w", "user"), part: str = "p",
              sort_by: str = "user") -> DataFrame:
    """The edit table as shown: one model or all, one of p, r, f, best first."""
    if model_name is not None:
        edits = edits.where(F.col("model_name") == model_name)
    shown = [F.col(f"{column_of(m)}_{part}").alias(column_of(m)) for m in metrics]
    return edits.select("suggestion_id", "model_name", *shown).orderBy(
        F.desc(column_of(sort_by)), "suggestion_id", "model_name")
