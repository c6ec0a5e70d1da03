"""Relational reports over models, suggestions and ratings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens.functions.values import round_avg_int, stddev_int
from draftlens.operators.joins import top_per_group
from draftlens.sources.wordlists import EXCLUDED_GAMES

# Rating types in their declared order, then free text.
RATING_TYPES = ("fluency", "relevance", "coherence", "likeability")
FEEDBACK_TYPES = RATING_TYPES + ("comments",)
USER_THRESHOLDS = (1, 5, 10, 20, None)
PUBLIC_EDITS = 10
ACTIVE = ("active",)


def type_ordinal(col: Column, types: tuple[str, ...] = FEEDBACK_TYPES) -> Column:
    """Position of a type in its declaration; unknown types come last."""
    hit = reduce(lambda acc, i: acc.when(col == types[i], F.lit(i)), range(1, len(types)),
                 F.when(col == types[0], F.lit(0)))
    return hit.otherwise(F.lit(len(types)))


def live_models(model: DataFrame, status=ACTIVE) -> DataFrame:
    """Id and name of the models with one of the given states."""
    live = model.where(F.col("status").isin(*status))
    return live.select(F.col("id").alias("model_id"), F.col("name").alias("model_name"))


def exclude_games(df: DataFrame, games=EXCLUDED_GAMES, col: str = "game_pid") -> DataFrame:
    """Rows of games that are not listed.

    As in SQL, a row without a game is dropped too, unless the list is empty.
    A DataFrame of words (one column) works for lists of any length.
    """
    if isinstance(games, DataFrame):
        words = games.toDF(col)
        none = words.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
        return df.join(words, col, "left_anti").where(F.col(col).isNotNull() | none)
    if not games:
        return df
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(*games))


def suggestion_models(model, assignment, suggestion, status=ACTIVE) -> DataFrame:
    """Suggestions with every model assigned to their story.

    A story with two models yields each of its suggestions twice.
    """
    return suggestion.join(assignment, "story_hash").join(live_models(model, status), "model_id")


def finalized_keys(model, assignment, suggestion, story, status=ACTIVE, games=EXCLUDED_GAMES) -> DataFrame:
    """Narrow rows (no texts) of the finalized suggestions of live models."""
    done = suggestion.where("is_finalized").select("id", "uuid", "story_hash", "created_at")
    story_keys = exclude_games(story.select(F.col("hash").alias("story_hash"), "game_pid"), games)
    return suggestion_models(model, assignment, done, status).join(story_keys, "story_hash")


def feedback_wide(feedback: DataFrame) -> DataFrame:
    """One row per suggestion, one column per feedback type (each occurs once)."""
    one = lambda t: F.max(F.when(F.col("type") == t, F.col("response"))).alias(t)
    return feedback.groupBy("suggestion_id").agg(*[one(t) for t in FEEDBACK_TYPES])


def finalized_suggestions(model, assignment, suggestion, story, feedback, status=ACTIVE,
                          games=EXCLUDED_GAMES, ordered: bool = True) -> DataFrame:
    """Wide table of finalized suggestions with texts and ratings, by context time.

    Keys and ratings are joined while narrow; texts are shuffled once, last.
    """
    keys = finalized_keys(model, assignment, suggestion, story, status, games)
    rated = keys.join(feedback_wide(feedback).withColumnRenamed("suggestion_id", "uuid"), "uuid", "left")
    texts = suggestion.where("is_finalized").select(
        "uuid", F.col("generated").alias("generated_text"), F.col("finalized").alias("user_text")
    )
    wide = rated.join(texts, "uuid").select(
        "model_name", "game_pid", "generated_text", "user_text", F.col("uuid").alias("suggestion_id"),
        *FEEDBACK_TYPES, "created_at",
    )
    return wide.orderBy("created_at", "suggestion_id", "model_name") if ordered else wide


def public_edits(model, assignment, suggestion, story, feedback, limit: int | None = PUBLIC_EDITS,
                 **kwargs) -> DataFrame:
    """The first edits as the public sees them; ``limit=None`` shows all.

    The cut is made on keys, in a job of its own, so only the chosen texts are read on.
    """
    if limit is None:
        return finalized_suggestions(model, assignment, suggestion, story, feedback, **kwargs)
    names = ["id", "uuid", "model_name", "game_pid", "created_at"]
    keys = finalized_keys(model, assignment, suggestion, story, **kwargs).select(*names)
    # ``limit`` narrow rows; as values, they reach the scans of texts and ratings as filters.
    first = keys.orderBy("created_at", "uuid", "model_name").limit(limit).collect()
    chosen = suggestion.sparkSession.createDataFrame(first, keys.schema)
    texts = suggestion.where(F.col("id").isin([r["id"] for r in first])).select(
        "id", F.col("generated").alias("generated_text"), F.col("finalized").alias("user_text"))
    ratings = feedback_wide(feedback.where(F.col("suggestion_id").isin([r["uuid"] for r in first])))
    return (
        chosen.join(texts, "id").withColumnRenamed("uuid", "suggestion_id").join(ratings, "suggestion_id", "left")
        .select("model_name", "game_pid", "generated_text", "user_text", "suggestion_id", *FEEDBACK_TYPES, "created_at")
        .orderBy("created_at", "suggestion_id", "model_name")
    )


def avg_ratings(model, assignment, suggestion, feedback, status=ACTIVE) -> DataFrame:
    """Mean, sample deviation and count of each rating type by model.

    Counts per (suggestion story, type, rating) are not needed: the aggregate is
    partial per task. Human ratings ignore the list of excluded games.
    """
    done = suggestion.where("is_finalized").select("uuid", "story_hash")
    rated = feedback.where(F.col("type").isin(*RATING_TYPES)).select(
        F.col("suggestion_id").alias("uuid"), "type", F.col("response").cast("int").alias("rating"))
    rows = suggestion_models(model, assignment, done.join(rated, "uuid"), status)
    out = rows.groupBy("type", "model_name").agg(
        round_avg_int(F.col("rating")).alias("avg_rating"),
        stddev_int(F.col("rating")).alias("rating_stddev"),
        F.count("model_name").alias("feedback_count"),
    )
    return out.orderBy(type_ordinal(F.col("type")), F.desc("avg_rating"), "model_name")


def suggestions_per_user(model, assignment, suggestion, status=ACTIVE) -> DataFrame:
    """Suggestions by user; a NULL user counts no suggestions."""
    rows = suggestion_models(model, assignment, suggestion.select("story_hash", "user_pid"), status)
    return rows.groupBy("user_pid").agg(F.count("user_pid").alias("suggestion_count"))


def users_by_threshold(model, assignment, suggestion, status=ACTIVE, thresholds=USER_THRESHOLDS) -> DataFrame:
    """How many users have at most n suggestions, for each n (NULL = no limit)."""
    counts = suggestions_per_user(model, assignment, suggestion, status)
    within = lambda n: F.lit(True) if n is None else F.col("suggestion_count") <= n
    one_pass = counts.agg(*[F.count_if(within(n)).alias(f"n{i}") for i, n in enumerate(thresholds)])
    rows = F.array(*[
        F.struct(F.lit(n).cast("int").alias("threshold"), F.col(f"n{i}").alias("unique_user_count"))
        for i, n in enumerate(thresholds)
    ])
    return one_pass.select(F.inline(rows))


def distinct_models(model, assignment, suggestion, story, **kwargs) -> DataFrame:
    """Names of the models with at least one finalized suggestion."""
    return finalized_keys(model, assignment, suggestion, story, **kwargs).select("model_name").distinct()


def judgement_contexts(model, assignment, suggestion, story, limit: int = 0, status=ACTIVE,
                       games=EXCLUDED_GAMES) -> DataFrame:
    """The first ``limit`` finalized suggestions of each model; 0 means all.

    Keys are ranked; the payload is fetched for the chosen rows only.
    """
    keys = finalized_keys(model, assignment, suggestion, story, status, games).select("id", "model_name")
    payload = suggestion.where("is_finalized")
    if limit:
        keys = top_per_group(keys, "model_name", "id", limit).drop("rank")
    return payload.join(keys, "id").select(
        F.col("id").alias("suggestion_id"), "model_name", "story_hash", "generated", "finalized")


def registry_query(model: DataFrame, name=None, type=None, status=None) -> DataFrame:
    """Registry rows by any of name, type and status."""
    given = {"name": name, "type": type, "status": status}
    for column, value in given.items():
        if value is not None:
            model = model.where(F.col(column) == value)
    return model
