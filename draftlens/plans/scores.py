"""Queries: edit scores, statistics over them, and sentence matches."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Window
from pyspark.sql import functions as F

from draftlens.operators import reports as R
from draftlens.operators import scoring as G
from draftlens.operators import statistics as T
from draftlens.operators import store as S
from draftlens.plans.registry import query
from draftlens.plans.relational import CORE, FROM_DONE, WHERE_DONE, core
from draftlens.plans.texts import q, sql_content_tokens, sql_score_tokens, sql_sentences, sql_ws_tokens
from draftlens.session import scratch_path

NGRAM = ("rouge-1", "rouge-2", "rouge-3", "rouge-4")
RATED = ("relevance", "likeability", "fluency", "coherence")


def _rouge_sql() -> str:
    """CTEs ending in ``rg``: ROUGE-1..4 of every finalized suggestion."""
    side = lambda name, col: (
        f"{name}g AS (SELECT uuid, n, array_to_string({col}[i:i+n-1], ' ') AS gram, count(*) AS c "
        f"FROM toks, (SELECT unnest([1,2,3,4]) AS n) JOIN LATERAL (SELECT unnest(range(1, greatest(len({col}) - n + 2, 1))) AS i) ON true "
        f"GROUP BY ALL)")
    total = lambda col: f"greatest(len({col}) - k.n + 1, 0)"
    per = []
    for n in (1, 2, 3, 4):
        of = lambda c: f"max(CASE WHEN n = {n} THEN {c} END)"
        per += [f"{of('p')} AS rouge_{n}_p", f"{of('r')} AS rouge_{n}_r", f"{of('f')} AS rouge_{n}_f"]
    return f"""
toks AS (SELECT uuid, {sql_content_tokens('generated')} AS h, {sql_content_tokens('finalized')} AS r FROM suggestion WHERE finalized IS NOT NULL),
{side('h', 'h')}, {side('r', 'r')},
hit AS (SELECT hg.uuid, hg.n, sum(least(hg.c, rg.c)) AS m FROM hg JOIN rg USING (uuid, n, gram) GROUP BY ALL),
pr AS (SELECT toks.uuid, k.n, CASE WHEN {total('h')} > 0 THEN coalesce(m, 0) / {total('h')} ELSE 0.0 END AS p,
    CASE WHEN {total('r')} > 0 THEN coalesce(m, 0) / {total('r')} ELSE 0.0 END AS r
  FROM toks CROSS JOIN (SELECT unnest([1,2,3,4]) AS n) k LEFT JOIN hit ON hit.uuid = toks.uuid AND hit.n = k.n),
prf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pr),
rouge AS (SELECT uuid, {', '.join(per)} FROM prf GROUP BY uuid)
"""


ROUGE = _rouge_sql()
ROUGE_COLS = [f"rouge_{n}_{x}" for n in (1, 2, 3, 4) for x in "prf"]
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ROUGE_COLS)
rounded = lambda df: df.select("suggestion_id", *[F.round(c, 6).alias(c) for c in df.columns if c != "suggestion_id"])


@query("rouge_n", f"WITH {ROUGE} SELECT uuid AS suggestion_id, {ROUNDED} FROM rouge", "suggestion")
def _(t):
    return rounded(G.score_edits(G.edit_pairs(t.suggestion), NGRAM))


@query("rouge_n_native", f"WITH {ROUGE} SELECT uuid AS suggestion_id, {ROUNDED} FROM rouge", "suggestion")
def _(t):
    return rounded(G.rouge_n(G.edit_pairs(t.suggestion_by_id, in_place=True)))


@query("rouge_l")
def _(t):
    return rounded(G.rouge_l(G.edit_pairs(t.suggestion)))


@query("rouge_w")
def _(t):
    return rounded(G.rouge_w(G.edit_pairs(t.suggestion)))


def turn_pairs(t):
    """Each turn of a conversation beside the one before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.raw("conversations").select("conv_id", "turn", F.col("text").alias("finalized"), before.alias("generated")).where("generated IS NOT NULL")
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return rows.select(F.xxhash64("conv_id", "turn").alias("id"), name.alias("suggestion_id"), "generated", "finalized")


# The textbook table, a row for each token of h, as a fold over lists.
TURNS = f"""
t AS (SELECT concat(conv_id, ':', turn) AS suggestion_id, text AS finalized, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS generated FROM conversations),
w AS (SELECT suggestion_id, {sql_content_tokens('generated')} AS h, {sql_content_tokens('finalized')} AS r FROM t WHERE generated IS NOT NULL)
"""
LCS_FOLD = """list_reduce(h, lambda L, x: list_reduce(range(1, len(r) + 1), lambda acc, j:
    list_append(acc, greatest(acc[j], L[j + 1], L[j] + CASE WHEN r[j] = x THEN 1 ELSE 0 END)), [CAST(0 AS BIGINT)]),
  list_transform(range(0, len(r) + 1), lambda x: CAST(0 AS BIGINT)))[len(r) + 1]"""
CELL = "{'c': CAST(0 AS DOUBLE), 'k': CAST(0 AS BIGINT)}"
WLCS_FOLD = f"""list_reduce(h, lambda L, x: list_reduce(range(1, len(r) + 1), lambda acc, j:
    list_append(acc, CASE WHEN r[j] = x THEN {{'c': L[j].c + pow(L[j].k + 1, 1.2) - pow(L[j].k, 1.2), 'k': L[j].k + 1}}
      ELSE {{'c': greatest(acc[j].c, L[j + 1].c), 'k': CAST(0 AS BIGINT)}} END), [{CELL}]),
  list_transform(range(0, len(r) + 1), lambda x: {CELL}))[len(r) + 1].c"""


def sql_turns(name: str, fold: str, share: str) -> str:
    """Precision, recall and F1 of a fold; ``share`` relates it to a total."""
    of = lambda total: f"CASE WHEN {total} > 0 THEN {share.format(total)} ELSE 0.0 END"
    return f"""
WITH {TURNS}, s AS (SELECT suggestion_id, len(h) AS hn, len(r) AS rn, CASE WHEN len(h) > 0 AND len(r) > 0 THEN {fold} ELSE 0 END AS m FROM w),
p AS (SELECT suggestion_id, {of('hn')} AS p, {of('rn')} AS r FROM s)
SELECT suggestion_id, round(p, 6) AS {name}_p, round(r, 6) AS {name}_r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS {name}_f FROM p
"""


@query("rouge_l_turns", sql_turns("rouge_l", LCS_FOLD, "m / {0}"))
def _(t):
    return rounded(G.rouge_l(turn_pairs(t)))


@query("rouge_w_turns", sql_turns("rouge_w", WLCS_FOLD, "least(1.0, pow(m / pow({0}, 1.2), 1 / 1.2))"))
def _(t):
    return rounded(G.rouge_w(turn_pairs(t)))


@query("user_score")
def _(t):
    return rounded(G.user_score(G.edit_pairs(t.suggestion)))


@query("diff_ops")
def _(t):
    return G.diff_ops(G.edit_pairs(t.suggestion))


@query("diff_balance", f"""
SELECT uuid AS suggestion_id, len({sql_score_tokens('generated')}) AS h_tokens, len({sql_score_tokens('finalized')}) AS r_tokens,
  CASE WHEN generated = finalized THEN len({sql_score_tokens('generated')}) END AS kept_if_same
FROM suggestion WHERE finalized IS NOT NULL
""", "suggestion")
def _(t):
    """Kept, shared and deleted tokens add up to one text, kept, shared and inserted to the other."""
    pairs = G.edit_pairs(t.suggestion)
    total = lambda *ops: F.coalesce(F.sum(F.when(F.col("op").isin(*ops), F.col("tokens"))), F.lit(0)).cast("long")
    sums = G.diff_ops(pairs).groupBy("suggestion_id").agg(
        total("keep", "shared", "delete").alias("h_tokens"), total("keep", "shared", "insert").alias("r_tokens"),
        total("keep", "shared").alias("kept"))
    same = pairs.select("suggestion_id", (F.col("generated") == F.col("finalized")).alias("same"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return same.join(sums, "suggestion_id", "left").select(
        "suggestion_id", zero("h_tokens"), zero("r_tokens"), F.when(F.col("same"), F.coalesce("kept", F.lit(0).cast("long"))).alias("kept_if_same"))


def models_of(t):
    return R.finalized_keys(*core(t)).select(F.col("uuid").alias("suggestion_id"), "model_name")


@query("diff_summary")
def _(t):
    return G.diff_summary(G.edit_pairs(t.suggestion), models_of(t))


def table(t, scores):
    return T.metric_table(R.finalized_keys(*core(t)), R.feedback_wide(t.feedback), scores)


def all_scores(t):
    return G.score_edits(G.edit_pairs(t.suggestion))


def ngram_scores(t):
    return G.score_edits(G.edit_pairs(t.suggestion), NGRAM)


METRICS = f"""
{ROUGE},
fb AS (SELECT suggestion_id, {', '.join(f"max(CASE WHEN type = '{x}' THEN CAST(response AS DOUBLE) END) AS {x}" for x in RATED)}
  FROM feedback WHERE type <> 'comments' GROUP BY suggestion_id),
mt AS (SELECT s.uuid AS suggestion_id, m.name AS model_name, {', '.join(f'fb.{x}' for x in RATED)},
  {', '.join(f'100 * rouge.rouge_{n}_p AS rouge_{n}' for n in (1, 2, 3, 4))}
  {FROM_DONE} LEFT JOIN fb ON fb.suggestion_id = s.uuid LEFT JOIN rouge ON rouge.uuid = s.uuid {WHERE_DONE})
"""


@query("avg_auto_metrics")
def _(t):
    return T.avg_auto_metrics(table(t, all_scores(t)))


AUTO_SQL = " UNION ALL ".join(
    f"SELECT 'rouge-{n}' AS type, model_name, round(avg(rouge_{n}), 2) AS avg_rating, "
    f"round(stddev_samp(rouge_{n}), 2) AS rating_stddev, count(rouge_{n}) AS feedback_count FROM mt GROUP BY model_name"
    for n in (1, 2, 3, 4))


@query("avg_auto_metrics_ngram", f"WITH {METRICS} {AUTO_SQL}", CORE + " feedback")
def _(t):
    return T.avg_auto_metrics(table(t, ngram_scores(t)), NGRAM)


def board(t, scores, metrics):
    human = R.avg_ratings(t.model, t.assignment, t.suggestion, t.feedback)
    return T.ratings_board(human, T.avg_auto_metrics(table(t, scores), metrics))


@query("ratings_board")
def _(t):
    return board(t, all_scores(t), G.AUTO_METRICS)


@query("ratings_rank", """
SELECT 'fluency' AS type, m.name AS model_name,
  CAST(((200 * CAST(sum(CAST(f.response AS INT)) AS BIGINT) + count(*)) // (2 * count(*))) / 100.0 AS DOUBLE) AS avg_rating,
  round(stddev_samp(CAST(f.response AS INT)), 2) AS rating_stddev, count(m.name) AS feedback_count
FROM model m JOIN assignment a ON m.id = a.model_id JOIN suggestion s ON s.story_hash = a.story_hash
JOIN feedback f ON f.suggestion_id = s.uuid
WHERE f.type = 'fluency' AND s.finalized IS NOT NULL AND m.status = 'active' GROUP BY m.name
""", CORE + " feedback")
def _(t):
    return T.ratings_rank(R.avg_ratings(t.model, t.assignment, t.suggestion, t.feedback), "fluency")


HUMAN_SQL = """SELECT f.type, m.name AS model_name,
  CAST(((200 * CAST(sum(CAST(f.response AS INT)) AS BIGINT) + count(*)) // (2 * count(*))) / 100.0 AS DOUBLE) AS avg_rating,
  round(stddev_samp(CAST(f.response AS INT)), 2) AS rating_stddev, count(m.name) AS feedback_count
FROM model m JOIN assignment a ON m.id = a.model_id JOIN suggestion s ON s.story_hash = a.story_hash
JOIN feedback f ON f.suggestion_id = s.uuid
WHERE f.type <> 'comments' AND s.finalized IS NOT NULL AND m.status = 'active' GROUP BY f.type, m.name"""


@query("ratings_board_ngram", f"""
WITH {METRICS}
SELECT b.*, CAST(list_position(['fluency','relevance','coherence','likeability','user','rouge-l','rouge-w','rouge-1','rouge-2','rouge-3','rouge-4'], b.type) - 1 AS INT) AS section
FROM ({HUMAN_SQL} UNION ALL {AUTO_SQL}) b
""", CORE + " feedback")
def _(t):
    return board(t, ngram_scores(t), NGRAM)


def _corr_sql(metrics, by: str, digits: int = 6) -> str:
    """Textbook form, written out pair by pair."""
    cols = [m.replace("-", "_") for m in metrics]
    head = f"{by}, " if by else ""
    one = lambda i, j: (
        f"SELECT {head}'{metrics[i]}' AS metric1, '{metrics[j]}' AS metric2, count(*) AS n, "
        f"CASE WHEN count(*) >= 2 THEN round(covar_pop({cols[i]}, {cols[j]}) / nullif(sqrt(var_pop({cols[i]}) * var_pop({cols[j]})), 0), {digits}) END AS q, "
        f"CASE WHEN abs(q) = 0 THEN 0.0 ELSE q END AS r "
        f"FROM mt WHERE {cols[i]} IS NOT NULL AND {cols[j]} IS NOT NULL" + (f" GROUP BY {by}" if by else " HAVING count(*) > 0"))
    # A negative zero counts as zero on both sides.
    rows = " UNION ALL ".join(one(i, j) for i, j in combinations(range(len(cols)), 2))
    return f"SELECT {head}metric1, metric2, n, r FROM ({rows})"


def shown_r():
    r = F.round("r", 6)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def shown(matrix):
    return matrix.drop("p").withColumn("r", shown_r())


CHECKED = RATED + NGRAM


@query("correlations")
def _(t):
    return T.correlations(table(t, all_scores(t)))


@query("correlations_by_model")
def _(t):
    return T.correlations(table(t, all_scores(t)), by_model=True)


# The two-sided p is the share of (1 - s * s) ** (n / 2 - 2) beyond |r|: Simpson's rule over 4,000 steps.
P_SQL = f"""
m AS ({_corr_sql(CHECKED, '', 15)}),
f AS (SELECT m.*, 2 * exp(lgamma(n / 2.0 - 0.5) - lgamma(n / 2.0 - 1) - lgamma(0.5)) * (1 - abs(r)) / 12000 AS unit FROM m),
c AS (SELECT metric1, metric2, n, round(r, 6) AS r, round(sum(unit * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * pow(1 - pow(abs(r) + (1 - abs(r)) * i / 4000, 2), n / 2.0 - 2)), 6) AS p FROM f, (SELECT unnest(range(0, 4001)) AS i) GROUP BY ALL)
"""


@query("correlations_ngram", f"WITH {METRICS}, {P_SQL} SELECT * FROM c", CORE + " feedback")
def _(t):
    matrix = T.correlations(table(t, ngram_scores(t)), CHECKED)
    p = F.round("p", 6)
    return matrix.select("metric1", "metric2", "n", shown_r().alias("r"), F.when(p == 0, F.lit(0.0)).otherwise(p).alias("p"))


@query("correlation_flags_ngram", f"WITH {METRICS}, {P_SQL} SELECT metric1, metric2, n, p < 0.05 AS p05, p < 0.01 AS p01 FROM c", CORE + " feedback")
def _(t):
    return T.correlation_flags(T.correlations(table(t, ngram_scores(t)), CHECKED)).select("metric1", "metric2", "n", "p05", "p01")


@query("correlations_by_model_ngram", f"WITH {METRICS} {_corr_sql(CHECKED, 'model_name')}", CORE + " feedback")
def _(t):
    return shown(T.correlations(table(t, ngram_scores(t)), CHECKED, by_model=True))


@query("correlation_flags")
def _(t):
    return T.correlation_flags(T.correlations(table(t, all_scores(t))))


def matches(t):
    return T.sentence_match(G.edit_pairs(t.suggestion))


_CHUNKS = lambda s: (
    f"list_transform({s}, lambda z: list_distinct(list_transform(range(0, (len({sql_ws_tokens('z')}) + 2) // 3), "
    f"lambda i: array_to_string(({sql_ws_tokens('z')})[i*3+1:i*3+3], ' '))))")

# Shared chunks of every pair of sentences, then one published sentence of every
# text per step; used holds the taken indices.
GREEDY = f"""
WITH RECURSIVE sent AS MATERIALIZED (SELECT uuid, {_CHUNKS(sql_sentences('finalized'))} AS a, {_CHUNKS(sql_sentences('generated'))} AS b
  FROM suggestion WHERE finalized IS NOT NULL),
ga AS (SELECT uuid, i, unnest(c) AS g FROM (SELECT uuid, unnest(a) AS c, generate_subscripts(a, 1) - 1 AS i FROM sent)),
gb AS (SELECT uuid, j, unnest(c) AS g FROM (SELECT uuid, unnest(b) AS c, generate_subscripts(b, 1) - 1 AS j FROM sent)),
cand AS MATERIALIZED (SELECT uuid, i, list({{'o': -n, 'j': j}} ORDER BY n DESC, j) AS c
  FROM (SELECT ga.uuid, i, j, count(*) AS n FROM ga JOIN gb ON ga.uuid = gb.uuid AND ga.g = gb.g GROUP BY ALL) GROUP BY ALL),
step AS (
  SELECT uuid, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS hit FROM sent
  UNION ALL
  SELECT uuid, i + 1, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, hit FROM (
    SELECT x.uuid, x.i, x.used, list_filter(cand.c, lambda k: NOT list_contains(x.used, k.j))[1].j AS hit
    FROM step x JOIN sent ON sent.uuid = x.uuid LEFT JOIN cand ON cand.uuid = x.uuid AND cand.i = x.i WHERE x.i < len(sent.a))
),
found AS (SELECT uuid AS suggestion_id, CAST(i - 1 AS INT) AS published, CAST(hit AS INT) AS generated FROM step WHERE hit IS NOT NULL)
"""


@query("sentence_match", GREEDY + "SELECT * FROM found", "suggestion")
def _(t):
    return matches(t)


HISTOGRAM = GREEDY + f""",
mn AS (SELECT s.uuid, m.name AS model_name {FROM_DONE} {WHERE_DONE}),
hist AS (SELECT mn.model_name, found.generated + 1 AS position, count(*) AS matches
  FROM found JOIN mn ON mn.uuid = found.suggestion_id GROUP BY ALL)
"""


@query("sentence_histogram", HISTOGRAM + "SELECT * FROM hist", CORE)
def _(t):
    return T.sentence_histogram(matches(t), models_of(t))


@query("histogram_total", HISTOGRAM + "SELECT model_name, CAST(sum(matches) AS BIGINT) AS matches FROM hist GROUP BY model_name", CORE)
def _(t):
    return T.histogram_total(T.sentence_histogram(matches(t), models_of(t)))


def edits(t):
    return T.edit_row(R.finalized_keys(*core(t)), R.feedback_wide(t.feedback), all_scores(t))


@query("edit_row")
def _(t):
    return edits(t)


@query("edit_rank")
def _(t):
    return T.edit_rank(edits(t))


EDITS = ", ".join(f"round(100 * rouge.{c}, 4) AS {c}" for c in ROUGE_COLS)
EDIT_ROWS = f"""
e AS (SELECT s.uuid AS suggestion_id, m.name AS model_name, st.game_pid, {', '.join(f'a.{x}' for x in R.FEEDBACK_TYPES)}, {EDITS}
  {FROM_DONE} JOIN rouge ON rouge.uuid = s.uuid
  LEFT JOIN (SELECT suggestion_id, {', '.join(f"max(response) FILTER (WHERE type = '{x}') AS {x}" for x in R.FEEDBACK_TYPES)} FROM feedback GROUP BY suggestion_id) a
    ON a.suggestion_id = s.uuid {WHERE_DONE})
"""


def ngram_edits(t):
    rows = T.edit_row(R.finalized_keys(*core(t)), R.feedback_wide(t.feedback), ngram_scores(t))
    return rows.select(*[F.round(c, 4).alias(c) if c in ROUGE_COLS else c for c in rows.columns])


@query("edit_row_ngram", f"WITH {ROUGE}, {EDIT_ROWS} SELECT * FROM e", CORE + " feedback")
def _(t):
    return ngram_edits(t)


@query("edit_rank_ngram", f"WITH {ROUGE}, {EDIT_ROWS} SELECT suggestion_id, model_name, rouge_4_f AS rouge_4, rouge_1_f AS rouge_1 FROM e WHERE model_name = 'src3'", CORE + " feedback")
def _(t):
    """The edit table of one model, by F1."""
    return T.edit_rank(ngram_edits(t), "src3", ("rouge-4", "rouge-1"), "f", "rouge-1")


@query("sentence_histogram_model", HISTOGRAM + "SELECT * FROM hist WHERE model_name = 'src3'", CORE)
def _(t):
    return T.sentence_histogram(matches(t), models_of(t), "src3")


@query("sink_metrics_increment", f"""
WITH {ROUGE} SELECT uuid AS suggestion_id, {ROUNDED}, true AS others FROM rouge
""", "suggestion")
def _(t):
    """Score what is done, store it, then the rest, and one increment once more: all seven metrics, each once."""
    path = scratch_path(t.spark, "metrics")
    done = G.edit_pairs(S.scan_all(t.suggestion, where={"status": "done"}))
    S.write_increment(G.score_edits(done), path, "done")
    rest = G.edit_pairs(t.suggestion, stored=S.stored_increments(t.spark, path))
    S.write_increment(G.score_edits(rest), path, "rest")
    S.write_increment(G.score_edits(rest), path, "rest")
    rows = S.stored_increments(t.spark, path)
    # Whole records: the three metrics that SQL does not check lie between 0 and 1.
    others = [F.col(f"{G.column_of(m)}_{x}").between(0, 1) for m in ("user", "rouge-l", "rouge-w") for x in "prf"]
    return rounded(rows.select("suggestion_id", *ROUGE_COLS)).join(rows.select("suggestion_id", reduce(and_, others).alias("others")), "suggestion_id")
