"""Nearest neighbours with vantage-point trees.

On unit vectors the chord is a metric, and the nearest by chord have the largest
cosine. A tree fitted on a bounded sample deals all rows to shards; each shard gets
a tree of its own. A query searches its own shard first; the distance to its k-th
find then prunes branches, in the tree of shards as in the others, by the triangle
inequality. The pruning radius is multiplied by ``factor``: below one it is relaxed
and faster, one restores exact search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlens.llm import vectors as V
from draftlens.llm.common import save

#: At most so many vectors, lowest id hash first, shape the tree of shards.
SAMPLE = 4096
#: Rows of a shard that meet in one task, and queries that meet them there.
SHARD, QUERIES = 4096, 8192
LEAF = 64
SLACK = 1e-7
#: More than products of unit vectors differ from the exact cosine by rounding.
MARGIN = 1e-11
#: Scores of one step: queries times rows of a leaf; components compared exactly at once.
BLOCK, EXACT = (512, 4096), 1 << 22


def build(x: np.ndarray, rows: np.ndarray, leaf: int, depth: int = 0):
    """(vantage point, radius, inner, outer), or the rows of a leaf."""
    if len(rows) <= leaf or depth > 40:
        return rows
    d = np.linalg.norm(x[rows] - x[rows[0]], axis=1)
    far = rows[int(d.argmax())]  # a vantage point at the edge splits best
    d = np.linalg.norm(x[rows] - x[far], axis=1)
    radius = float(np.median(d))
    near = d <= radius
    if near.all():
        near = d < radius
        if not near.any():
            return rows
        radius = float(d[near].max())
    return x[far], radius, build(x, rows[near], leaf, depth + 1), build(x, rows[~near], leaf, depth + 1)


def leaves(tree, q: np.ndarray, tau: np.ndarray, factor: float, who: np.ndarray, out: list) -> None:
    """All (queries, leaf) that the radius tau cannot exclude."""
    if not len(who):
        return
    if not isinstance(tree, tuple):
        out.append((who, tree))
        return
    d = np.linalg.norm(q[who] - tree[0], axis=1)
    reach = tau[who] * factor + SLACK
    leaves(tree[2], q, tau, factor, who[d - reach <= tree[1]], out)
    leaves(tree[3], q, tau, factor, who[d + reach > tree[1]], out)


class Best:
    """The k best of each query so far: exact cosine downwards, then smaller id."""

    def __init__(self, n: int, k: int, tau: np.ndarray):
        self.score, self.row, self.tau, self.k = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64), tau, k

    def add(self, who: np.ndarray, at: np.ndarray, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """More rows and their scores; ``at`` says for which of the queries ``who``."""
        old, place = np.nonzero(self.row[who] >= 0)
        at = np.concatenate([old, at])
        rows = np.concatenate([self.row[who][old, place], rows])
        score = np.concatenate([self.score[who][old, place], score])
        order = np.lexsort((ids[rows], -score, at))
        at, rows, score = at[order], rows[order], score[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        on = rank < self.k
        self.score[who[at[on]], rank[on]], self.row[who[at[on]], rank[on]] = score[on], rows[on]
        worst = self.score[who][:, -1]
        self.tau[who] = np.minimum(self.tau[who], np.where(worst > -np.inf, np.sqrt(np.maximum(0, 2 - 2 * worst)) + SLACK, np.inf))


def search(raw, ids, tree, q_raw, qid, tau, k, factor) -> Best:
    x, q = V.unit(raw), V.unit(q_raw)
    best = Best(len(q), k, tau.copy())

    def score(who, rows):
        """Products choose which rows are compared exactly: all that rounding may put among the k best."""
        rough = q[who] @ x[rows].T
        rough[qid[who][:, None] == ids[rows][None, :]] = -np.inf
        least = best.score[who, -1]
        if len(rows) > k:
            least = np.maximum(least, -np.partition(-rough, k - 1, axis=1)[:, k - 1])
        at, to = np.nonzero((rough >= least[:, None] - MARGIN) & (rough > -np.inf))
        step = max(1, EXACT // x.shape[1])
        exact = [V.cosine(q_raw[who[at[i:i + step]]], raw[rows[to[i:i + step]]]) for i in range(0, len(at), step)]
        best.add(who, at, rows[to], np.concatenate([np.zeros(0), *exact]), ids)

    def visit(tree, who):
        if not len(who):
            return
        if not isinstance(tree, tuple):
            for i in range(0, len(who), BLOCK[0]):
                for j in range(0, len(tree), BLOCK[1]):
                    score(who[i:i + BLOCK[0]], tree[j:j + BLOCK[1]])
            return
        d = np.linalg.norm(q[who] - tree[0], axis=1)
        inner = d <= tree[1]
        visit(tree[2], who[inner])
        visit(tree[3], who[~inner])
        reach = best.tau[who] * factor + SLACK
        visit(tree[3], who[inner & (d + reach > tree[1])])
        visit(tree[2], who[~inner & (d - reach <= tree[1])])

    visit(tree, np.arange(len(q)))
    return best


FOUND = "query_id long, vec_id long, score double, vec array<double>, tau double"


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", factor: float = 1.0) -> DataFrame:
    """The k nearest other rows of each query row: query_id, rank, vec_id, score.

    Score is the cosine in double precision; ties go to the smaller id. Vectors that
    are null, zero or hold null or non-finite components take no part, nor do rows
    without an id. Rows with a query's own id are never its neighbours; repeated rows
    count once. All vectors must have one length. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = V.usable(vectors, vec_col).where(vectors[id_col].isNotNull())
    rows = rows.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("vec"), is_query.alias("is_query"))
    # Of equal vectors no query can find more than the k smallest ids and its own; the first pass
    # of this rank runs in each task before rows move.
    nth = F.row_number().over(Window.partitionBy("node", "vec").orderBy("vec_id"))
    few = rows.select("vec_id", "vec").distinct().withColumn("node", F.xxhash64("vec")).withColumn("nth", nth).where(F.col("nth") <= k + 1)
    asking = rows.where("is_query").select("vec_id", "vec").distinct()
    rows = save(few.select("vec_id", "vec", F.lit(False).alias("is_query")).unionByName(asking.withColumn("is_query", F.lit(True))))
    sample = rows.where("not is_query").select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    total = rows.where("not is_query").count()
    x = V.unit(np.array([r.vec for r in sample])) if sample else np.zeros((0, 1))
    n_shards = -(-total // SHARD)
    top, parts = build(x, np.arange(len(x)), max(8, -(-len(x) // max(1, n_shards)))), []

    def number(tree):
        if isinstance(tree, tuple):
            return tree[0], tree[1], number(tree[2]), number(tree[3])
        parts.append(len(tree))
        return np.array([len(parts) - 1])

    top = number(top)

    def deal(batches):
        for b in batches:
            q, out = V.unit(V.matrix(b.column(1))), []
            if len(q):
                leaves(top, q, np.full(len(q), -2 * SLACK), 0.5, np.arange(len(q)), out)
            shard = np.zeros(len(q), np.int32)
            for who, leaf in out:
                shard[who] = leaf[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], ["vec_id", "vec", "is_query", "shard"])

    dealt = save(rows.mapInArrow(deal, "vec_id long, vec array<double>, is_query boolean, shard int"))
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()),
                      "vec": pa.array([], pa.list_(pa.float64())), "tau": pa.array([], pa.float64())})

    def in_shard(all_: pa.Table, asked: pa.Table) -> pa.Table:
        if not all_.num_rows or not asked.num_rows:
            return empty
        raw, ids = V.matrix(all_.column("vec")), all_.column("vec_id").to_numpy()
        q_raw, qid = V.matrix(asked.column("vec")), asked.column("query_id").to_numpy()
        best = search(raw, ids, build(V.unit(raw), np.arange(len(raw)), LEAF), q_raw, qid, asked.column("tau").to_numpy().copy(), k, factor)
        who, at = np.nonzero(best.row >= 0)
        row, score = best.row[who, at], best.score[who, at]
        tau = np.sqrt(np.maximum(0, 2 - 2 * best.score[:, k - 1]))
        tau[~np.isfinite(best.score[:, k - 1])] = 4.0
        return pa.table({"query_id": qid[who], "vec_id": ids[row], "score": score,
                         "vec": asked.column("vec").take(pa.array(who)), "tau": tau[who]})

    def route(batches):
        for b in batches:
            q, out = V.unit(V.matrix(b.column(1))), []
            if len(q):
                leaves(top, q, b.column(2).to_numpy() + SLACK, factor, np.arange(len(q)), out)
            who = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in out)])
            shard = np.concatenate([np.zeros(0, np.int32), *(np.full(len(w), leaf[0], np.int32) for w, leaf in out)])
            on = shard != b.column(3).to_numpy()[who]
            taken = b.take(pa.array(who[on]))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), taken.column(2), pa.array(shard[on])], ["query_id", "vec", "tau", "shard"])

    held = dealt.where("not is_query").select("vec_id", "vec", "shard")
    asked = dealt.where("is_query").select(F.col("vec_id").alias("query_id"), "vec", F.lit(4.0).alias("tau"), "shard")
    sizes = held.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts"))

    def meet(asked: DataFrame) -> DataFrame:
        """Each part of a shard meets each part of the queries that go there."""
        grid = sizes.join(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("asks")), "shard")
        mine, all_ = (F.pmod(F.xxhash64(c, "vec"), F.col(n)).cast("int") for c, n in (("vec_id", "parts"), ("query_id", "asks")))
        x = held.join(grid, "shard").select("vec_id", "vec", "shard", mine.alias("part"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"))
        q = asked.join(grid, "shard").select("query_id", "vec", "tau", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), all_.alias("ask"))
        x, q = x.toDF(*x.columns), q.toDF(*q.columns)  # both come from one table: columns of their own
        return x.groupBy("shard", "part", "ask").cogroup(q.groupBy("shard", "part", "ask")).applyInArrow(in_shard, FOUND)

    first = save(meet(asked))
    bound = first.groupBy("query_id").agg(F.min("tau").alias("tau"))
    going = asked.drop("tau").join(bound, "query_id", "left").select("query_id", "vec", F.coalesce("tau", F.lit(4.0)).alias("tau"), "shard")
    going = going.mapInArrow(route, "query_id long, vec array<double>, tau double, shard int")
    second = meet(going)
    found = first.unionByName(second).select("query_id", "vec_id", "score").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
