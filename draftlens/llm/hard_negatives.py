"""Hard negatives with an inverted multi-index, exact and in integers.

The dimensions are split in two halves; each half has a codebook of its own, fitted on
a bounded sample. All rows are indexed: a row's two codes name its cell, cells are
packed into shards of bounded size, and a crowded cell is split over several. For an
anchor, the score of a cell's rows is at most the sum of two half bounds: inner product
with the codeword plus the anchor half's length times the code's radius. A heap visits
the cells of a shard by that sum, downwards, and stops once what is still wanted lies
strictly above it. Shards whose best cell falls short are not visited at all.

Three passes: the shard of an anchor's best cell gives a floor for its positives, all
shards that may beat the floor give the positives, and these fix the windows in which
the negatives are sought.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from draftlens.llm import vectors as V
from draftlens.llm.common import partitions, save

#: Rows, lowest hash first, on which the codebooks are fitted; codes of a half at most.
SAMPLE, CODES = 8192, 64
#: Rows a cell is meant to hold, most rows of a shard, anchors that meet a shard in one task.
CELL, SHARD, ASKS = 64, 16384, 4096
#: Cells are taken from the heap until so many rows are to be scored at once, then more.
FIRST, MORE = 256, 2048
LONG = LongType()


def largest(dims: int) -> int:
    """Largest size of a scaled component, so that scores fit 62 bits."""
    return math.isqrt((1 << 62) // max(1, dims)) if dims > 64 else 1 << 28


def codebook(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    rng = np.random.default_rng(13)
    c = x[np.sort(rng.permutation(len(x))[:k])].astype(np.float64)
    for _ in range(rounds):
        own = coded(x, c)[0]
        total, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def coded(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code of each row, and the distance to it."""
    x = x.astype(np.float64)
    far = (codes * codes).sum(axis=1) - 2 * (x @ codes.T)
    own = far.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
    return own, np.linalg.norm(x - codes[own], axis=1)


class Index:
    """Codebooks, radii of all rows, and which shards hold a cell: the same in every task."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], counts: dict[tuple[int, int], tuple[int, float, float]], size: int):
        self.books, self.half = books, books[0].shape[1]
        self.radius = [np.zeros(len(b)) for b in books]
        self.shards: dict[tuple[int, int], tuple[int, int]] = {}
        shard, room = 0, size
        for (i, j), (n, a, b) in sorted(counts.items()):
            self.radius[0][i], self.radius[1][j] = max(self.radius[0][i], a), max(self.radius[1][j], b)
            if n > room and room < size:
                shard, room = shard + 1, size
            parts = -(-n // size)
            self.shards[i, j] = shard, parts
            shard, room = (shard, room - n) if parts == 1 else (shard + parts, size)
        self.n_shards = shard + (room < size)
        self.cells = np.array(list(self.shards) or np.zeros((0, 2)), np.int64).reshape(-1, 2)
        self.first = np.array([s for s, _ in self.shards.values()], np.int64)
        self.parts = np.array([p for _, p in self.shards.values()], np.int64)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of both halves: (queries x codes of a half)."""
        out = []
        for x, book, radius in zip((q[:, :self.half], q[:, self.half:]), self.books, self.radius, strict=True):
            x = x.astype(np.float64)
            size, reach = np.linalg.norm(x, axis=1)[:, None], np.linalg.norm(book, axis=1) + radius
            out.append(x @ book.T + size * radius + 1e-9 * (1 + size * reach))  # rounding only adds
        return out[0], out[1]

    def route(self, q: np.ndarray, least: np.ndarray, best_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, shard) where some cell may reach ``least``; or the shards of the best cell only."""
        one, two = self.bounds(q)
        top = one[:, self.cells[:, 0]] + two[:, self.cells[:, 1]]
        if best_only:
            on = np.zeros(top.shape, bool)
            on[np.arange(len(q)), top.argmax(axis=1)] = True
        else:
            on = top >= least[:, None]
        who, cell = np.nonzero(on)
        if not len(who):
            return who, cell
        # A cell's first part stands for all: bounds say nothing about single parts.
        n = self.parts[cell]
        who, shard = np.repeat(who, n), np.repeat(self.first[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.unique(who * self.n_shards + shard)
        return pairs // self.n_shards, pairs % self.n_shards


def visits(one: np.ndarray, two: np.ndarray, filled: dict[tuple[int, int], tuple[int, int]]):
    """Filled cells by the sum of their half bounds, downwards: (bound, begin, end)."""
    i_by, j_by = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    heap, seen = [(-(one[i_by[0]] + two[j_by[0]]), 0, 0)], {(0, 0)}
    while heap:
        low, a, b = heapq.heappop(heap)
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(i_by) and y < len(j_by) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(one[i_by[x]] + two[j_by[y]]), x, y))
        if (rows := filled.get((i_by[a], j_by[b]))) is not None:
            yield -low, *rows


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


class Shard:
    """Rows of one shard by cell, and the search for one anchor."""

    def __init__(self, index: Index, t: pa.Table, dims: int):
        c1, c2 = t.column("c1").to_numpy(), t.column("c2").to_numpy()
        order = np.lexsort((c2, c1))
        t = t.take(pa.array(order))
        self.x = V.integers(t.column("vec"), dims)
        self.whole, self.most = self.x.astype(np.float64), int(np.abs(self.x).max(initial=0)) * dims
        self.ids, self.labels = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
        self.codes = np.unique(c1), np.unique(c2)
        cell = np.searchsorted(self.codes[0], c1[order]) * len(self.codes[1]) + np.searchsorted(self.codes[1], c2[order])
        begin = np.flatnonzero(np.diff(cell, prepend=-1))
        end = np.append(begin[1:], len(cell))
        self.filled = {divmod(int(cell[b]), len(self.codes[1])): (int(b), int(e)) for b, e in zip(begin, end, strict=True)}

    def steps(self, one, two, q, wanted):
        """Scores of batches of visited cells, until ``wanted()`` lies strictly above the next bound."""
        cells, size, batch, rows = visits(one[self.codes[0]], two[self.codes[1]], self.filled), FIRST, [], 0
        exact = self.most * int(np.abs(q).max(initial=0)) < 1 << 53  # then products of floats are whole numbers, too
        x, q = (self.whole, q.astype(np.float64)) if exact else (self.x, q)
        score = lambda at: (x[at] @ q).astype(np.int64)
        for bound, b, e in cells:
            if bound < wanted():
                break
            batch.append(np.arange(b, e))
            rows += e - b
            if rows >= size:
                at = np.concatenate(batch)
                yield at, score(at)
                batch, rows, size = [], 0, MORE
        if batch:
            at = np.concatenate(batch)
            yield at, score(at)

    def positives(self, q, qid, label, one, two, floor: int, k: int):
        score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        wanted = lambda: score[k - 1] if len(score) >= k else floor
        for at, s in self.steps(one, two, q, wanted):
            on = (self.labels[at] == label) & (self.ids[at] != qid) & (s >= floor)
            score, ids = np.concatenate([score, s[on]]), np.concatenate([ids, self.ids[at[on]]])
            top = best_of(score, ids, k)
            score, ids = score[top], ids[top]
        return score, ids

    def negatives(self, q, qid, label, one, two, windows: list[tuple[int, int]], k: int):
        """Of each window (low, high): its first k scores and ids."""
        found = {w: (np.zeros(0, np.int64),) * 2 for w in windows}
        least = min(low for low, _ in windows)
        wanted = lambda: min(s[k - 1] if len(s) >= k else w[0] for w, (s, _) in found.items())
        for at, s in self.steps(one, two, q, wanted):
            on = (s >= least) & (self.labels[at] != label) & (self.ids[at] != qid)
            s, ids = s[on], self.ids[at[on]]
            if not len(s):
                continue
            for (low, high), (have, names) in found.items():
                fits = (s >= low) & (s <= high)
                if fits.any():
                    have, names = np.concatenate([have, s[fits]]), np.concatenate([names, ids[fits]])
                    top = best_of(have, names, k)
                    found[low, high] = have[top], names[top]
        return found


def mine(vectors: DataFrame, is_anchor=None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of each (anchor, positive).

    One row per negative: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Components become floor(scale * x), the score is the inner
    product; ties go to the smaller id. An anchor's positives are its best other rows
    of its label, and a positive's negatives the best rows of other labels whose
    score is between ``low`` and ``high`` percent of the positive's. Rows with a null
    label, id or vector, or a null or non-finite component take no part. Repeated rows
    of one id count as one, the smallest by label and vector. Shorter vectors
    count as filled up with zeros. A scaled component of more than 2**28 in size (less
    in more than 64 dimensions) counts as that. No row, no result. Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    is_anchor = vectors[id_col] % 100 == 0 if is_anchor is None else is_anchor
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("name"),
                          vectors[vec_col].cast("array<double>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id is not null and name is not null and vec is not null").where(finite)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    dims = rows.agg(F.max(F.size("vec"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], schema)
    dims = max(2, dims)
    most = largest(dims)
    scaled = F.transform("vec", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(2.0 ** 40)), F.lit(-(2.0 ** 40)))))
    scaled = F.transform(scaled, lambda x: F.greatest(F.least(x, F.lit(most)), F.lit(-most)))
    scaled = F.concat(scaled, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("vec")))
    # Labels are compared by hash-free codes: a long stays itself, other types by their 64-bit hash.
    kind = rows.schema["name"].dataType.simpleString()
    code = F.col("name").cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("name")
    rows = rows.select("vec_id", F.struct(code.alias("label"), scaled.alias("vec"), "anchor").alias("r"))
    rows = save(rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.anchor", "r.vec"))
    half = dims // 2
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    sample = rows.select("vec").orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(SAMPLE).collect()
    x = np.array([r[0] for r in sample], np.int64)
    k = max(1, min(CODES, math.isqrt(total // CELL) + 1, len(x)))
    books = codebook(x[:, :half], k), codebook(x[:, half:], k)

    def assign(batches):
        for b in batches:
            v = V.integers(b.column(3), dims)
            (c1, d1), (c2, d2) = coded(v[:, :half], books[0]), coded(v[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), pa.array(d1), pa.array(d2)],
                                             ["vec_id", "label", "anchor", "vec", "c1", "c2", "d1", "d2"])

    own = "vec_id long, label long, anchor boolean, vec array<long>, c1 int, c2 int"
    placed = save(rows.mapInArrow(assign, f"{own}, d1 double, d2 double"))
    cells = placed.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("a"), F.max("d2").alias("b")).collect()  # CODES ** 2 rows at most
    size = min(SHARD, max(1024, total // (2 * partitions(spark))))  # about two shards for each shuffle task, of bounded size
    index = Index(books, {(r["c1"], r["c2"]): (r["n"], r["a"], r["b"]) for r in cells}, size)
    n_anchors = placed.where("anchor").count()
    asks = max(1, -(-n_anchors // ASKS))

    def deal(batches):
        """Each row's shard; the rows of a crowded cell are spread by id."""
        for b in batches:
            where = [index.shards[c] for c in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            ids = b.column(0).to_numpy()
            shard = np.array([s + int(i) % p for (s, p), i in zip(where, ids, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), b.column(5), pa.array(shard)],
                                             ["vec_id", "label", "vec", "c1", "c2", "shard"])

    held = placed.select("vec_id", "label", "anchor", "vec", "c1", "c2").mapInArrow(deal, "vec_id long, label long, vec array<long>, c1 int, c2 int, shard long")
    held = held.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    anchors = placed.where("anchor").select("vec_id", "label", "vec")
    group = F.pmod(F.xxhash64("vec_id"), F.lit(asks)).cast("int").alias("ask")
    windows = "array<struct<low:long,high:long>>"

    def routed(asked: DataFrame, best_only: bool = False) -> DataFrame:
        def route(batches):
            for b in batches:
                q = V.integers(b.column(2), dims)
                least = b.column(3).to_numpy().astype(np.float64)
                who, shard = index.route(q, least - 1e-9 * np.abs(least) - 1, best_only)
                taken = b.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(shard)], ["vec_id", "label", "vec", "least", "windows", "ask", "shard"])

        return asked.mapInArrow(route, f"vec_id long, label long, vec array<long>, least long, windows {windows}, ask int, shard long")

    def each(all_: pa.Table, asked: pa.Table):
        shard, q = Shard(index, all_, dims), V.integers(asked.column("vec"), dims)
        one, two = index.bounds(q)
        ids, labels, least = (asked.column(c).to_numpy() for c in ("vec_id", "label", "least"))
        for i, w in enumerate(asked.column("windows").to_pylist()):
            yield shard, (q[i], ids[i], labels[i], one[i], two[i]), int(least[i]), w

    def find_positives(all_: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if all_.num_rows and asked.num_rows:
            for shard, args, least, _ in each(all_, asked):
                score, ids = shard.positives(*args, least, positives)
                out[0] += [args[1]] * len(ids)
                out[1] += ids.tolist()
                out[2] += score.tolist()
        return pa.table([pa.array(v, pa.int64()) for v in out], ["anchor_id", "positive_id", "score"])

    def find_negatives(all_: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if all_.num_rows and asked.num_rows:
            for shard, args, _, w in each(all_, asked):
                found = shard.negatives(*args, [(x["low"], x["high"]) for x in w], negatives)
                for w, (score, ids) in found.items():
                    for k, v in enumerate((args[1], *w)):
                        out[k] += [v] * len(ids)
                    out[3] += ids.tolist()
                    out[4] += score.tolist()
        return pa.table([pa.array(v, pa.int64()) for v in out], ["anchor_id", "low", "high", "negative_id", "score"])

    def meet(asked: DataFrame, task, kind: str) -> DataFrame:
        return held.groupBy("shard", "ask").cogroup(asked.groupBy("shard", "ask")).applyInArrow(task, kind)

    def firsts(found: DataFrame, keys: list[str], item: str, n: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), item)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    nothing = F.lit(None).cast(windows).alias("windows")
    start = anchors.select("vec_id", "label", "vec", F.lit(-(1 << 62)).cast(LONG).alias("least"), nothing, group)
    kind = "anchor_id long, positive_id long, score long"
    # The floor: the k-th score found in the shard of the best cell.
    near = save(meet(routed(start, best_only=True), find_positives, kind))
    floors = firsts(near, ["anchor_id"], "positive_id", positives).groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
    floors = floors.where(F.col("n") == positives).select(F.col("anchor_id").alias("vec_id"), "floor")
    going = anchors.join(floors, "vec_id", "left").select("vec_id", "label", "vec", F.coalesce("floor", F.lit(-(1 << 62))).cast(LONG).alias("least"), nothing, group)
    found = meet(routed(going), find_positives, kind)
    best = save(firsts(found, ["anchor_id"], "positive_id", positives).select("anchor_id", "positive_id", F.col("score").alias("positive_score")))

    # The window of a positive: low <= 100 * score / positive <= high, in whole numbers; empty ones go.
    p = F.col("positive_score").cast("decimal(38,0)")
    best = best.withColumn("low", F.ceil(p * low / 100).cast(LONG)).withColumn("high", F.floor(p * high / 100).cast(LONG)).where("low <= high")
    spans = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.min("low").alias("least"), F.collect_set(F.struct("low", "high")).alias("windows"))  # as many as positives
    hunting = anchors.join(spans, "vec_id").select("vec_id", "label", "vec", "least", "windows", group)
    found = meet(routed(hunting), find_negatives, "anchor_id long, low long, high long, negative_id long, score long")
    found = firsts(found, ["anchor_id", "low", "high"], "negative_id", negatives)
    return best.join(found, ["anchor_id", "low", "high"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))
