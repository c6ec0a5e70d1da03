"""Near-duplicate vectors with a robust-pruned flat graph over overlapping shards.

Distinct vectors of one label are dealt to the shards of their nearest centroids, as
many homes for each as an audit on planted neighbours asks for; the number does not
grow with the vectors. A shard judges all its pairs once, in the lowest shard that both
share, and keeps for each vector its nearest ones in range, pruned robustly. These
lists, united over all shards, are one flat graph for each label. A range search
expands over it from every vector to those in range of its neighbours that share no
shard with it, until nothing new comes; each of these is verified by its cosine.
A second audit compares whole links of some vectors with a brute-force search over all
rows, and widens the homes until the recall is reached.

Every vector is a node and knows its shards, so its search starts at itself; centroids
are the medoids that bring it there. Within a shard of bounded size one block product
costs a fifth of a beam search over the same vectors and misses nothing, so pairs of
a shard are judged by the product; the graph serves the pairs across shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from draftlens.llm import vectors as V
from draftlens.llm.common import components, drop, save

#: Vectors, lowest hash first, for fitting and auditing the homes; and most centroids.
SAMPLE, CENTROIDS = 16_384, 8192
#: Vectors of the most common label for each centroid, and those of a shard that meet in one task.
CLUSTER, PART = 1024, 4096
#: Neighbours a vector keeps of a shard, and how much nearer another must be to hide one.
DEGREE, ALPHA = 12, 1.2
#: Planted pairs of the first audit and the share that must meet; vectors of the second one and its recall.
PLANTED, MEET, AUDITED, RECALL = 2048, 0.998, 128, 0.98
BLOCK = 512
#: More than the rounding of single-precision products; pairs this close are judged in double precision.
CLOSE = 1e-5


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    rng = np.random.default_rng(3)
    c = x[np.sort(rng.permutation(len(x))[:k])]
    for _ in range(rounds if k * 16 <= len(x) else 1):
        own = homes_of(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def homes_of(x: np.ndarray, middle: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each vector, in ascending number."""
    n = min(n, len(middle))
    out = np.zeros((len(x), n), np.int32)
    for i in range(0, len(x), BLOCK):
        near = x[i:i + BLOCK] @ middle.T
        out[i:i + BLOCK] = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(middle) else np.arange(n)
    return np.sort(out, axis=1)


def wide_enough(x: np.ndarray, middle: np.ndarray, least: float, start: int = 2) -> int:
    """Homes with which vectors and planted neighbours just in range share one."""
    side = np.random.default_rng(5).normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(side, axis=1, keepdims=True)
    y = V.unit(least * x + np.sqrt(max(0.0, 1 - least * least)) * np.where(size > 1e-9, side / np.maximum(size, 1e-9), 0) + 1e-300)
    n = start
    while n < len(middle):
        one, two = homes_of(x, middle, n), homes_of(y, middle, n)
        if (one[:, :, None] == two[:, None, :]).any(axis=(1, 2)).mean() >= MEET:
            return n
        n += 1
    return len(middle)


def shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Lowest common home of each pair of rows."""
    both = (one[:, :, None] == two[:, None, :]).any(axis=2)
    return np.where(both, one, np.iinfo(np.int32).max).min(axis=1)


def in_range(x: np.ndarray, single: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (left, right) with cosine at least ``least``, and the cosine."""
    near = single[left] @ single[right].T
    a, b = np.nonzero(near >= least - CLOSE)
    score = near[a, b].astype(np.float64)
    a, b = left[a], right[b]
    edge = np.flatnonzero(score < least + CLOSE)
    for i in range(0, len(edge), 1 << 16):
        e = edge[i:i + (1 << 16)]
        score[e] = V.cosine(x[a[e]], x[b[e]])
    on = score >= least
    return a[on], b[on], score[on]


def pruned(x: np.ndarray, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's nearest (ids, -1 for none; score): those that no nearer kept one hides."""
    order = np.argsort(-score, axis=1, kind="stable")
    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    far = np.sqrt(np.maximum(0, 2 - 2 * score))
    keep = ids >= 0
    for j in range(1, ids.shape[1]):
        for i in range(j):
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nd->n", x[ids[:, i]], x[ids[:, j]])))
            keep[:, j] &= ~(keep[:, i] & (ALPHA * between <= far[:, j]))
    at, col = np.nonzero(keep)
    return rows[at], ids[at, col]


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable, given the roots so far and more pairs."""
    n = len(root)
    pairs = np.unique(root[a] * n + root[b])
    a, b = np.divmod(pairs, n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def shard(x: np.ndarray, copies: np.ndarray, homes: np.ndarray, cluster: int, left: np.ndarray, right: np.ndarray, least: float):
    """Links of each vector that are this shard's to count, roots, and the pruned lists."""
    n = len(x)
    single, links, root = x.astype(np.float32), np.zeros(n, np.int64), np.arange(n)
    ids, score = np.full((n, DEGREE), -1, np.int64), np.full((n, DEGREE), -np.inf)

    def closest(rows, to, near):
        """Merge more pairs into the nearest of each row."""
        order = np.lexsort((-near, rows))
        rows, to, near = rows[order], to[order], near[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, to, near, rank = (v[rank < DEGREE] for v in (rows, to, near, rank))
        who = np.unique(rows)
        wide = np.full((len(who), DEGREE), -1, np.int64), np.full((len(who), DEGREE), -np.inf)
        at = np.searchsorted(who, rows)
        wide[0][at, rank], wide[1][at, rank] = to, near
        both, value = np.concatenate([ids[who], wide[0]], axis=1), np.concatenate([score[who], wide[1]], axis=1)
        best = np.argsort(-value, axis=1, kind="stable")[:, :DEGREE]
        ids[who], score[who] = np.take_along_axis(both, best, 1), np.take_along_axis(value, best, 1)

    same = len(left) == len(right) and (left == right).all()
    for i in range(0, len(left), BLOCK):
        a, b, near = in_range(x, single, left[i:i + BLOCK], right, least)
        on = a != b
        a, b, near = a[on], b[on], near[on]
        if not len(a):
            continue
        for j in range(0, len(a), 1 << 18):
            p, q = a[j:j + (1 << 18)], b[j:j + (1 << 18)]
            mine = shared(homes[p], homes[q]) == cluster
            np.add.at(links, p[mine], copies[q[mine]])
            if not same:
                np.add.at(links, q[mine], copies[p[mine]])
        root = _roots(root, a, b)
        closest(a, b, near)
        if not same:
            closest(b, a, near)
    rows = np.flatnonzero(ids[:, 0] >= 0)
    return links, root, pruned(x, rows, ids[rows], score[rows])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """Link vectors of one label with a cosine of at least ``least``.

    One row per input row: vec_id, n_links (other rows linked directly), component_id
    (smallest id reachable, its own included), kept (its id is the component's).
    Vectors that are null, zero or hold null or non-finite components, and rows with
    a null label, link with nothing; nor do vectors of different lengths. Repeated
    rows are linked copies. Rows without an id count as links but name nothing:
    theirs is kept only if it is alone. Other columns are ignored.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vectors[vec_col].cast("array<double>").alias("vec"))
    good = V.usable(rows, "vec").where("label is not null").withColumn("node", F.xxhash64("label", "vec"))
    # Copies are one node; a hot one is first gathered in each task.
    nodes = save(good.groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
                 .withColumn("dims", F.size("vec")))
    facts = nodes.groupBy("label", "dims").count().agg(F.max("count").alias("most"), F.max("dims").alias("dims")).first()
    most, dims = facts["most"] or 0, facts["dims"] or 1
    full = F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dims) - F.col("dims")))  # only for dealing and within one length
    sample = nodes.select(full.alias("vec")).orderBy("node").limit(SAMPLE).collect()
    x = V.unit(np.array([r[0] for r in sample])) if sample else np.ones((1, 1))
    held_out = x[::8][:PLANTED] if len(x) > 1 else x
    fitted = x[np.arange(len(x)) % 8 != 0] if len(x) > 8 else x
    middle = centroids(fitted, min(CENTROIDS, len(fitted), max(1, -(-most // CLUSTER))))
    asked = nodes.orderBy(F.xxhash64("node")).limit(AUDITED).select("node", "label", "dims", full.alias("vec")).collect()
    true = brute_force(nodes.select("node", "label", "dims", full.alias("vec"), "copies"), asked, least) if len(middle) > 2 else {}

    n = wide_enough(held_out, middle, least)
    while True:
        found, counts, roots = links(nodes, full, middle, n, least)
        reached = {r["node"]: r["links"] for r in counts.where(F.col("node").isin(list(true))).collect()} if true else {}  # AUDITED rows
        if n >= len(middle) or sum(min(reached.get(k, 0), v) for k, v in true.items()) >= RECALL * sum(true.values()):
            break
        drop(found)
        n = min(len(middle), 2 * n)
    named = nodes.select("node", "copies", "low").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(lows, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    tagged = V.usable(rows, "vec").where("label is not null").select("vec_id", F.xxhash64("label", "vec").alias("node")).join(named, "node")
    tagged = tagged.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    alone = rows.where(~F.coalesce(finite & F.col("label").isNotNull(), F.lit(False)))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return tagged.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def brute_force(nodes: DataFrame, asked: list, least: float) -> dict[int, int]:
    """Links of a bounded number of vectors over all rows, copies counted: {node: links}."""
    q = V.unit(np.array([r["vec"] for r in asked]))
    ids, labels, sizes = [r["node"] for r in asked], [r["label"] for r in asked], np.array([r["dims"] for r in asked])

    def scan(batches):
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            node, copies = b.column(0).to_numpy(), b.column(4).to_numpy()
            a, c = np.nonzero(q @ V.unit(V.matrix(b.column(3))).T >= least)
            names = b.column(1).to_pylist()
            on = np.array([labels[i] == names[j] and ids[i] != node[j] for i, j in zip(a, c, strict=True)], bool)
            on &= sizes[a] == b.column(2).to_numpy()[c]
            np.add.at(total, a[on], copies[c[on]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], ["node", "n"])

    return {r["node"]: r["n"] for r in nodes.mapInArrow(scan, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect() if r["n"]}


def links(nodes: DataFrame, full, middle: np.ndarray, n_homes: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what shards found, node and links, node and root) with so many homes for each vector."""
    kind = nodes.schema["label"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            own = homes_of(V.unit(V.matrix(b.column(3))), middle, n_homes) if b.num_rows else np.zeros((0, 1), np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1], pa.array(own.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], ["node", "label", "dims", "vec", "copies", "homes"])

    placed = nodes.select("node", "label", "dims", full.alias("vec"), "copies").mapInArrow(
        assign, f"node long, label {kind}, dims int, vec array<double>, copies long, homes array<int>")
    dealt = placed.withColumn("cluster", F.explode("homes"))
    # A crowded shard is cut into parts; every pair of parts is a task.
    crowded = dealt.groupBy("label", "dims", "cluster").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).where("parts > 1")
    dealt = dealt.join(crowded, ["label", "dims", "cluster"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod("node", "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other"))
    dealt = dealt.select("label", "dims", "cluster", "p", "q", "part", "node", "vec", "copies", "homes")

    def task(t: pa.Table) -> pa.Table:
        x, node, copies = V.unit(V.matrix(t.column("vec"))), t.column("node").to_numpy(), t.column("copies").to_numpy()
        homes = V.integers(t.column("homes"), len(t.column("homes")[0])).astype(np.int32)
        part, p, q = t.column("part").to_numpy(), t.column("p")[0].as_py(), t.column("q")[0].as_py()
        left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
        count, root, (a, b) = shard(x, copies, homes, t.column("cluster")[0].as_py(), left, right, least)
        led = (homes[a] != homes[b]).any(axis=1)  # equal homes lead to no other shard
        a, b = a[led], b[led]
        on = np.flatnonzero((root != np.arange(len(x))) | (count > 0))
        lists = t.column("homes").combine_chunks() if isinstance(t.column("homes"), pa.ChunkedArray) else t.column("homes")
        none = pa.nulls(len(on), pa.list_(pa.int32()))
        return pa.table({
            "node": np.concatenate([node[on], node[a]]), "to": np.concatenate([node[root[on]], node[b]]),
            "links": pa.array(np.concatenate([count[on], np.zeros(len(a), np.int64)])),
            "homes": pa.concat_arrays([none, lists.take(pa.array(a)).cast(pa.list_(pa.int32()))]),
            "to_homes": pa.concat_arrays([none, lists.take(pa.array(b)).cast(pa.list_(pa.int32()))])})

    found = save(dealt.groupBy("label", "dims", "cluster", "p", "q").applyInArrow(task, "node long, to long, links long, homes array<int>, to_homes array<int>"))
    edges, counts = found.select(F.col("node").alias("a"), F.col("to").alias("b")), found.select("node", "links")
    if len(middle) > n_homes:
        across = expand(found.where("homes is not null"), nodes, least)
        if across is not None:
            edges = edges.union(across.select("a", "b"))
            weight = nodes.select("node", "copies")
            for one, two in (("a", "b"), ("b", "a")):
                counts = counts.union(across.select(F.col(one).alias("own"), F.col(two).alias("node")).join(weight, "node").select(F.col("own").alias("node"), F.col("copies").alias("links")))
    return found, counts.groupBy("node").agg(F.sum("links").alias("links")), components(edges)


def expand(lists: DataFrame, nodes: DataFrame, least: float) -> DataFrame | None:
    """Pairs (a < b) in range that share no home, reached over the united lists."""
    graph = lists.select("node", "to", "homes", "to_homes").distinct()
    step = graph.select(F.col("node").alias("via"), F.col("to").alias("c"), F.col("to_homes").alias("c_homes"))
    front = graph.select(F.col("node").alias("a"), F.col("homes").alias("a_homes"), F.col("to").alias("via"))
    size = F.array_max(F.transform("vec", F.abs))  # no overflow for very large components
    vec = nodes.select(F.col("node").alias("id"), F.zip_with("vec", F.array_repeat(size, F.col("dims")), lambda v, s: v / s).alias("vec"))
    known = None
    while True:
        pairs = front.join(step, "via").where((F.col("a") != F.col("c")) & ~F.arrays_overlap("a_homes", "c_homes")).select("a", "a_homes", "c", "c_homes")
        # Both ends look on: each pair once, in either direction.
        pick = lambda x, y: F.when(F.col("a") < F.col("c"), F.col(x)).otherwise(F.col(y))
        pairs = pairs.select(pick("a", "c").alias("a"), pick("a_homes", "c_homes").alias("a_homes"), pick("c", "a").alias("b"), pick("c_homes", "a_homes").alias("b_homes")).distinct()
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        pairs = pairs.join(vec.withColumnsRenamed({"id": "a", "vec": "va"}), "a").join(vec.withColumnsRenamed({"id": "b", "vec": "vb"}), "b")
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
        cosine = dot(F.col("va"), F.col("vb")) / (F.sqrt(dot(F.col("va"), F.col("va"))) * F.sqrt(dot(F.col("vb"), F.col("vb"))))
        watch = Observation()
        new = save(pairs.where(cosine >= least).select("a", "a_homes", "b", "b_homes").observe(watch, F.count(F.lit(1)).alias("n")))
        if not watch.get["n"]:
            return known
        known = new if known is None else known.union(new)
        front = new.select("a", "a_homes", F.col("b").alias("via")).union(new.select(F.col("b").alias("a"), F.col("b_homes").alias("a_homes"), F.col("a").alias("via")))
