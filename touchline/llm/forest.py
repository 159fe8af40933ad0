"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives every vector a string of BITS bits, the sides of as many random hyperplanes on
which it lies, and keeps the strings as sorted arrays, so that the vectors that share a prefix
of any length with a query lie next to each other. A query descends to the longest prefix
that it shares with any row in any tree, and then ascends in all trees at once, a bit at a time, until it
has met enough different rows; their distances are exact. How far it ascends is its own: in a dense place few
bits, in a sparse one many.

How many rows are enough is measured: for PILOTS queries the nearest rows are found by comparing them with all
rows, and each of these asks for as many rows as share a longer prefix with its pilot, and itself. The number
that holds the wanted share of them is taken for all queries.
More rows have nearer neighbours, which share longer prefixes, so the share of rows that are compared falls as
tables grow. On vectors without any clusters it is large for small tables, whatever the
index: what is near is hardly nearer than the rest.

The trees' hyperplanes are the same everywhere. Rows are dealt to blocks of bounded size by a hash, and
a block sorts its own strings: all blocks' ranges together are the ranges of one forest over all rows, and a block answers for its
share of the rows that are enough. Each row goes to one block, whose forest is built once; then the queries stream through it.
Where there are many blocks, the first SAMPLE-th of them bounds each query's distances, so
that the others return only what can still be among the nearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, table, written
from .vectors import clean

BITS, PILOTS, SAMPLE = 32, 64, 32


class Trees:
    """Hyperplanes through center: trees x BITS of them."""

    def __init__(self, center: np.ndarray, trees: int, seed: int = 5):
        self.center, self.trees = center, trees
        self.planes = np.random.default_rng(seed).normal(size=(len(center), trees * BITS)).astype(np.float32)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """trees x rows strings, the first hyperplane in the highest bit."""
        out = np.empty((self.trees, len(x)), np.uint32)
        for s in range(0, len(x), 1024):
            y = x[s : s + 1024] - self.center
            y = y / np.maximum(np.abs(y).max(axis=1, keepdims=True), 1e-300)  # sides don't depend on lengths
            sides = y.astype(np.float32) @ self.planes > 0
            out[:, s : s + 1024] = np.packbits(sides.reshape(len(sides), self.trees, BITS), axis=2).view(">u4")[:, :, 0].T
        return out


def shared_depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For columns of strings the longest prefix that they share in any tree."""
    return (BITS - np.ceil(np.log2((a ^ b).min(axis=0).astype(np.float64) + 1))).astype(int)


class Forest:
    """The sorted strings of some rows, at least one."""

    def __init__(self, x: np.ndarray, trees: Trees):
        keys = trees.keys(x)
        self.n, self.trees = len(x), trees.trees
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(keys, self.order, 1)

    def longest(self, keys: np.ndarray) -> np.ndarray:
        """The longest prefix that each query shares with any row in any tree: with a neighbour of its place in the order."""
        at = np.stack([np.searchsorted(some, k) for some, k in zip(self.sorted, keys, strict=True)])
        left, right = (np.take_along_axis(self.sorted, p, 1) for p in (np.maximum(at - 1, 0), np.minimum(at, self.n - 1)))
        return np.maximum(shared_depth(left, keys), shared_depth(right, keys))

    def candidates(self, keys: np.ndarray, least: int, other: np.ndarray | None = None) -> np.ndarray:
        """Queries x rows: what is met in all trees from the longest prefixes upwards, to the first length at which least of the
        rows are met that other (queries x rows) marks, or all of these."""
        seen = np.zeros((keys.shape[1], self.n), bool)
        wanted = np.minimum(least, self.n if other is None else other.sum(axis=1)) * np.ones(len(seen), int)
        longest, open_ = self.longest(keys), np.flatnonzero(wanted > 0)
        for length in range(longest.max(initial=0), -1, -1):
            here = open_[longest[open_] >= length]
            low = keys[:, here] & np.uint32(((1 << length) - 1) << (BITS - length))
            high = low | np.uint32((1 << (BITS - length)) - 1)
            begin = np.stack([np.searchsorted(some, k) for some, k in zip(self.sorted, low, strict=True)])
            end = np.stack([np.searchsorted(some, k, side="right") for some, k in zip(self.sorted, high, strict=True)])
            may = np.flatnonzero((end - begin).sum(axis=0) >= wanted[here])  # a row counts once a tree here: no fewer than are met
            for c in may.tolist():
                row = seen[here[c]]
                for order, i, j in zip(self.order, begin[:, c].tolist(), end[:, c].tolist(), strict=True):
                    row[order[i:j]] = True
            met = seen[here[may]] if other is None else seen[here[may]] & other[here[may]]
            open_ = np.setdiff1d(open_, here[may][met.sum(axis=1) >= wanted[here[may]]])
            if not len(open_):
                break
        return seen


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x from q; scaled, so that no square overflows or vanishes."""
    away = x - q
    most = np.abs(away).max(initial=0)
    scale = 1.0 if 1e-100 < most < 1e100 or most == 0 else 2.0 ** np.floor(np.log2(most))
    return scale * np.sqrt(((away / scale) ** 2).sum(axis=1))


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, within: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest rows but the query's own, ties to the smaller id."""
    on = np.flatnonzero(ids != own)
    far = distances(x[on], q)
    near = np.flatnonzero(far <= within)
    near = near[np.lexsort((ids[on[near]], far[near]))[:k]]
    return on[near], far[near]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _runs(batches):
    """Runs of rows that agree in the first two columns, a batch at a time."""
    for b in batches:
        if b.num_rows:
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                yield *key[:, start].tolist(), b.slice(start, stop - start)


def _measured(rows: DataFrame, queries: DataFrame, dim: int, k: int, trees: int, recall: float) -> tuple[Trees, int]:
    """The trees of the vectors of one length, and how many rows a query must meet."""

    def sums(found):
        total, n = np.zeros(dim), 0
        for b in found:
            x = _matrix(b.column(0))
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["total", "n"])

    added = rows.select("v").mapInArrow(sums, "total array<double>, n long").select(F.posexplode("total"), "n").groupBy("pos").agg((F.sum("col") / F.sum("n")).alias("mean"))
    center = np.array([r["mean"] for r in added.orderBy("pos").collect()])
    made = Trees(np.where(np.isfinite(center), center, 0.0), trees)
    pilots = queries.orderBy(F.xxhash64("_id"), "_id").limit(PILOTS).collect()  # PILOTS vectors
    asked = [(r["_id"], np.array(r["v"])) for r in pilots]
    asked_keys = made.keys(np.array([q for _, q in asked]))

    def met(found):
        """Each pilot's nearest with the prefixes they share with it, and how many rows share prefixes of each length."""
        held, lengths = [[] for _ in asked], np.zeros((len(asked), BITS + 1), np.int64)
        for b in found:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1))
            keys = made.keys(x)
            for p, (i, q) in enumerate(asked):
                depth = shared_depth(keys, asked_keys[:, p : p + 1])
                lengths[p] += np.bincount(depth[ids != i], minlength=BITS + 1)
                at, far = best(x, ids, q, i, k, np.inf)
                held[p] = sorted([*held[p], *zip(far.tolist(), ids[at].tolist(), depth[at].tolist(), strict=True)])[:k]
        rows = [(p, d, o, length, 0) for p, some in enumerate(held) for d, o, length in some]
        rows += [(p, None, None, length, int(lengths[p, length])) for p, length in zip(*np.nonzero(lengths), strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["p", "score", "other", "length", "n"])

    seen = written(rows.select("_id", "v").mapInArrow(met, "p long, score double, other long, length long, n long"), "pilots")
    counted = np.zeros((len(asked), BITS + 2), np.int64)
    for r in seen.where("other is null").groupBy("p", "length").agg(F.sum("n").alias("n")).collect():  # PILOTS x BITS counts
        counted[r.p, r.length] = r.n
    longer = counted[:, ::-1].cumsum(axis=1)[:, ::-1]  # [p, l]: rows that share l bits or more
    rank = F.row_number().over(Window.partitionBy("p").orderBy("score", "other"))
    true = seen.where("other is not null").withColumn("_rn", rank).where(F.col("_rn") <= k).collect()  # k rows of each pilot
    drop_written(seen)
    needed = np.sort([longer[r.p, r.length + 1] + 1 for r in true])
    return made, int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else k


def nearest(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = 96,
    recall: float = 0.94,
    block: int = 16384,
) -> DataFrame:
    """Rows (query_id, rank, id_col, score): each query's k nearest found, by Euclidean distance, ties to the smaller id.

    Queries are the rows whose id is divisible by every, candidates all rows with other
    ids; fewer than k candidates are all returned. recall is the share of the pilots' nearest that the number of rows to
    meet is chosen for. Vectors that are null, zero, or hold
    null or non-finite components take no part, nor do rows with a null id; vectors
    of different lengths never meet. Repeated rows are candidates each; an id asks once,
    by the first of its vectors in order. Ids are whole numbers. Other columns are ignored.

    Equal vectors are equally far from every query, so of each only those with the k + 1 smallest ids, k times each at most, can be
    among the k nearest of any query: the others stay out of the blocks, and no group of copies is compared as a whole.
    """
    spark = vectors.sparkSession
    cleaned = clean(vectors, id_col, vector_col).where("ok and _id is not null").select("_id", "v")
    first = F.row_number().over(Window.partitionBy("v").orderBy("_id"))
    told_apart = cleaned.groupBy("v", "_id").agg(F.count("*").alias("n")).withColumn("_rn", first).where(F.col("_rn") <= k + 1)
    times = F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy")
    rows = written(told_apart.select("_id", "v", F.size("v").alias("dim"), times), "points")
    queries = written(cleaned.where(F.col("_id") % every == 0).groupBy("_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "queries")
    results = [spark.createDataFrame([], "query_id long, other long, score double")]
    for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():  # the lengths of vectors, a handful
        mine, asking = rows.where(F.col("dim") == r.dim), queries.where(F.col("dim") == r.dim)
        if asking.limit(1).count():
            results.append(_search(mine, asking, r.dim, r.n, k, trees, recall, block))
    drop_written(rows)
    drop_written(queries)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("other").alias(id_col), "score")


def _search(rows, queries, dim, total, k, trees, recall, block) -> DataFrame:
    """Each block's k nearest of each query; a task holds one block and one batch of queries."""
    made, enough = _measured(rows, queries, dim, k, trees, recall)
    shared = rows.sparkSession.sparkContext.broadcast(made)  # dim x trees x BITS floats
    blocks = max(1, -(-total // block))
    dealt = rows.select(F.pmod(F.xxhash64("_id", "v", "copy"), F.lit(blocks)).cast("int").alias("blk"), F.lit(0).alias("asks"), "_id", "v", F.lit(None).cast("double").alias("within"))

    def search(batches):
        block_id, held, forest = None, [], None
        for blk, asks, part in _runs(batches):
            if blk != block_id:
                block_id, held, forest = blk, [], None
            if not asks:
                held.append(part)
                continue
            if held:
                all_rows = pa.Table.from_batches(held)
                x, ids, held = _matrix(all_rows["v"]), all_rows["_id"].to_numpy(), []
                forest, least = Forest(x, shared.value), max(k, -(-enough * len(ids) // total))
            if forest is None:  # a block without rows
                continue
            q, own, within = _matrix(part.column(3)), part.column(2).to_numpy(), part.column(4).to_numpy()
            for s in range(0, len(q), 256):
                other = ids != own[s : s + 256, None]
                seen = forest.candidates(shared.value.keys(q[s : s + 256]), least, other)
                out = [best(x[at], ids[at], q[s + i], own[s + i], k, within[s + i]) + (at,) for i, at in enumerate(map(np.flatnonzero, seen))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own[s : s + 256], [len(near) for near, _, _ in out])), pa.array(np.concatenate([ids[at[near]] for near, _, at in out])), pa.array(np.concatenate([far for _, far, _ in out]))],
                    names=["query_id", "other", "score"],
                )

    def over(first: int, stop: int, bounds: DataFrame | None) -> DataFrame:
        asking = queries.withColumn("within", F.lit(float("inf"))) if bounds is None else queries.join(bounds, "_id", "left").withColumn("within", F.coalesce("within", F.lit(float("inf"))))
        asking = asking.select(F.explode(F.sequence(F.lit(first), F.lit(stop - 1))).alias("blk"), F.lit(1).alias("asks"), "_id", "v", "within")
        both = dealt.where((F.col("blk") >= first) & (F.col("blk") < stop)).unionByName(asking)
        each = both.repartitionById(min(stop - first, 8192), F.col("blk") - first).sortWithinPartitions("blk", "asks")
        return written(each.mapInArrow(search, "query_id long, other long, score double"), "found")

    if blocks < 2 * SAMPLE:
        return over(0, blocks, None)
    sample = over(0, blocks // SAMPLE, None)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "other"))
    bounds = sample.withColumn("_rn", rank).where(F.col("_rn") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("within"))
    return sample.unionByName(over(blocks // SAMPLE, blocks, bounds))


def op8_forest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
