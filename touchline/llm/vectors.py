"""Near duplicates among embeddings by spherical-cap filters.

A filter is a direction; a vector passes if their inner product reaches a threshold.
The directions form product codes: for each code a random rotation, then one unit vector
for each block of coordinates, drawn at random from a small book of each block. So all filters
that a vector passes are list-decoded: a block's scores are sorted, and only the sums
that can still reach the threshold are completed. Vectors that pass a common filter
meet there, and their cosine is computed in double precision.

A pair is counted at the first of the filters that both pass, so each link counts once
without emitting pairs: a filter's task returns for each of its vectors how many links
it found first, and a spanning forest of all its links. A filter with more than CHUNK
vectors is dealt to one task for each pair of its parts.

Filters take the vectors rounded to a byte a coordinate; where the rounded cosine, with the
rounding's bound, can reach the threshold, the rows are fetched in full. Equal vectors are one
class, compared once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sets, components, drop_written, groups, spread_join, table, whole_ids, written
from .jaccard import _dealt

CHUNK = 1024


class Code:
    """The filters for dim coordinates: 2 blocks of book words each, and the threshold on the sum of a vector's two scores.

    A random vector passes about passes of the book ^ 2 filters. Everything follows from
    dim, book, passes and seed.
    """

    def __init__(self, dim: int, book: int, passes: int = 32, seed: int = 7):
        r = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(r.normal(size=(dim, dim)))[0]
        cut = dim // 2
        self.cuts, self.book = (slice(0, cut), slice(cut, dim)), book
        self.words = []
        for c in self.cuts:
            w = r.normal(size=(book, max(1, c.stop - c.start)))[:, : c.stop - c.start]
            self.words.append(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12) / np.sqrt(2))
        probe = _unit(r.normal(size=(1000, dim)))
        few = min(book, 64)
        sums = (probe[:, self.cuts[0]] @ self.words[0][:few].T)[:, :, None] + (probe[:, self.cuts[1]] @ self.words[1][:few].T)[:, None, :]
        self._sums = np.sort(sums.astype(np.float32), axis=None)[-sums.size // 4 :]
        self.let_pass(passes)

    def let_pass(self, passes: int) -> None:
        """Sets the threshold by what random vectors' sums are; where a fifth of the filters or more should pass, all do."""
        if 5 * passes >= self.book**2:
            self.threshold = -np.inf
            return
        at = len(self._sums) - 1 - round(4 * len(self._sums) * passes / self.book**2)
        self.threshold = float(self._sums[max(0, at)])

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "_sums"}

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unit vectors the pairs (row, filter) that pass, by row and filter; a vector that passes none takes its best filter."""
        turned = unit @ self.rotation
        first, second = (turned[:, c] @ w.T for c, w in zip(self.cuts, self.words, strict=True))
        by = np.argsort(-second, axis=1)
        ranked = np.take_along_axis(second, by, 1)
        row, top = np.nonzero(first + ranked[:, :1] >= self.threshold)
        rows, filters, rank = [], [], 0
        while len(row):  # the second block's words in turn, as long as the sums reach the threshold
            rows.append(row)
            filters.append(top * self.book + by[row, rank])
            rank += 1
            if rank == self.book:
                break
            on = first[row, top] + ranked[row, rank] >= self.threshold
            row, top = row[on], top[on]
        none = np.ones(len(unit), bool)
        none[np.concatenate(rows) if rows else np.zeros(0, int)] = False
        rest = np.flatnonzero(none)
        rows.append(rest)
        filters.append(np.argmax(first[rest], axis=1) * self.book + by[rest, 0])
        rows, filters = np.concatenate(rows), np.concatenate(filters)
        order = np.lexsort((filters, rows))
        return rows[order], filters[order]


def found_together(codes: list[Code], similarity: float, pairs: int = 1000, seed: int = 11) -> float:
    """The share of random pairs with exactly this cosine that pass a common filter."""
    r = np.random.default_rng(seed)
    dim = len(codes[0].rotation)
    if dim < 2:
        return 1.0
    x = _unit(r.normal(size=(pairs, dim)))
    y = r.normal(size=(pairs, dim))
    y = _unit(y - (y * x).sum(1, keepdims=True) * x)
    y = similarity * x + np.sqrt(max(0.0, 1 - similarity**2)) * y
    hit = np.zeros(pairs, bool)
    for c in codes:
        mine, theirs = (row * c.book**2 + filters for row, filters in map(c.decode, (x, y)))
        hit[np.intersect1d(mine, theirs, assume_unique=True) // c.book**2] = True
    return float(hit.mean())


def codes_for(dim: int, book: int, similarity: float, recall: float, codes: int = 3, passes: int = 8) -> list[Code]:
    """Codes with the fewest passes, in steps of a quarter, of which simulated pairs at the threshold say that recall is reached;
    if need be all filters pass, and all vectors meet."""
    passes = min(passes, book * book)
    made = [Code(dim, book, passes, seed=7 + i) for i in range(codes)]
    while passes < book * book and found_together(made, similarity) < recall:
        passes = min(passes * 5 // 4 + 1, book * book)
        for c in made:
            c.let_pass(passes)
    return made


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows to length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id, v (array of doubles) and ok: not null or zero, nor with null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(whole_ids(vectors, id_col).alias("_id"), v.alias("v"), F.coalesce(ok, F.lit(False)).alias("ok"))


def _packed(unit: np.ndarray) -> list[bytes]:
    """For each unit vector its coordinates in steps of its largest over 127, a byte each, and the step."""
    step = np.maximum(np.abs(unit).max(axis=1), 1e-30).astype(np.float32) / np.float32(127)
    cells = np.rint(unit / step[:, None]).clip(-127, 127).astype(np.int8)
    return [c.tobytes() + t.tobytes() for c, t in zip(cells, step, strict=True)]


def _may_link(similarity: float, dim: int):
    """For batches sorted by filter and tile: the rows that may have a link there. Rounding a coordinate moves it by half a
    step at most, so a vector by sqrt(dim) half steps, and this bounds every cosine from above."""

    def linked(cells, step, part):
        """Groups of one size: which rows may link with another one."""
        x = cells.astype(np.float32) * step[..., None]
        slack = np.sqrt(dim) / 2 * step
        near = x @ x.transpose(0, 2, 1) + slack[:, :, None] + slack[:, None, :] + slack[:, :, None] * slack[:, None, :] >= similarity - 1e-4
        near &= (step[:, :, None] > 0) & (step[:, None, :] > 0)  # rows of step 0 fill groups up
        near &= ~np.eye(near.shape[1], dtype=bool)
        two = (part.max(axis=1) != part.min(axis=1, where=step > 0, initial=1 << 30))[:, None, None]
        near &= ~two | (part[:, :, None] != part[:, None, :])
        return near.any(axis=2)

    def active(t: pa.Table) -> np.ndarray:
        key = np.stack([t["filter"].to_numpy(), t["_c"].to_numpy()])
        starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1])
        sizes = np.diff(np.append(starts, t.num_rows))
        raw = np.frombuffer(b"".join(t["packed"].to_pylist()), np.int8).reshape(-1, dim + 4)
        cells, step, part = raw[:, :dim], raw[:, dim:].copy().view(np.float32)[:, 0], t["_part"].to_numpy()
        out = np.zeros(t.num_rows, bool)
        width = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        for m in np.unique(width[sizes > 1]).tolist():
            of = np.flatnonzero((width == m) & (sizes > 1))
            each = max(1, 2_000_000 // (m * max(m, dim)))
            for i in range(0, len(of), each):
                some = of[i : i + each]
                at = starts[some, None] + np.arange(m)
                full = np.arange(m) < sizes[some, None]
                at = np.where(full, at, starts[some, None])
                hit = linked(cells[at], np.where(full, step[at], 0), np.where(full, part[at], 0))
                out[at[hit & full]] = True
        return out

    def batches(found):
        held = None
        for b in found:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            last = (t["filter"][-1].as_py(), t["_c"][-1].as_py())
            key = np.stack([t["filter"].to_numpy(), t["_c"].to_numpy()])
            cut = int(np.flatnonzero((key != np.array(last)[:, None]).any(0))[-1]) + 1 if (key != np.array(last)[:, None]).any() else 0
            done, held = t.slice(0, cut), t.slice(cut)
            if cut:
                yield from done.filter(pa.array(active(done))).select(["filter", "_c", "_part", "cls"]).to_batches()
        if held is not None:
            yield from held.filter(pa.array(active(held))).select(["filter", "_c", "_part", "cls"]).to_batches()

    return batches


def _compare(similarity: float, dim: int, kind: str):
    """For every tile of rows that may link: each row's links that are first found here, and a spanning forest of all links."""

    def batches(found):
        for _, t in groups(found, 2):
            if t.num_rows < 2:
                continue
            ids, copies, part = t["cls"].to_numpy(), t["copies"].to_numpy(), t["_part"].to_numpy()
            x = _unit(np.frombuffer(b"".join(t["vector"].to_pylist()), kind).astype(np.float64).reshape(-1, dim))
            lists = [np.asarray(y, np.int64) for y in t["before"].to_pylist()]
            linked = x @ x.T >= similarity
            np.fill_diagonal(linked, False)
            if part.min() != part.max():
                linked &= part[:, None] != part[None, :]
            at = np.flatnonzero(linked.any(1))
            if not len(at):
                continue
            sub = linked[np.ix_(at, at)]
            earlier = np.unique(np.concatenate([lists[i] for i in at.tolist()]))
            if len(earlier):
                has = np.zeros((len(at), len(earlier)), np.float32)
                for row, i in enumerate(at.tolist()):
                    has[row, np.searchsorted(earlier, lists[i])] = 1
                first = sub & (has @ has.T == 0)
            else:
                first = sub
            n = first @ copies[at]
            sets, out = Sets(len(at)), []
            for i in range(len(at)):
                for j in np.flatnonzero(sub[i, i + 1 :]).tolist():
                    if sets.merge(i, i + 1 + j):
                        out.append((int(ids[at[i]]), int(ids[at[i + 1 + j]])))
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids[at].tolist(), *a], pa.int64()), pa.array([None] * len(at) + list(b), pa.int64()), pa.array([*n.tolist(), *[0] * len(a)], pa.int64())], names=["a", "b", "n"]
            )

    return batches


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = 0.9, recall: float = 0.98, book: int | None = None, codes: int = 3) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept.

    n_links counts the other rows whose cosine is similarity or more and that were
    found; component_id is the smallest id that links reach, kept says whether it is
    the row's own. recall is the share of pairs at exactly that cosine that are found; pairs that
    are closer are found more often. The number of filters that a vector passes follows from it and from the
    number of rows, by simulation. Vectors that are null, zero, or hold null or non-finite components
    have no links and are their own component. Vectors of different lengths never link.
    Rows with the same id are one node of the components and separate rows in counts; a
    null id keeps n_links but has no component. Ids are whole numbers. Other columns are ignored.

    Vectors go to their filters as bytes; only the rows that may link there are fetched in full.
    """
    spark = vectors.sparkSession
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    rows = written(clean(vectors, id_col, vector_col).select("_id", "v", "ok", *hashes), "vectors")
    total = rows.count()
    book = book or 1 << max(6, (max(total, 1) - 1).bit_length() + 1 >> 1)
    good = rows.where("ok").withColumn("dim", F.size("v"))
    classes = written(good.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("_id").alias("rep"), F.count("*").alias("copies"), F.first("dim").alias("dim")).withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    dims = [r.dim for r in classes.groupBy("dim").count().orderBy("dim").collect()]  # the lengths of vectors, a handful
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"

    counted, forests = [], []
    for dim in dims:
        shared = spark.sparkContext.broadcast(codes_for(dim, book, similarity, recall, codes))  # for each 2 x book words and a rotation

        def passing(found, shared=shared, dim=dim):
            for b in found:
                for s in range(0, b.num_rows, 512):
                    part = b.slice(s, 512)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    unit = _unit(x)
                    found_by = [code.decode(unit) for code in shared.value]
                    row = np.concatenate([r for r, _ in found_by])
                    filt = np.concatenate([f + i * book * book for i, (_, f) in enumerate(found_by)])
                    row, filt = row[by := np.lexsort((filt, row))], filt[by]
                    starts = np.searchsorted(row, np.arange(len(x) + 1))
                    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(filt, pa.int64()))
                    cells = pa.array([v.astype(kind).tobytes() for v in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), cells, pa.array(_packed(unit), pa.binary()), lists], names=["cls", "copies", "vector", "packed", "filters"])

        passed = written(classes.where(F.col("dim") == dim).select("cls", "v", "copies").mapInArrow(passing, "cls long, copies long, vector binary, packed binary, filters array<long>"), "passed")
        narrow = passed.select("cls", "packed", F.explode("filters").alias("filter"))
        crowded = written(passed.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count("*").alias("_m")).where(F.col("_m") > CHUNK), "crowded")
        dealt = narrow.withColumns({"_c": F.lit(0).cast("long"), "_part": F.lit(0)})
        if crowded.count():
            rest = narrow.join(crowded, "filter", "left_anti").withColumns({"_c": F.lit(0).cast("long"), "_part": F.lit(0)})
            dealt = rest.unionByName(_dealt(narrow, crowded, ["filter"], CHUNK, "cls").withColumn("_c", F.col("_c").cast("long")))
        keys = ["filter", "_c"]
        may = written(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_may_link(similarity, dim), "filter long, _c long, _part int, cls long"), "may-link")
        whole = may.join(passed.drop("packed"), "cls").withColumn("before", F.expr("slice(filters, 1, cast(array_position(filters, filter) as int) - 1)"))
        found = written(whole.select("filter", "_c", "_part", "cls", "copies", "vector", "before").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(similarity, dim, kind), "a long, b long, n long"), "links")
        counted.append(found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n")))
        forests.append(found.where("b is not null").select("a", "b"))
        for t in (passed, crowded, may):
            drop_written(t)

    if not dims:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.col("_id").isNotNull().alias("kept"))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    # forests are between classes; the components are between ids, each class standing for its smallest id
    reps = classes.select("cls", "rep").where("rep is not null")
    edges = union(forests).join(reps.select(F.col("cls").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("cls").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    known = good.where("_id is not null").select("_id", "h1", "h2").distinct()
    several = known.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    bridges = known.join(several, "_id", "left_semi").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("_id").alias("a"), F.col("rep").alias("b"))
    reached = components(edges.unionByName(bridges))
    of_class = (
        classes.join(union(counted), "cls", "left").join(reached.withColumnRenamed("id", "rep"), "rep", "left")
        .select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"), "copies")
    )
    linked = spread_join(rows.where("ok").select("_id", "h1", "h2"), of_class, ["h1", "h2"], "copies", total).select("_id", "n_links", "component_id")
    alone = rows.where("not ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_vectors(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
