"""Join of documents by the Jaccard similarity of their word shingles, in size-banded tiles.

Documents with the same set are one class. Size bands have edges a factor 1.25 apart,
so sets that can be similar enough lie in the same band or in neighbouring ones, and a
tile holds one band with the one above. Inside a tile sets are first compared by
bitmaps of their hashed shingles: every bit in which two differ is an element of one
only, so (sizes - differing bits) / 2 bounds the overlap from above. What passes the
bound is compared exactly, as sorted arrays.

Which classes meet in a tile: those that share one of the first shingles of their prefixes. In one order of all shingles,
here by hash, two sets of n and m elements that are similar enough share one of the first
n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1. Of these prefixes the first MOST shingles are used: sets of up to
5 x (MOST - 1) shingles can't be missed at all, and of larger pairs at 0.8 a share under
0.2 ^ MOST = 2e-17 is missed, as each of the smallest hashes of their union is in both with a probability of the similarity.

    1. shingle every text once: size, hash of the set, prefix, bitmap
    2. shingles of prefixes that two classes share; tiles by shingle and band: bitmaps only; a spanning forest of what may be linked
    3. its components: each class with possible links now stands in one group
    4. tiles by group: exact comparison; a spanning forest of the links
    5. components of the links

A tile of more than CHUNK rows is dealt to pairs of its parts, one of more than PARTS parts in rounds. Each part is joined by itself; then one
anchor of each component that it has now meets the others' anchors; only tiles
that are still in pieces, and of these only the pieces, are met by all pairs of parts. Pairs that a task has already connected
aren't compared, so groups of near copies take about one comparison for each member, and
no pairs are emitted but forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_written, groups, spread_join, table, whole_ids, written
from .shingles import mix, shingles

CHUNK = 2048
#: Tiles of up to so many parts are dealt to all pairs of parts at once; rounds pay for larger ones.
PARTS = 16
#: Shingles of each prefix by which classes meet; whole prefixes of long texts need more than four times the input's disk.
MOST = 24
#: Bits of a bitmap for each shingle, at least.
BITS = 4
EDGES = [1]
while EDGES[-1] < 1 << 60:
    EDGES.append(EDGES[-1] * 5 // 4 + 1)
_EDGES = np.array(EDGES)


def band_of(n: int) -> int:
    return int(np.searchsorted(_EDGES, n, side="right"))


def width_of(band: int) -> int:
    """Bits of the bitmaps in a band: a power of two, BITS or more for each shingle."""
    return 1 << max(6, int(BITS * EDGES[min(band, len(EDGES) - 1)] - 1).bit_length())


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """bits bits as 64-bit words; halving the width joins its halves by or."""
    out = np.zeros(bits, np.uint8)
    out[(mix(hashes) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, bits: int) -> np.ndarray:
    while len(words) * 64 > bits:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def enough(overlap, total, percent: int):
    """100 x overlap >= percent x union, where union = total - overlap."""
    return (100 + percent) * overlap >= percent * total


def prefix_of(n: int, percent: int) -> int:
    """How many shingles of a set of n, in any order that all sets follow, hold one that every similar enough set has among its own."""
    return n - -(-percent * n // 100) + 1 if n else 0


def profile(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """One row per input row: _id, n, h1, h2 (hash of the set, null if it is empty), band, prefix, bits."""

    def batches(found):
        for b in sliced(found):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(text.as_py(), k)
                if not len(s):
                    rows.append((doc, 0, None, None, 0, [], b""))
                    continue
                h, band = xxhash.xxh3_128_intdigest(s.tobytes()), band_of(len(s))
                low, high = np.array([h & (1 << 64) - 1, h >> 64], np.uint64).view(np.int64).tolist()
                rows.append((doc, len(s), low, high, band, s[: min(MOST, prefix_of(len(s), percent))].view(np.int64), bitmap(s, width_of(band)).tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["_id", "n", "h1", "h2", "band", "prefix", "bits"])

    return docs.select(whole_ids(docs, id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        batches, "_id long, n long, h1 long, h2 long, band int, prefix array<long>, bits binary"
    )


def sliced(found, rows: int = 256):
    """Batches in runs of rows, so that what is made of a batch's texts is never held for all of it."""
    for b in found:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def _repeated(found):
    """Of batches sorted by their first column the rows that agree in it with the row before or after."""
    held, again = None, False  # the last row, and whether it agrees with the one before
    for b in found:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        key = t.column(0).to_numpy()
        same = np.append(again, key[1:] == key[:-1])
        keep = same[:-1] | same[1:]
        yield from t.slice(0, len(key) - 1).filter(pa.array(keep, pa.bool_())).to_batches()
        held, again = t.slice(len(key) - 1), bool(same[-1])
    if again:
        yield from held.to_batches()


def _dealt(rows: DataFrame, counts: DataFrame, keys: list[str], chunk: int, id_col: str) -> DataFrame:
    """Rows of each tile, dealt to pairs of its parts: adds _c (the pair) and _part (the row's own part)."""
    parts = F.ceil(F.col("_m") / chunk).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    return (
        rows.join(counts.withColumn("_parts", parts).drop("_m"), keys)
        .withColumn("_part", F.pmod(F.xxhash64(id_col), F.col("_parts").cast("long")).cast("int"))
        .select("*", other.alias("_other"))
        .withColumn("_c", F.least("_part", "_other").cast("long") * F.col("_parts") + F.greatest("_part", "_other"))
        .drop("_other", "_parts")
    )


def _meet(rows: DataFrame, keys: list[str], chunk: int, compare) -> DataFrame:
    """Edges (a, b) of a forest that connects the rows' cls wherever compare links two of one tile, by rounds for tiles of more than chunk rows.

    compare takes batches sorted by keys and _c, with the columns _part and _label: rows of one label are connected
    already, and where a tile has two parts only rows of different ones meet.
    """
    order = [*keys, "_c"]
    zero = {"_c": F.lit(0).cast("long"), "_part": F.lit(0)}
    columns = [*order, "_part", "_label", *[c for c in rows.columns if c not in (*keys, "_label")]]
    met = lambda tiles: written(tiles.select(*columns).repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long"), "forest")
    rows = rows.withColumn("_label", F.col("cls"))
    crowded = written(rows.groupBy(*keys).agg(F.count("*").alias("_m")).where(F.col("_m") > chunk), "crowded")
    if not crowded.count():
        return met(rows.withColumns(zero))
    if not crowded.where(F.col("_m") > PARTS * chunk).count():
        return met(rows.join(crowded, keys, "left_anti").withColumns(zero).unionByName(_dealt(rows, crowded, keys, chunk, "cls")))
    hot = rows.join(crowded.withColumn("_parts", F.ceil(F.col("_m") / chunk)).drop("_m"), keys).withColumn("_c", F.pmod(F.xxhash64("cls"), F.col("_parts"))).drop("_parts")
    hot = written(hot.withColumn("_part", F.lit(0)), "hot-tiles")
    one = met(rows.join(crowded, keys, "left_anti").withColumns(zero).unionByName(hot))

    def labelled(edges: DataFrame) -> DataFrame:
        known = components(edges).select(F.col("id").alias("cls"), F.col("component_id").alias("_label"))
        return hot.drop("_c", "_part", "_label").join(known, "cls", "left").withColumn("_label", F.coalesce("_label", "cls"))

    def pieces_of(labels: DataFrame) -> DataFrame:
        """The tiles that are in several pieces, with their rows' number."""
        found = labels.groupBy(*keys).agg(F.count("*").alias("_m"), F.min("_label").alias("_low"), F.max("_label").alias("_high"))
        return written(found.where("_low <> _high").select(*keys, "_m"), "pieces")

    labels = written(labelled(one), "labels")
    broken = labels.join(pieces_of(labels).select(*keys), keys, "left_semi")
    first = broken.groupBy(*keys, "_label").agg(F.min("cls").alias("cls"))
    anchors = broken.join(first.select(*keys, "cls"), [*keys, "cls"], "left_semi")
    two = met(_dealt(anchors, anchors.groupBy(*keys).agg(F.count("*").alias("_m")), keys, chunk, "cls"))
    drop_written(labels)
    labels = written(labelled(one.unionByName(two)), "labels")
    rest = pieces_of(labels)
    found = one.unionByName(two)
    if rest.count():
        found = found.unionByName(met(_dealt(labels, rest, keys, chunk, "cls")))
    for t in (hot, labels):
        drop_written(t)
    return written(found, "forest")


def _forest(percent: int, compare, upper):
    """For one tile: joins rows that may be linked; compare(i, js) says which. upper: rows of the band above, not compared with each other."""

    def run(ids, n, part, label):
        order = np.lexsort((ids, n))
        size, high = n[order], (n[order] * 100) // percent
        two, out = len(np.unique(part)) > 1, []
        root = np.unique(label[order], return_inverse=True)[1]
        for a in range(len(order) - 1):
            js = np.arange(a + 1, int(np.searchsorted(size, high[a], side="right")))
            if upper is not None and len(js) and upper[order[a]]:
                js = js[~upper[order[js]]]
            if two and len(js):
                js = js[part[order[js]] != part[order[a]]]
            if len(js):
                js = js[root[js] != root[a]]
            if not len(js):
                continue
            for j in js[compare(order[a], order[js])].tolist():
                if root[a] != root[j]:
                    out.append((int(ids[order[a]]), int(ids[order[j]])))
                    root[root == root[j]] = root[a]
        return out

    return run


def _edges(pairs: list) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _may_link(percent: int):
    def batches(found):
        for (_, band, _), t in groups(found, 3):
            if t.num_rows < 2:
                continue
            n = t["n"].to_numpy()
            bits = np.stack([fold(np.frombuffer(x, np.uint64), width_of(band)) for x in t["bits"].to_pylist()])

            def compare(i, js, bits=bits, n=n):
                differ = np.bitwise_count(bits[js] ^ bits[i]).sum(1, dtype=np.int64)
                return enough((n[js] + n[i] - differ) // 2, n[js] + n[i], percent)

            pairs = _forest(percent, compare, t["band"].to_numpy() > band)(t["cls"].to_numpy(), n, t["_part"].to_numpy(), t["_label"].to_numpy())
            if pairs:
                yield _edges(pairs)

    return batches


def _links(percent: int):
    def batches(found):
        for _, t in groups(found, 2):
            if t.num_rows < 2:
                continue
            arrays = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            n = np.array([len(x) for x in arrays])
            width = width_of(band_of(int(np.median(n))))
            bits = np.stack([bitmap(x, width) for x in arrays])

            def compare(i, js, bits=bits, n=n, arrays=arrays):
                differ = np.bitwise_count(bits[js] ^ bits[i]).sum(1, dtype=np.int64)
                ok = enough((n[js] + n[i] - differ) // 2, n[js] + n[i], percent)
                mine = arrays[i]
                for x in np.flatnonzero(ok).tolist():
                    other = arrays[js[x]]
                    at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                    ok[x] = enough(int((mine[at] == other).sum()), n[i] + n[js[x]], percent)
                return ok

            pairs = _forest(percent, compare, None)(t["cls"].to_numpy(), n, t["_part"].to_numpy(), t["_label"].to_numpy())
            if pairs:
                yield _edges(pairs)

    return batches


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id_col, n_shingles, class_id, component_id.

    class_id is the smallest id with the same set, component_id the smallest one that
    links reach. Texts that are null or without words have n_shingles 0, link with
    nothing, and are their own class and component. Rows that share an id are one
    document as far as links go. Rows with a null id keep their n_shingles; they have
    no class or component of their own but those of other rows with their set, if any.
    An empty table gives an empty result; ids are whole numbers; other columns are ignored.
    """
    base = written(profile(docs, id_col, text_col, k, percent), "shingled")
    total = base.count()
    full = base.where("n > 0")
    classes = full.groupBy("h1", "h2").agg(F.min("_id").alias("rep"), F.count("*").alias("_copies"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    picked = classes.where("rep is not null")
    reps = written(
        full.where("_id is not null").join(picked.select("h1", "h2", F.col("rep").alias("_id"), "cls"), ["h1", "h2", "_id"])
        .groupBy("cls").agg(F.first("_id").alias("rep"), F.first("h1").alias("h1"), F.first("n").alias("n"), F.first("band").alias("band"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")), "reps")

    tokens = reps.select(F.explode("prefix").alias("token"), "cls", "band")
    shared = written(tokens.repartition("token").sortWithinPartitions("token").mapInArrow(_repeated, "token long, cls long, band int"), "shared")
    both = F.array(F.struct(F.col("band").alias("tile"), F.lit(1).alias("own")), F.struct((F.col("band") - 1).alias("tile"), F.lit(0).alias("own")))
    tiles = shared.select("token", "cls", F.explode(both).alias("t")).select("token", "cls", "t.*")
    per = ["token", "tile"]
    here = tiles.groupBy(*per).agg(F.count("*").alias("_m"), F.sum("own").alias("_own")).where("_m > 1 and _own > 0").select(*per)
    meeting = tiles.join(here, per, "left_semi").join(reps.select("cls", "n", "band", "bits"), "cls")
    near = _meet(meeting.select(*per, "cls", "n", "band", "bits"), per, CHUNK, _may_link(percent))
    grouped = written(components(near), "near")
    drop_written(shared)

    wanted = grouped.select(F.col("id").alias("cls"), F.col("component_id").alias("grp")).join(reps.select("cls", "rep", "h1"), "cls")
    texts = docs.select(whole_ids(docs, id_col).alias("rep"), F.col(text_col).alias("_text")).join(wanted, "rep")

    def again(found):
        for b in sliced(found):
            sets = [shingles(x.as_py(), k) for x in b.column(3)]
            same = [int(np.array([xxhash.xxh3_128_intdigest(s.tobytes()) & (1 << 64) - 1], np.uint64).view(np.int64)[0]) == h for s, h in zip(sets, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], names=["grp", "cls", "shingles"]).filter(pa.array(same, pa.bool_()))

    # rows that repeat an id with the same set are one member
    sets = written(texts.select("grp", "cls", "h1", "_text").mapInArrow(again, "grp long, cls long, shingles binary").groupBy("grp", "cls").agg(F.first("shingles").alias("shingles")), "sets")
    exact = _meet(sets, ["grp"], CHUNK // 2, _links(percent)).join(reps.select(F.col("cls").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("cls").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    # an id whose rows differ in text stands in several classes, and so connects them
    known = full.where("_id is not null").select("_id", "h1", "h2").distinct()
    several = known.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    bridges = known.join(several, "_id", "left_semi").join(classes, ["h1", "h2"]).select(F.col("_id").alias("a"), F.col("rep").alias("b"))
    linked = components(exact.unionByName(bridges))

    of_class = classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.col("rep").alias("class_id"), F.coalesce("component_id", "rep").alias("component_id"), "_copies")
    rows = spread_join(base.where("n > 0").select("_id", "n", "h1", "h2"), of_class, ["h1", "h2"], "_copies", total).select("_id", "n", "class_id", "component_id")
    empty = base.where("n = 0").select("_id", "n", F.col("_id").alias("class_id"), F.col("_id").alias("component_id"))
    return rows.unionByName(empty).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id")


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
