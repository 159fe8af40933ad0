"""Removal of bytes that repeat: every byte covered by a string of a given length that also starts earlier in the corpus.

Suffixes are sorted where strings can be equal, and only there:

1. Each window of `length` bytes names an anchor, the place of its smallest hash of 32 bytes (the leftmost). Equal windows
   name equal places, so windows are compared only with windows whose anchors have the same hash. Neighbouring windows share an
   anchor; a run of them with the bytes that they cover is one row, about one for 35 bytes of text.
2. Rows of one hash and equal bytes: all but the first are repeats with all their windows. Equal rows are told apart in
   their own batch first, so however often a passage stands in the corpus, it sends one row a batch.
3. Where rows of one hash differ, their bytes are fetched, and the suffixes that start at the anchors, and those that run back
   from them, are sorted deep-shallow: multikey quicksort over words of eight bytes to a shallow depth, blind tries for groups
   that agree so far. The lengths of common prefixes then say which windows are equal. Hashes with many different rows
   (a passage in a third of all documents ends differently in each) are spread by the digests of their windows instead.
4. The windows found are merged to spans, document by document.

Hashes of 64 bits choose what is compared in step 3, which compares bytes. Step 2 takes rows as equal by 128 bits of hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, table, written
from .shingles import mix

LENGTH, GRAM, SHALLOW = 100, 32, 32
#: Bytes worked on at a time; anchors are numbered within them.
PIECE, PLACE = 1 << 21, 28
#: Documents without an id come after all others.
LAST_ID = (1 << 63) - 1
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes (a power of two) at each place, by doubling."""
    h, n, base = _BYTES[data], 1, _BASE
    while n < k:
        h = h[: len(h) - n] * np.uint64(base) + h[n:]
        n, base = 2 * n, base * base % (1 << 64)
    return mix(h)


def anchor_runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: (start, windows, anchor - start, hash). ends: where each document in data ends; no window crosses one."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64)
    h = gram_hashes(data, GRAM)
    low = np.uint64((1 << PLACE) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, wanted = 1, length - GRAM + 1
    while width < wanted:
        step = min(width, wanted - width)
        v = np.minimum(v[: len(v) - step], v[step:])
        width += step
    at = np.arange(len(v))
    inside = at + length <= ends[np.searchsorted(ends, at, side="right")]
    first = inside.copy()
    first[1:] &= (v[1:] != v[:-1]) | ~inside[:-1]
    start = np.flatnonzero(first)
    count = np.diff(np.append(np.searchsorted(np.flatnonzero(inside), start), inside.sum()))
    anchor = (v[start] & low).astype(np.int64)
    return start, count, anchor - start, h[anchor]


def first_of_equals(key: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray, shape: np.ndarray):
    """The rows without those that are there twice, in order of (key, c, doc, at), and which of them repeat an earlier one's key and c."""
    o = np.lexsort((at, doc, c, key))
    key, c, doc, at, shape = key[o], c[o], doc[o], at[o], shape[o]
    same = np.zeros(len(o), bool)
    same[1:] = (key[1:] == key[:-1]) & (c[1:] == c[:-1])
    twice = same.copy()
    twice[1:] &= (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
    return tuple(x[~twice] for x in (key, c, doc, at, shape, same))


_ROWS = "key long, c long, doc long, at long, shape int, again boolean"


def merged_repeats(key, c, doc, at, shape, again):
    """The rows with windows that repeat and follow each other in a document as one row, its number of windows in shape; other rows stay."""
    o = np.flatnonzero(again)[np.lexsort((at[again], doc[again]))]
    start = np.ones(len(o), bool)
    start[1:] = (np.diff(doc[o]) != 0) | (np.diff(at[o]) != 1 << 32)
    size = np.diff(np.append(np.flatnonzero(start), len(o)))
    kept = np.concatenate([np.flatnonzero(~again), o[start]])
    shape = np.concatenate([shape[~again], size])
    return key[kept], c[kept], doc[kept], at[kept], shape, again[kept]


def _batch(key, c, doc, at, shape, merge: bool = False):
    import pyarrow as pa

    rows = first_of_equals(key, c, doc, at, shape)
    key, c, doc, at, shape, again = merged_repeats(*rows) if merge else rows
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, c, doc, at, shape.astype(np.int32), again)], ["key", "c", "doc", "at", "shape", "again"])


def _runs(length: int, most_bytes: int):
    """(doc, bytes) -> rows of runs: hash, digest of the bytes covered, document, start and text's crc32, windows and place of the anchor."""
    import xxhash

    def each(batches: Iterator) -> Iterator:
        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            piece: list[tuple[int, int, int, bytes]] = []

            def work(piece=piece, held=held):
                if not piece:
                    return
                whole = b"".join(p[3] for p in piece)
                sizes = np.array([len(p[3]) for p in piece])
                ends = np.cumsum(sizes)
                start, count, lead, h = anchor_runs(np.frombuffer(whole, np.uint8), ends, length)
                which = np.searchsorted(ends, start, side="right")
                view = memoryview(whole)
                c = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)), np.uint64, len(start))
                doc, base, crc = (np.array([p[i] for p in piece], np.int64)[which] for i in range(3))
                at = ((base + start - (ends - sizes)[which]) << 32) | crc
                held.append((h.view(np.int64), c.view(np.int64), doc, at, (lead << 16) | count))
                piece.clear()

            size = 0
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = raw.as_py()
                crc = zlib.crc32(text)
                for base in range(0, len(text) - length + 1, most_bytes):
                    piece.append((doc, base, crc, text[base : base + most_bytes + length - 1]))
                    size += len(piece[-1][3])
                    if size >= most_bytes:
                        work()
                        size = 0
            work()
            if held:
                yield _batch(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return each


def _settled(rows: DataFrame, contests: bool) -> DataFrame:
    """Of rows as _ROWS: (doc, at, shape, key, repeat) of those that repeat an earlier row's key and c, and, with contests, of
    the first of each c where a key has several. Rows known to repeat are dealt by their own place, as they ask nothing."""
    rows = rows.withColumn("key", F.when(F.col("again"), F.xxhash64("doc", "at")).otherwise(F.col("key")))
    w = Window.partitionBy("key", "again").orderBy("c", "doc", "at")
    was = F.col("_c") == F.col("c")
    out = rows.withColumns({f"_{x}": F.lag(x).over(w) for x in ("c", "doc", "at")})
    twice = was & (F.col("_doc") == F.col("doc")) & (F.col("_at") == F.col("at"))
    state = F.when(F.col("again"), 1).when(twice, 0).when(was, 1)
    if contests:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumns({"_low": F.first("c").over(whole), "_high": F.last("c").over(whole)})
        state = state.when(F.col("_low") != F.col("_high"), 2)
    return out.withColumn("state", F.coalesce(state, F.lit(0))).where("state > 0").select("doc", "at", "shape", "key", "again", (F.col("state") == 1).alias("repeat"))


def common_length(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def blind_trie(strings: list[bytes], ids: list[int]) -> list[int]:
    """ids in the order of their strings. Inner nodes hold a length and children by the byte that follows (-1: the end): a string
    goes down by these bytes alone, is compared once with the leaf that it meets, and branches off where they part."""
    root: list = [-1, [ids[0]]]  # a leaf: -1 and the ids of equal strings; an inner node: length and children
    for new in ids[1:]:
        s = strings[new]
        node = root
        while node[0] >= 0:
            node = node[1].get(s[node[0]] if len(s) > node[0] else -1) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        n = common_length(s, other)
        if n == len(s) == len(other):
            node[1].append(new)
            continue
        parent, node = None, root
        while 0 <= node[0] < n:
            parent, node = node, node[1][s[node[0]]]
        mine = s[n] if len(s) > n else -1
        if node[0] == n:
            node[1][mine] = [-1, [new]]
            continue
        branch = [n, {other[n] if len(other) > n else -1: node, mine: [-1, [new]]}]
        if parent is None:
            root = branch
        else:
            parent[1][s[parent[0]]] = branch
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings, and the length of the common prefix of each with the one before it in that order (0 for the first)."""
    if not strings:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = -(-shallow // 8)
    words = np.frombuffer(b"".join(s[: 8 * size].ljust(8 * size, b"\0") for s in strings), ">u8").reshape(-1, size).astype(np.uint64)
    order: list[int] = []
    stack = [(np.arange(len(strings)), 0)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) == 1:
            order.append(int(ids[0]))
        elif depth == size:
            order += blind_trie(strings, ids.tolist())
        else:
            column = words[ids, depth]
            some = np.sort(column[:: max(1, len(column) // 9)])
            pivot = some[len(some) // 2]
            below, above = column < pivot, column > pivot
            for part, to in ((ids[above], depth), (ids[~(below | above)], depth + 1), (ids[below], depth)):
                if len(part):
                    stack.append((part, to))
    shared = [common_length(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]
    return np.array(order), np.array([0, *shared])


def equal_windows(contexts: list[bytes], lead: np.ndarray, count: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether each window starts earlier elsewhere among these rows: rows x windows, true where the window that starts at
    the row's start + k is equal to one of an earlier document, or of an earlier start. Anchors are lead bytes after a row's start."""
    n = len(contexts)
    right, right_shared = deep_shallow([c[k:] for c, k in zip(contexts, lead.tolist(), strict=True)])
    left, left_shared = deep_shallow([c[:k][::-1] for c, k in zip(contexts, lead.tolist(), strict=True)])
    anchor = at + (lead << 32)  # the order of windows that start equally far before their anchors
    turn = np.empty(n, np.int64)
    turn[np.lexsort((anchor, doc))] = np.arange(n)
    found = np.zeros((n, length - GRAM + 1), bool)
    r, l = np.empty(n, np.int64), np.empty(n, np.int64)  # noqa: E741
    for back in range(int(lead.max(initial=0)) + 1):
        rows = np.flatnonzero((lead >= back) & (lead - count < back))
        if len(rows) < 2:
            continue
        r[right] = np.cumsum(right_shared < length - back)
        l[left] = np.cumsum(left_shared < back)
        key = r[rows] * (n + 1) + l[rows]
        o = np.lexsort((turn[rows], key))
        later = rows[o[1:][key[o[1:]] == key[o[:-1]]]]
        found[later, lead[later] - back] = True
    return found


_SPANS = "doc long, crc long, start long, windows int"


def _spans(doc, at, found: np.ndarray):
    """Arrow rows (doc, crc, start, windows) of the runs of windows found."""
    import pyarrow as pa

    edge = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
    (row, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(at[row] & 0xFFFFFFFF), pa.array((at[row] >> 32) + begin), pa.array((end - begin).astype(np.int32))], ["doc", "crc", "start", "windows"])


def _sorted_classes(length: int, rows_at_once: int):
    """Rows (key, doc, at, shape, bytes) in order of key -> spans; whole keys, some thousand rows together."""
    import pyarrow as pa

    def solve(t):
        key, doc, at, shape = (t.column(i).to_numpy() for i in range(4))
        o = np.lexsort((at, doc, key))
        once = np.ones(len(o), bool)
        once[1:] = (np.diff(key[o]) != 0) | (np.diff(doc[o]) != 0) | (np.diff(at[o]) != 0)
        o = o[once]
        contexts = t.column(4).to_pylist()
        doc, at, shape = doc[o], at[o], shape[o].astype(np.int64)
        return _spans(doc, at, equal_windows([contexts[i] for i in o.tolist()], shape >> 16, shape & 0xFFFF, doc, at, length))

    def each(batches: Iterator) -> Iterator:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows > rows_at_once:
                key = held.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[rows_at_once], side="left")) or int(np.searchsorted(key, key[rows_at_once], side="right"))
                if cut == held.num_rows:
                    break
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held)

    return each


def _windows(length: int):
    """Rows (key, doc, at, shape, bytes) -> a row for each window, keyed by its digest; what a batch itself shows to repeat is one row a span."""
    import xxhash

    def each(batches: Iterator) -> Iterator:
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                rows = batch.slice(part, 4096)
                digests, doc, at = bytearray(), [], []
                for d, a, shape, context in zip(*(rows.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                    for k in range(shape & 0xFFFF):
                        digests += xxhash.xxh3_128_digest(context[k : k + length])
                        doc.append(d)
                        at.append(a + (k << 32))
                pairs = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
                yield _batch(pairs[:, 0], pairs[:, 1], np.array(doc, np.int64), np.array(at, np.int64), np.ones(len(doc), np.int64), merge=True)

    return each


def _fetched(length: int):
    """(doc, bytes, rows) -> the bytes that each row covers."""
    import pyarrow as pa

    names = ["key", "doc", "at", "shape", "context", "many"]

    def each(batches: Iterator) -> Iterator:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size, seen = 0, set()
            for doc, crc, raw, rows in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), batch.column(3), strict=True):
                if (doc, crc) in seen:
                    continue
                seen.add((doc, crc))
                text = raw.as_py()
                for row in rows.as_py():
                    start = row["at"] >> 32
                    context = text[start : start + (row["shape"] & 0xFFFF) + length - 1]
                    for column, value in zip(out, (row["key"], doc, row["at"], row["shape"], context, row["many"]), strict=True):
                        column.append(value)
                    size += len(context)
                if size > PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
                    out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
    return each


def repeated(docs: DataFrame, length: int = LENGTH, most: int = 64, piece: int = PIECE) -> DataFrame:
    """Spans of windows (doc, crc, start, windows) that start earlier elsewhere; docs: (doc, crc, raw), see clean. A hash with more than `most` different rows is spread by its windows."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} bytes or more")
    each = _settled(docs.select("doc", "raw").mapInArrow(_runs(length, piece), _ROWS), contests=True)
    many = F.sum(F.when(~F.col("repeat"), 1).otherwise(0)).over(Window.partitionBy("key", "again")) > most
    settled = written(each.withColumn("many", many), "runs")
    crc, start = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("at", 32)
    whole = settled.where("repeat").select("doc", crc.alias("crc"), start.alias("start"), F.col("shape").bitwiseAND(F.lit(0xFFFF)).alias("windows"))
    asked = settled.where("not repeat").groupBy("doc", crc.alias("crc")).agg(F.collect_list(F.struct("key", "at", "shape", "many")).alias("rows"))
    contexts = written(
        docs.join(asked.hint("shuffle_hash"), ["doc", "crc"]).select("doc", "crc", "raw", "rows").mapInArrow(_fetched(length), "key long, doc long, at long, shape int, context binary, many boolean"), "contexts"
    )
    few = contexts.where("not many").drop("many").repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_classes(length, 4096), _SPANS)
    spread = _settled(contexts.where("many").drop("many").mapInArrow(_windows(length), _ROWS), contests=False)
    found = written(whole.unionByName(few).unionByName(spread.select("doc", crc.alias("crc"), start.alias("start"), F.col("shape").alias("windows"))), "spans")
    drop_written(settled)
    drop_written(contexts)
    return found


def _cut(length: int):
    """(id, bytes, spans of windows) -> (id, number of bytes, removed spans, kept bytes)."""
    import pyarrow as pa

    def each(batches: Iterator) -> Iterator:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256)
                sizes, removed, kept = [], [], []
                for raw, spans in zip(rows.column(1), rows.column(2), strict=True):
                    text, merged = raw.as_py(), []
                    for s in sorted((x["start"], x["windows"]) for x in spans.as_py() or ()):
                        begin, end = s[0], s[0] + s[1] + length - 1
                        if merged and begin <= merged[-1][1]:
                            merged[-1][1] = max(end, merged[-1][1])
                        else:
                            merged.append([begin, end])
                    edges = [0, *(e for m in merged for e in m), len(text)]
                    sizes.append(len(text))
                    removed.append([{"start": b, "end": e} for b, e in merged])
                    kept.append(b"".join(text[b:e] for b, e in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(removed, kinds), pa.array(kept, pa.binary())], ["_id", "n_bytes", "spans", "kept"])

    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return each


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int = 64, piece: int = PIECE) -> DataFrame:
    """One row per row of docs: id_col (a long), n_bytes, spans (removed, as bytes from start up to end), kept (bytes).

    A byte goes if a string of `length` bytes that covers it also starts earlier: under a smaller id, or under the same id
    at an earlier place. Null texts are empty; texts shorter than length keep all. Rows of one id and text are one document, each with
    the same result; different texts under one id have one order of starts, ties by the crc32 of the text, which also tells such texts
    apart. Longer texts are worked on in pieces of `piece` bytes that overlap. Rows without an id come after all others. Other columns are ignored; an empty table gives no rows.
    """
    from .common import whole_ids

    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(whole_ids(docs, id_col).alias("_id"), raw.alias("raw")).select("_id", F.coalesce("_id", F.lit(LAST_ID)).alias("doc"), F.crc32("raw").alias("crc"), "raw")
    spans = repeated(rows, length, most, piece).groupBy("doc", "crc").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    schema = "_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    cut = rows.join(spans.hint("shuffle_hash"), ["doc", "crc"], "left").select("_id", "raw", "spans").mapInArrow(_cut(length), schema)
    return cut.withColumnRenamed("_id", id_col)


def op13_suffixes(spark, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0))
    return clean(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
