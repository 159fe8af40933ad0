"""Token ids of documents in sorted-string-table shards, written, read back and looked up.

A shard holds the documents of one range of identifiers in ascending order:

    block*   entries (shared key bytes, own key bytes, value length as varints, own key
             bytes, value), every 16th with its whole key; then the offsets of these
             restarts as u4, their number as u4; compressed by zstd
    index    per block: last key (length as u2), offset u8, length u4, documents u4, tokens u8
    bloom    bits, seven probes for each key
    footer   offset and length of index and bloom u8, documents u8, tokens u8,
             bytes of an id u4, magic b"TLSST1"

A key is a marker byte (0: null, 1: a number) and the number as 8 big-endian bytes with
its sign bit turned, so that keys sort as the numbers do. The value is the ids, two
or four little-endian bytes each. A lookup asks the bloom filter, then searches the
index, then the block's restarts, by halves.

Shards are written by the tasks of one range-partitioned job to a folder that all
machines share; each attempt writes its own file and renames it when it is whole, so a
lost executor's task may run again.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, shared_dir, whole_ids, written

MAGIC = b"TLSST1"
_FOOTER = struct.Struct("<QQQQQQI6s")
_BLOCK = struct.Struct("<QIIQ")
RESTART, BLOCK_BYTES, PROBES, BITS_PER_KEY = 16, 1 << 16, 7, 10


def key_of(doc_id) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes):
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Entries in ascending key order to one file; memory: a block, the index and the filter's hashes."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes, self.at = out, id_bytes, 0
        self.index, self.hashes = bytearray(), []
        self.docs = self.tokens = 0
        self._start()

    def _start(self):
        self.block, self.restarts, self.n, self.block_tokens, self.prev = bytearray(), [], 0, 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
            same = 0
        else:
            same = 0
            while same < min(len(key), len(self.prev)) and key[same] == self.prev[same]:
                same += 1
        self.block += _varint(same) + _varint(len(key) - same) + _varint(len(value)) + key[same:] + value
        self.prev, self.n = key, self.n + 1
        self.block_tokens += len(value) // self.id_bytes
        if not self.hashes or self.hashes[-1] != key:
            self.hashes.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if not self.n:
            return
        tail = np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
        data = zstandard.ZstdCompressor(level=1).compress(bytes(self.block) + tail)
        self.index += struct.pack("<H", len(self.prev)) + self.prev + _BLOCK.pack(self.at, len(data), self.n, self.block_tokens)
        self._write(data)
        self.docs, self.tokens = self.docs + self.n, self.tokens + self.block_tokens
        self._start()

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.hashes) * BITS_PER_KEY)
        filter_ = np.zeros(bits, np.uint8)
        for key in self.hashes:
            filter_[_probes(key, bits)] = 1
        index_at = self.at
        self._write(bytes(self.index))
        bloom_at, bloom = self.at, struct.pack("<Q", bits) + np.packbits(filter_, bitorder="little").tobytes()
        self._write(bloom)
        self._write(_FOOTER.pack(index_at, len(self.index), bloom_at, len(bloom), self.docs, self.tokens, self.id_bytes, MAGIC))
        self.out.close()


class Reader:
    """One shard: get(id) by halves, blocks() in order. Reads the footer and index at once, blocks as needed."""

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - _FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.docs, self.tokens, self.id_bytes, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(index_at)
        data, at = file.read(index_len), 0
        self.last_keys, self.blocks_at = [], []
        while at < len(data):
            (n,) = struct.unpack_from("<H", data, at)
            self.last_keys.append(data[at + 2 : at + 2 + n])
            self.blocks_at.append(_BLOCK.unpack_from(data, at + 2 + n))
            at += 2 + n + _BLOCK.size
        self._bloom_at, self._bloom_len, self._bloom = bloom_at, bloom_len, None

    def may_have(self, key: bytes) -> bool:
        if self._bloom is None:
            self.file.seek(self._bloom_at)
            data = self.file.read(self._bloom_len)
            self._bloom = struct.unpack_from("<Q", data)[0], data[8:]
        bits, data = self._bloom
        return all(data[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits))

    def _block(self, i: int) -> tuple[bytes, np.ndarray]:
        at, size, _, _ = self.blocks_at[i]
        self.file.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.file.read(size))
        n = int(np.frombuffer(data[-4:], "<u4")[0])
        return data, np.frombuffer(data[-4 - 4 * n : -4], "<u4")

    def _entries(self, data: bytes, at: int, stop: int):
        key = b""
        while at < stop:
            same, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:same] + data[at : at + own]
            yield key, data[at + own : at + own + size]
            at += own + size

    def blocks(self):
        for i in range(len(self.blocks_at)):
            data, restarts = self._block(i)
            yield list(self._entries(data, 0, len(data) - 4 - 4 * len(restarts)))

    def get(self, doc_id) -> list[np.ndarray]:
        """The ids of every document with this identifier (none: an empty list)."""
        key, out = key_of(doc_id), []
        if not self.may_have(key):
            return out
        for i in range(bisect.bisect_left(self.last_keys, key), len(self.blocks_at)):
            data, restarts = self._block(i)
            stop = len(data) - 4 - 4 * len(restarts)
            first = bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(data, int(at), stop))[0])
            for k, value in self._entries(data, int(restarts[max(0, first - 1)]), stop):
                if k > key:
                    return out
                if k == key:
                    out.append(np.frombuffer(value, f"<u{self.id_bytes}"))
        return out


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Words:
    """Whole texts to ids by the tokenizers library, through a bounded table of words.

    Texts of ASCII and Latin-1 letters are put in lower case and cut as the tokenizer's own
    pattern cuts them: its normalisation changes nothing else there, and it joins nothing
    across these cuts. Other texts are cut at ASCII white space only, which the tokenizer
    drops and never joins across. Texts that may name a special token are encoded whole.
    Words that are new in a run are encoded together: as one text, whose ids are cut after
    those that end a word.
    """

    #: The tokenizer's pattern on lower-case Latin-1, the letters in lower case, and characters to leave to it.
    PATTERN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\s0-9a-z\xdf-\xf6\xf8-\xff]+")
    LOWER = bytes(b + 32 if 65 <= b <= 90 or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))
    OTHERS = bytes([*range(9), *range(0x0E, 0x20), *range(0x7F, 0xC0), 0xD7, 0xF7])

    def __init__(self, path: str, kept: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        n = self.t.get_vocab_size()
        self.id_bytes = 2 if n <= 1 << 16 else 4
        self.kept, self.table = kept, {}
        self.ends = np.array([(self.t.id_to_token(i) or "").endswith("</w>") for i in range(n)])

    def _packed(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, f"<u{self.id_bytes}").tobytes()

    def learn(self, parts: set) -> None:
        """Adds parts to the table: bytes are single words in Latin-1, texts anything without white space."""
        if len(self.table) + len(parts) > self.kept:
            self.table = {p: self.table[p] for p in parts if p in self.table}
        new = list(parts.difference(self.table))
        plain = [p for p in new if type(p) is bytes]
        for i in range(0, len(plain), 20_000):
            run = plain[i : i + 20_000]
            packed = self._packed(b" ".join(run).decode("latin-1"))
            cuts = np.flatnonzero(self.ends[np.frombuffer(packed, f"<u{self.id_bytes}")]) + 1
            if len(cuts) == len(run):
                cuts = [0, *(cuts * self.id_bytes).tolist()]
                self.table.update(zip(run, map(packed.__getitem__, map(slice, cuts[:-1], cuts[1:])), strict=True))
            else:
                self.table.update((p, self._packed(p.decode("latin-1"))) for p in run)
        self.table.update((p, self._packed(p)) for p in new if type(p) is str)

    def _cut(self, text: str) -> list:
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            data = None
        if data is not None and len(data.translate(None, self.OTHERS)) == len(data):
            return self.PATTERN.findall(data.translate(self.LOWER))
        return [x for x in re.split("[ \t\n\r\x0b\x0c]+", text) if x]

    def texts(self, texts: list[str]) -> list[bytes]:
        texts = [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts]
        cut = [None if "<|" in t else self._cut(t) for t in texts]
        self.learn(set().union(*filter(None, cut)))
        return [self._packed(t) if parts is None else b"".join(map(self.table.__getitem__, parts)) for t, parts in zip(texts, cut, strict=True)]


_WORDS: dict[str, Words] = {}


def words(path: str) -> Words:
    """One per worker process."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encodes every document, appends end_id, and writes shards; returns their manifest, one row per shard.

    Shards follow each other in ascending order of id_col (null first); rows with the
    same identifier stay separate entries, ordered by their texts' hashes, and may
    spread over shards. Null and empty texts hold end_id only. An empty table gives
    an empty manifest. Manifest: shard int, path, docs, tokens, first_id, last_id.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"

    def shard(found):
        w, out, names = words(tokenizer), None, {}
        system, root = open_fs(folder)
        part = TaskContext.get().partitionId()
        temp, name = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}", f"{root}/part-{part:06d}.sst"
        end = np.array([end_id], f"<u{w.id_bytes}").tobytes()
        for b in found:
            ids, at = b.column(0).to_pylist(), 0
            for run in pieces((t.as_py() or "" for t in b.column(1)), 2_000_000):
                for value in w.texts(run):
                    if out is None:
                        system.create_dir(root, recursive=True)
                        out = Writer(system.open_output_stream(temp), w.id_bytes)
                        names["first_id"] = ids[at]
                    out.add(key_of(ids[at]), value + end)
                    names["last_id"], at = ids[at], at + 1
        if out is None:
            return
        out.close()
        if system.get_file_info(name).type != fs.FileType.NotFound:
            system.delete_file(name)
        system.move(temp, name)
        yield pa.RecordBatch.from_pylist(
            [{"shard": part, "path": f"{folder}/part-{part:06d}.sst", "docs": out.docs, "tokens": out.tokens, **names}],
            schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]),
        )

    rows = docs.select(whole_ids(docs, id_col).alias("_id"), F.col(text_col).alias("_text"))
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text").asc()]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(sorted_.mapInArrow(shard, "shard int, path string, docs long, tokens long, first_id long, last_id long"), "manifest")


def read(manifest: DataFrame, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """Documents from their shards: id_col, start, n_tokens, ids_crc32, and ids (array) if asked for.

    start counts the ids of all documents before. Each task streams its shards block by
    block; the only thing that is gathered is one running sum over the manifest.
    """

    def batches(found):
        for b in found:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, name = open_fs(path)
                with system.open_input_file(name) as file:
                    reader = Reader(file)
                    for block in reader.blocks():
                        rows = []
                        for key, value in block:
                            got = np.frombuffer(value, f"<u{reader.id_bytes}")
                            row = {id_col: id_of(key), "start": start, "n_tokens": len(got), "ids_crc32": zlib.crc32(got.astype("<u4").tobytes())}
                            rows.append(row | {"ids": got} if ids else row)
                            start += len(got)
                        schema = [(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(schema + [("ids", pa.list_(pa.int32()))] * ids))

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    n = max(1, manifest.count())
    return starts.repartition(n, "path").mapInArrow(batches, f"{id_col} long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def lookup(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of wanted documents, by binary search in the shards whose range holds them: id_col, ids.

    wanted is any table of identifiers; each is sent to the shards that may hold it and
    looked up there. Identifiers without a document give no row. The driver holds two
    numbers a shard, of which there is one for many MB of documents.
    """
    spark = manifest.sparkSession
    least = -(1 << 63)
    bounds = manifest.orderBy("shard").select("shard", F.col("first_id").isNull().alias("null"), F.coalesce("first_id", F.lit(least)).alias("first"), F.coalesce("last_id", F.lit(least)).alias("last")).toPandas()
    shared = spark.sparkContext.broadcast((bounds["shard"].to_numpy(), bounds["first"].to_numpy(), bounds["last"].to_numpy(), int(bounds["null"].sum())))

    def route(found):
        shards, first, last, nulls = shared.value
        for b in found:
            ids = b.column(0).to_pylist()
            known = np.array([least if i is None else i for i in ids], np.int64)
            begin, end = np.searchsorted(last, known), np.searchsorted(first, known, side="right")
            spans = [range(nulls) if i is None else range(x, y) for i, x, y in zip(ids, begin.tolist(), end.tolist(), strict=True)]
            rows = [(int(shards[k]), i) for i, span in zip(ids, spans, strict=True) for k in span]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([i for _, i in rows], pa.int64())], names=["shard", "_id"])

    def batches(found):
        open_ = {}
        for b in found:
            rows = []
            for path, doc_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path not in open_:
                    if len(open_) >= 16:
                        open_.clear()
                    system, name = open_fs(path)
                    open_[path] = Reader(system.open_input_file(name))
                rows += [{id_col: doc_id, "ids": ids} for ids in open_[path].get(doc_id)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))]))

    asked = wanted.select(whole_ids(wanted, id_col).alias("_id")).mapInArrow(route, "shard int, _id long")
    return asked.join(manifest.select("shard", "path"), "shard").select("path", "_id").repartition("path").sortWithinPartitions("path", "_id").mapInArrow(batches, f"{id_col} long, ids array<int>")


def op5_sstable(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return read(write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))
