"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can end its encoding: the token
that is compatible with the last token of what precedes it, where two tokens are
compatible if byte-pair merging of their joined bytes gives these two back. So one
array, the last token of each prefix, holds the encodings of all prefixes at once.
Appending bytes only extends the array; after an edit it is computed anew from the
edit up to where it agrees again with the old one over the longest token's length.

Texts are cut by the pre-tokenizer's pattern, and each piece is encoded on its own.
A space after a character that is not white space always begins a piece, so texts
are first cut there and the chunks' results are kept in a bounded table per worker.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces

#: Chunks whose encodings a worker keeps; a full table gives way to a new one, but keeps what is in use.
KEPT = 250_000
_SPACE_AFTER_SPACE = re.compile(r"\s ")
_SAFE_CUT = re.compile(r"(?<=\S) ")


class Vocabulary:
    """Ranks of byte strings, and the test of neighbours' compatibility."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, self.ranks))
        self.lengths = [len(self.bytes_of.get(t, b"")) for t in range(max(self.bytes_of) + 1)]
        self.names = list(map(str, range(len(self.lengths))))
        #: finds the tokens that end at each place, longest first
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for data, token in self.ranks.items():
            self.automaton.add_word(data.decode("latin-1"), token)
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._joins: dict[tuple[int, int], int] = {}
        self._halves: list[tuple[int, int]] = []
        self._learn_halves()

    def _learn_halves(self) -> None:
        """For each token the two tokens that merging joins last to make it; single bytes have themselves."""
        size = max(self.bytes_of) + 1
        self._halves = [(t, t) for t in range(size)]
        for data, token in sorted(self.ranks.items(), key=lambda x: x[1]):
            for cut in range(1, len(data)):
                left, right = self.ranks.get(data[:cut], size), self.ranks.get(data[cut:], size)
                if left < token and right < token and self._apart(left, right):
                    self._halves[token], self._joins[left, right] = (left, right), token
                    break

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives them back.

        Undoes merges at the common border, the latest first. If the two tokens that then
        meet there can be joined by an earlier merge than the one undone, merging would
        have crossed the border.
        """
        joins, halves, undone = self._joins, self._halves, 1 << 60
        while True:
            if joins.get((left, right), 1 << 60) < undone:
                return False
            inner_left, inner_right = halves[left][1], halves[right][0]
            if left > right and inner_left != left or inner_right == right:
                if inner_left == left:
                    return True
                undone, left = left, inner_left
            else:  # of equal ranks the right one counts as later: merging takes the leftmost first
                undone, right = right + 1, inner_right

    def merged(self, data: bytes) -> list[bytes]:
        """Plain byte-pair merging, lowest rank first, leftmost first: slow, for tests."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
            rank, i = min(found)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= 500_000:
                self._fits.clear()
            known = self._fits[key] = self._apart(left, right)
        return known


    @functools.cached_property
    def endings(self) -> dict[bytes, int]:
        """Every ending of a token, with its own rank or -1: what isn't here need not be lengthened."""
        return {t[i:]: -1 for t in self.ranks for i in range(len(t))} | self.ranks

    def last_tokens(self, data: bytes) -> list[int]:
        """The last token of every prefix of a whole byte string, in one pass of the automaton."""
        last, done = [], 0
        known, lengths = self._fits.get, self.lengths
        for at, token in self.automaton.iter(data.decode("latin-1")):
            if at < done:
                continue
            if at > done:
                break
            start = at + 1 - lengths[token]
            if start:
                left = last[start - 1]
                if not ((ok := known(left << 32 | token)) or ok is None and self.fits(left, token)):
                    continue
            last.append(token)
            done += 1
        if done < len(data):
            raise ValueError(f"no token ends at byte {done + 1}: the vocabulary lacks a byte of {data[: done + 1][-8:]!r}")
        return last

    def encode(self, data: bytes) -> list[int]:
        """The ids of a byte string: the last tokens, followed from its end to its start."""
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        last, at, out = self.last_tokens(data), len(data), []
        while at:
            token = last[at - 1]
            out.append(token)
            at -= self.lengths[token]
        out.reverse()
        return out


class Prefixes:
    """The last token of every prefix of a growing, editable byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Appends to last the tokens that end at its next positions, up to stop."""
        get, known, fits = self.v.endings.get, self.v._fits.get, self.v.fits
        for end in range(len(last) + 1, stop + 1):
            found, at = [], end - 1
            while at >= 0 and (token := get(data[at:end])) is not None:
                if token >= 0:
                    found.append((at, token))
                at -= 1
            for at, token in reversed(found):
                if not at:
                    break
                left = last[at - 1]
                if (ok := known(left << 32 | token)) or ok is None and fits(left, token):
                    break
            else:
                raise ValueError(f"no token ends at byte {end}: the vocabulary lacks a byte of {data[:end][-8:]!r}")
            last.append(token)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(self.data, self.last, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replaces bytes start to stop; returns how many prefixes were computed anew."""
        old, data = self.last, self.data[:start] + new + self.data[stop:]
        last, shift, agree, end = old[:start], len(new) - (stop - start), 0, start
        while end < len(data):
            end += 1
            self._extend(data, last, end)
            same = end > start + len(new) and last[-1] == old[end - 1 - shift]
            agree = agree + 1 if same else 0
            if agree >= self.v.longest:
                last += old[end - shift :]
                break
        self.data, self.last = data, last
        return end - start

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first end bytes (default: of all)."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.v.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Whole texts to ids, a batch at a time, by chunks that begin at a safe space."""

    def __init__(self, path: str, pattern: str):
        self.v = Vocabulary(path, pattern)
        #: by the chunk without its space, and by the chunk for those that begin a text
        self.kept: dict[str, tuple[str, bytes]] = {}
        self.firsts: dict[str, tuple[str, bytes]] = {}

    def cut(self, text: str) -> list[str]:
        """A chunk and, with their leading spaces left out, those after it."""
        return _SAFE_CUT.split(text) if text[:1] == " " or _SPACE_AFTER_SPACE.search(text) else text.split(" ")

    def split(self, chunk: str) -> list[bytes]:
        if chunk[:1] == " " and chunk.isascii():
            if chunk[1:].isalpha():
                return [chunk.encode()]
            if chunk[1:-1].isalpha() and chunk[-1] in ".,":
                return [chunk[:-1].encode(), chunk[-1].encode()]
        return [piece.encode("utf-8", "replace") for piece in self.v.pattern.findall(chunk)]

    def decode(self, ids) -> bytes:
        return b"".join([self.v.bytes_of[i] for i in ids])

    def learn(self, kept: dict, chunks: set[str], lead: str) -> dict:
        """Encodes the chunks that aren't kept yet; a full table keeps only what these use."""
        if len(kept) > KEPT:
            kept = {c: kept[c] for c in chunks if c in kept}
        encode, names = self.v.encode, self.v.names
        for chunk in chunks.difference(kept):
            found = self.split(lead + chunk)
            ids = encode(found[0]) if len(found) == 1 else [i for piece in found for i in encode(piece)]
            kept[chunk] = " ".join([names[i] for i in ids]), self.decode(ids)
        return kept

    def texts(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids, joined by spaces, and the bytes that they decode to."""
        cut = [self.cut(text) for text in texts]
        self.firsts = self.learn(self.firsts, {chunks[0] for chunks in cut}, "")
        self.kept = self.learn(self.kept, set().union(*(chunks[1:] for chunks in cut)), " ")
        out = []
        for chunks in cut:
            got = [self.firsts[chunks[0]], *map(self.kept.__getitem__, chunks[1:])]
            out.append((" ".join([x[0] for x in got]), b"".join([x[1] for x in got])))
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per input row: id_col, n_tokens, ids_sha256, decoded_sha256, and ids (array) if asked for.

    path is a file of ranks, present on every machine. Null and empty texts have no
    tokens. Texts are never cut short; each row is independent, so repeated rows and
    null ids give a row each. Other columns are ignored. Rows are handled one batch at
    a time without any shuffle.
    """

    def batches(found):
        enc = encoder(path, pattern)
        for b in found:
            n, sha, back, lists = [], [], [], []
            for joined, data in (x for run in pieces((text.as_py() or "" for text in b.column(1)), 1_500_000) for x in enc.texts(run)):
                n.append(joined.count(" ") + 1 if joined else 0)
                sha.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(data).hexdigest())
                if ids:
                    lists.append([int(x) for x in joined.split()])
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols, names = [*cols, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        batches, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    )


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
