"""Toxicity by a subsequence string kernel with Nystroem landmarks and a linear support vector machine.

A word's features are its subsequences of three letters (its beginning counts as a letter),
each weighted by DECAY to the power of the length over which it stretches; the kernel of two
words is the normalised inner product of these. So letters put in between or left out only lower it, in
proportion to the subsequences that they touch. Landmarks are words, or beginnings of words, of the
labelled toxic texts. A text's kernel with a landmark is that of its closest word, words being taken
whole and by their beginnings; a word closer to a clean look-alike (of the labelled clean texts'
words those nearest to a landmark) than to a landmark has no kernel with that landmark. The
landmarks' own kernel matrix to the power -1/2 maps these values to features, on which a
linear machine is trained with the hinge loss; a logistic curve over its margin is the score.

The landmarks' subsequences are a table, so a word's kernels with all landmarks are sums of its
rows; the largest entry of each row bounds them from above. All distinct words of a batch are
bounded by array operations, and only those that can reach FLOOR are compared and kept by.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, pieces, table, written

ORDER, DECAY = 3, 0.75
#: Kernels below this count as nothing.
FLOOR = 0.45
#: Longer words are compared in windows of so many letters, each beginning half a window after the one before.
WINDOW = 24
#: Words are compared by their beginnings of these lengths too.
BEGINNINGS = (5, 7)
_SENTENCE = re.compile(r"[.!?\n]+")
_START, _OTHER = 27, 28
#: By byte: 1 to 26 for a to z, 28 to 63 for other letters; 27 stands for the beginning of a word.
_SYMBOL = np.array([b - 96 if 97 <= b <= 122 else _OTHER + b % 36 for b in range(256)], np.int32)


@cache
def _folds() -> np.ndarray:
    """By code point below 65536: the byte of a letter (its base letter, or itself up to 255, others from 128 to 191), 32 for white space, 0 for what is left out."""
    out = np.zeros(1 << 16, np.uint8)
    for x in range((1 << 16) - 1):
        c = chr(x)
        if c.isspace():
            out[x] = 32
        elif c.isalpha():
            base = ord(unicodedata.normalize("NFKD", c)[0]) if x > 255 else x
            out[x] = base if base < 256 else 128 + x % 64
    return out


def fold(text: str) -> np.ndarray:
    """Bytes of the text's letters in lower case and its white space; digits, marks and punctuation are left out."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = _folds()[np.minimum(x, (1 << 16) - 1)]
    return out[out > 0]


@cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j < k below n, and their weights."""
    at = np.array(list(combinations(range(n), ORDER)), np.int32).reshape(-1, ORDER)
    return at.T.copy(), (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)


def symbols(word: bytes, lead: int = _START) -> np.ndarray:
    return np.append(np.int32(lead), _SYMBOL[np.frombuffer(word[:WINDOW], np.uint8)]).astype(np.int32)


def _codes(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    return s[:, at[0]] << 12 | s[:, at[1]] << 6 | s[:, at[2]]


def norms(s: np.ndarray) -> np.ndarray:
    """The kernels' own values, square roots: rows of symbols of one length."""
    at, weight = _triples(s.shape[1])
    codes = _codes(s, at)
    by = np.argsort(codes, axis=1)
    codes, weight = np.take_along_axis(codes, by, 1), weight[by].astype(np.float64)
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    sums = np.bincount(np.cumsum(first) - 1, weights=weight.ravel())  # of each subsequence of each row
    of = np.nonzero(first)[0]
    return np.sqrt(np.bincount(of, weights=sums**2, minlength=len(s)))


#: By number of symbols, no more than the norm of any word: each subsequence as if no other were the same.
_LEAST = np.array([0.999 * np.sqrt((_triples(n)[1].astype(np.float64) ** 2).sum()) for n in range(WINDOW + 2)])


class Table:
    """The subsequences of fixed words: kernels of any word with all of them are sums of rows."""

    def __init__(self, words: list[bytes]):
        rows = [symbols(w) for w in words]
        self.norms = np.array([norms(r[None])[0] for r in rows])
        codes = [_codes(r[None], _triples(len(r))[0])[0] for r in rows]
        known = np.unique(np.concatenate(codes)) if rows else np.zeros(0, np.int32)
        self.at = np.zeros(1 << 18, np.int32)
        self.at[known] = np.arange(1, len(known) + 1)
        self.rows = np.zeros((len(known) + 1, len(words)), np.float32)
        for j, (r, c) in enumerate(zip(rows, codes, strict=True)):
            np.add.at(self.rows[:, j], self.at[c], _triples(len(r))[1] / self.norms[j])
        self.top = self.rows.max(axis=1, initial=0)
        starts = sorted({w[:2] for w in words})
        self.tops = np.stack([self.rows[:, [j for j, w in enumerate(words) if w[:2] == x]].max(axis=1) for x in starts], axis=1) if words else self.rows

    def bounds(self, s: np.ndarray) -> np.ndarray:
        """No less than any kernel of these rows of symbols, unnormalised on their side."""
        at, weight = _triples(s.shape[1])
        return self.top[self.at[_codes(s, at)]] @ weight

    def reach(self, s: np.ndarray, least: float) -> np.ndarray:
        """The rows whose kernel with a word may be least: bounded first over all words, then over those that begin alike."""
        on = np.flatnonzero(self.bounds(s) >= least)
        return on[self.kernels(s[on], self.tops).max(axis=1, initial=0) >= least]

    def kernels(self, s: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """Rows x words, unnormalised on the rows' side."""
        table = self.rows if table is None else table
        at, weight = _triples(s.shape[1])
        rows = self.at[_codes(s, at)]
        out = np.zeros((len(s), table.shape[1]), np.float32)
        for i in range(0, len(s), 1024):
            of, c = np.nonzero(rows[i : i + 1024])
            if len(of):
                begin = np.flatnonzero(np.diff(of, prepend=-1))
                out[of[begin] + i] = np.add.reduceat(weight[c, None] * table[rows[of + i, c]], begin, axis=0)
        return out


class Landmarks:
    """Kernels with fixed words; results of the words that come near are kept in a bounded table."""

    def __init__(self, words: list[str], clean: list[str] = (), kept: int = 200_000):
        self.words, self.kept, self.found = words, kept, {}
        self.toxic = Table([fold(w).tobytes() for w in words])
        self.clean = Table([fold(w).tobytes() for w in clean]) if len(clean) else None

    def matrix(self) -> np.ndarray:
        rows = [symbols(fold(w).tobytes()) for w in self.words]
        return np.stack([self.toxic.kernels(r[None])[0] / n for r, n in zip(rows, self.toxic.norms, strict=True)]).astype(np.float64)

    def near(self, s: np.ndarray) -> list:
        """For each row of symbols the landmarks that it comes near and its kernels with them, or None."""
        out, k = [None] * len(s), self.toxic.kernels(s)
        on = np.flatnonzero(k.max(axis=1, initial=0) >= FLOOR * _LEAST[s.shape[1]])
        own = norms(s[on])[:, None]
        near = k[on] / own
        near = np.where(near >= FLOOR, np.minimum(near, 1), 0)
        if self.clean is not None and len(on):
            like = (self.clean.kernels(s[on]) / own).max(axis=1, keepdims=True)
            near = np.where(near <= like + 1e-6, 0, near)
        k[on] = near
        for i in on.tolist():
            at = np.flatnonzero(k[i])
            if len(at):
                out[i] = (at, k[i, at])
        return out

    def texts(self, texts: list[str]) -> np.ndarray:
        """For each text the kernel of its closest word with each landmark (texts x landmarks)."""
        out = np.zeros((len(texts), len(self.words)), np.float32)
        if not texts or not self.words:
            return out
        for owners, s in self._words(texts):
            key = np.ascontiguousarray(s.astype(np.uint8))
            if key.shape[1] <= 10:  # six bits a symbol
                packed = np.zeros(len(key), np.uint64)
                for c in range(key.shape[1]):
                    packed = packed << np.uint64(6) | key[:, c]
            else:
                packed = key.view(np.dtype((np.void, key.shape[1]))).ravel()
            _, first, of = np.unique(packed, return_index=True, return_inverse=True)
            least = FLOOR * _LEAST[s.shape[1]]
            hit = np.concatenate([self.toxic.reach(s[first[i : i + 4096]], least) + i for i in range(0, len(first), 4096)])
            if not len(hit):
                continue
            words = [key[i].tobytes() for i in first[hit].tolist()]
            if len(self.found) + len(words) > self.kept:
                self.found.clear()
            new = [i for i, w in zip(first[hit].tolist(), words, strict=True) if w not in self.found]
            for i in range(0, len(new), 1024):
                part = new[i : i + 1024]
                self.found.update(zip((key[j].tobytes() for j in part), self.near(s[part]), strict=True))
            near = np.full(len(first), -1)
            got = [self.found[w] for w in words]
            near[hit] = [-1 if g is None else i for i, g in enumerate(got)]
            at = near[of]
            for row in np.flatnonzero(at >= 0).tolist():
                which, k = got[at[row]]
                out[owners[row], which] = np.maximum(out[owners[row], which], k)
        return out

    @staticmethod
    def _words(texts: list[str]):
        """By length: the texts of the words, and their symbols. Letters that stand alone in a row of three or more are a word too."""
        folded = [fold(t) for t in texts]
        sizes = np.cumsum([len(f) + 1 for f in folded])
        b = np.full(int(sizes[-1]) + 1, 32, np.uint8)
        for f, end in zip(folded, sizes.tolist(), strict=True):
            b[end - len(f) : end] = f
        space = b == 32
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        owners, lens = np.searchsorted(sizes, starts, side="left"), ends - starts
        alone = np.concatenate([[False], lens == 1, [False]])
        runs = []
        edges = np.flatnonzero(alone[1:] != alone[:-1])
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # words i to j - 1 are single letters
            for own in np.unique(owners[i:j]).tolist() if j - i >= ORDER else ():
                at = np.arange(i, j)[owners[i:j] == own]
                if len(at) >= ORDER:
                    runs.append((own, b[starts[at]]))
        if runs:
            more = np.cumsum([len(b), *[len(r) for _, r in runs]])
            b = np.concatenate([b, *[r for _, r in runs]])
            starts, ends = np.concatenate([starts, more[:-1]]), np.concatenate([ends, more[1:]])
            owners, lens = np.concatenate([owners, [o for o, _ in runs]]), ends - starts
        lead = np.full(len(starts), _START, np.int32)
        long = np.flatnonzero(lens > WINDOW)
        if len(long):
            half = WINDOW // 2
            n = np.maximum(1, -(-lens[long] // half) - 1)
            of = np.repeat(long, n)
            step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            begin = starts[of] + step * half
            rest = np.delete(np.arange(len(starts)), long)
            size = np.minimum(WINDOW, ends[of] - begin)
            starts, owners, lens = np.concatenate([starts[rest], begin]), np.concatenate([owners[rest], owners[of]]), np.concatenate([lens[rest], size])
            lead = np.concatenate([lead[rest], np.where(step == 0, _START, 0).astype(np.int32)])
        parts = [(starts, owners, lens, lead)]
        for n in BEGINNINGS:
            at = np.flatnonzero((lens > n) & (lead > 0))
            parts.append((starts[at], owners[at], np.full(len(at), n), lead[at]))
        starts, owners, lens, lead = (np.concatenate(x) for x in zip(*parts, strict=True))
        for n in range(ORDER, WINDOW + 1):
            at = np.flatnonzero(lens == n)
            for i in range(0, len(at), 200_000):
                some = at[i : i + 200_000]
                yield owners[some], np.concatenate([lead[some, None], _SYMBOL[b[starts[some, None] + np.arange(n)]]], axis=1)


class Model:
    """Landmarks, their clean look-alikes, their map, the machine's weights and the logistic curve; plain arrays, the same size for any corpus."""

    def __init__(self, words, clean, whiten, weights, slope):
        self.words, self.clean, self.whiten, self.weights, self.slope = words, clean, whiten, weights, slope

    def scores(self, kernels: np.ndarray) -> np.ndarray:
        margin = kernels.astype(np.float64) @ self.whiten @ self.weights - 1
        return 1 / (1 + np.exp(-np.clip(self.slope * margin, -40, 40)))


def _word_counts(sample: DataFrame) -> DataFrame:
    """(w, t, c, whole): in how many toxic and clean texts of the sample a word or the beginning of one is, near copies of a text
    counted once, and in how many it is a whole word. Texts whose two least word hashes agree count as copies."""
    cleaned = F.regexp_replace(F.lower("text"), r"[^\p{L}\s]", "")
    words = F.filter(F.array_distinct(F.split(cleaned, r"\s+")), lambda w: (F.length(w) >= 4) & (F.length(w) <= 16))
    texts = sample.select("toxic", words.alias("ws")).withColumn("copy", F.hash(F.slice(F.array_sort(F.transform("ws", lambda w: F.xxhash64(w))), 1, 2)))
    begun = F.flatten(F.transform("ws", lambda w: F.transform(F.sequence(F.lit(4), F.least(F.length(w), F.lit(10))), lambda n: F.substring(w, F.lit(1), n))))
    both = F.concat(F.transform("ws", lambda w: F.struct(w.alias("w"), F.lit(1).alias("whole"))), F.transform(F.array_distinct(begun), lambda w: F.struct(w.alias("w"), F.lit(0).alias("whole"))))
    each = texts.select("toxic", "copy", F.inline(both)).groupBy("w", "toxic", "copy").agg(F.max("whole").alias("whole"))
    return each.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.sum("whole").alias("whole"))


def _landmark_words(counts: DataFrame, toxic: int, clean: int, most: int) -> list[str]:
    """The words and beginnings most bound to toxic texts: at least ten times likelier there, and by a likelihood
    ratio that chance does not reach among so many words. Of beginnings nearly as frequent as a longer one, only the longest stays."""
    p = toxic / max(1, toxic + clean)
    n = F.col("t") + F.col("c")
    ratio = 2 * (F.col("t") * F.log(F.col("t") / (n * p)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - p)))).otherwise(0.0))
    least = 2 * np.log(100.0 * max(1, counts.count()))
    bound = counts.where((F.col("t") >= 4) & (F.col("t") * clean >= 10 * F.col("c") * toxic)).withColumn("g", ratio).where(F.col("g") >= float(least))
    found = bound.orderBy(F.desc("g"), "w").limit(20 * most).collect()
    t, longer = {r.w: r.t for r in found}, set()
    for w in sorted(t, key=lambda w: (-len(w), w)):
        for n in range(4, len(w)):
            if t.get(w[:n], 0) * 0.9 <= t[w]:
                longer.add(w[:n])
    return sorted([r.w for r in found if r.w not in longer][:most])


def _lookalikes(counts: DataFrame, words: list[str], most: int) -> list[str]:
    """For each landmark the words closest to it, most of them, among those of two clean texts or more that are likelier there than in toxic ones."""

    def nearest(found):
        marks = Landmarks(words)
        for b in found:
            k = marks.texts(b.column(0).to_pylist())
            row, at = np.nonzero(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(at, pa.int64()), pa.array(k[row, at].astype(np.float64), pa.float64())], names=["w", "mark", "k"])

    near = counts.where("whole > 0 and c >= 2 and c > t").select("w").mapInArrow(nearest, "w string, mark long, k double")
    first = Window.partitionBy("mark").orderBy(F.desc("k"), "w")
    near = near.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= most).select("w").distinct()
    return sorted(r.w for r in near.collect() if r.w not in words)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2000, landmarks: int = 128, lookalikes: int = 24, sentences: int = 8, ridge: float = 1e-4, rounds: int = 2000) -> Model:
    """Fits on at most per_class labelled texts of either class, by the md5 of their ids (a documented bound),
    and on up to sentences sentences of each: of a toxic one those that hold a landmark, of a clean one those that
    come near to a landmark. Nothing but labelled texts teaches, and every one of them does.

    An id labelled more than once counts once for each class that it has. Without
    labels of both classes the model scores everything 0.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
    sample = bounded_sample(known, "_id", "toxic", per_class)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id")  # at most 2 x per_class rows of two numbers
    rows = written(rows, "toxicity-sample")
    counts = written(_word_counts(rows), "toxicity-words")
    per = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    words = _landmark_words(counts, per.get(1, 0), per.get(0, 0), landmarks) if len(per) == 2 else []
    clean = _lookalikes(counts, words, lookalikes) if words else []

    def kernels(found):
        marks = Landmarks(words, clean)
        for b in found:
            toxic, rows, at = [], [], 0
            labels_, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for run in pieces((t or "" for t in texts), 1_000_000):
                parts = [[text] + [s for s in _SENTENCE.split(text) if s] for text in run]
                k, begin = marks.texts([p for some in parts for p in some]), 0
                for some in parts:
                    mine, begin, label, at = k[begin : begin + len(some)], begin + len(some), labels_[at], at + 1
                    # every text teaches; a toxic one's sentences as far as they hold a landmark: the others don't show why it is
                    near = [0, *[i for i in range(1, len(mine)) if mine[i].any()][:sentences]] if label == 0 else [0, *[i for i in range(1, len(mine)) if mine[i].max(initial=0) >= 0.97][:sentences]]
                    toxic += [label] * len(near)
                    rows += mine[near].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(rows, pa.list_(pa.float32()))], names=["toxic", "k"])

    got = rows.select("toxic", "text").repartition(2 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(kernels, "toxic int, k array<float>").toPandas() if words else None  # per_class x (sentences + 1) rows of each class at most
    if got is None or got.toxic.nunique() < 2:
        return Model([], [], np.zeros((0, 0)), np.zeros(0), 1.0)
    k, y = np.array(got.k.to_list(), np.float64), np.where(got.toxic == 1, 1.0, -1.0)
    k = k[np.lexsort((*k.T, y))]  # the same sums whatever the order of rows
    y = np.sort(y)
    values, vectors = np.linalg.eigh(Landmarks(words).matrix())
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    x = k @ whiten
    w, mean = np.zeros(x.shape[1]), 0.0
    share = 1 / len(y)
    for i in range(rounds):  # subgradient steps on the hinge loss, averaged over the second half; a text without any landmark has the margin -1
        on = (y * (x @ w - 1) < 1) * y * share
        w = w - (ridge * w - on @ x) / (ridge * (i + 100))
        mean = mean + w if i >= rounds // 2 else mean
    w = mean / (rounds - rounds // 2)
    m, slope, target = x @ w - 1, 1.0, (y + 1) / 2
    for _ in range(50):  # Newton steps for the slope of the logistic curve
        p = 1 / (1 + np.exp(-np.clip(slope * m, -40, 40)))
        slope = float(np.clip(slope - ((p - target) @ m * share + 1e-3 * slope) / ((p * (1 - p)) @ (m * m) * share + 1e-3), 0.5, 10))
    return Model(words, clean, whiten, w, slope)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, score, predicted, closest (the landmark nearest to any word, or null).

    Null and empty texts have a score too, that of a text without any landmark. Whole
    texts are read, long words in windows. Repeated rows and null ids give a row each;
    other columns are ignored; no shuffle.
    """

    def batches(found):
        marks = Landmarks(model.words, model.clean)
        for b in found:
            k = [marks.texts(run) for run in pieces((t.as_py() or "" for t in b.column(1)), 2_000_000)]
            k = np.concatenate(k) if k else np.zeros((0, len(model.words)), np.float32)
            s = model.scores(k) if len(model.words) else np.zeros(len(k))
            near = [model.words[int(np.argmax(x))] if len(x) and x.max() > 0 else None for x in k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(near, pa.string())], names=[id_col, "score", "predicted", "closest"])

    return docs.select(id_col, text_col).mapInArrow(batches, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int, closest string")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id")))
    return score(docs, model).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "score", "predicted", "closest")
