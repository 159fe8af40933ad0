"""Language identification as a mixture: proportions of languages in every document.

A document's byte n-grams are taken as draws from a mixture of the languages' n-gram
distributions. Expectation-maximisation finds the proportions of a set of languages,
and the set grows from the likeliest single language by the one that the likelihood
rises towards most, as long as the likelihood, less half the logarithm of the number
of n-grams for each language, rises; languages that later ones make needless leave it again. The likelihood is concave in the proportions, so
where no language has a positive slope the single one is already the best mixture;
most documents end there after one pass.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, pieces, table

#: n-grams of four bytes are hashed to this many buckets.
BUCKETS = 1 << 17
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case, other ASCII as white space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """The buckets of the whole text's n-grams, padded by a space on either side; those of white space alone are left out."""
    b = np.frombuffer(b" " + text.encode("utf-8", "replace").translate(_FOLD) + b"   ", np.uint8).astype(np.uint32)
    v = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    v = v[v != 0x20202020]
    return (v * np.uint32(2654435761)) >> np.uint32(32 - 17)


def count(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows (lang, bucket, n) over all texts, counted per batch before the shuffle."""

    def batches(found):
        for b in found:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(grams(text.as_py() or ""), minlength=BUCKETS)
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"])

    return docs.where(F.col(lang_col).isNotNull()).select(lang_col, text_col).mapInArrow(batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages and the logarithms of their n-grams' probabilities (buckets x languages).

    Fitted on at most per_language documents of each language, by the md5 of their ids;
    what comes to the driver is bounded by languages x BUCKETS counts. Rows with a null
    language or id teach nothing.
    """
    sample = bounded_sample(docs.select(id_col, lang_col), id_col, lang_col, per_language).select(F.col(id_col).alias("_id"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = count(rows.join(F.broadcast(sample.distinct()), "_id", "left_semi")).toPandas()  # per_language ids of each language at most
    languages = sorted(found.lang.unique())
    n = np.zeros((BUCKETS, len(languages)))
    for k, lang in enumerate(languages):
        rows = found[found.lang == lang]
        n[rows.bucket, k] = rows.n
    return languages, np.log((n + smoothing) / (n.sum(0) + smoothing * BUCKETS)).astype(np.float32) if languages else n.astype(np.float32)


def mixture(logs: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Proportions of all languages for n-grams with these log probabilities (rows x languages) and counts."""
    total = counts.sum()
    single = counts @ logs
    chosen = [int(np.argmax(single))]
    # relative to the best single language, whose own column becomes 1
    odds = np.exp(np.minimum(logs - logs[:, chosen[0]][:, None], 30).astype(np.float64))
    best, share, mixed = 0.0, np.ones(1), np.ones(len(counts))

    def fitted(trial: list[int], pi: np.ndarray):
        """Their proportions by expectation-maximisation, and the penalised likelihood above that of one language."""
        p = odds[:, trial]
        for _ in range(rounds):
            after = pi * ((counts / (p @ pi)) @ p) / total
            done = np.abs(after - pi).max() < 1e-4
            pi = after
            if done:
                break
        now = p @ pi
        return float(counts @ np.log(now)) - 0.5 * np.log(total) * (len(trial) - 1), pi, now

    while len(chosen) < logs.shape[1]:
        slope = (counts / mixed) @ odds - total
        slope[chosen] = 0
        new = int(np.argmax(slope))
        if slope[new] <= 0:
            break
        gain, pi, now = fitted([*chosen, new], np.append(share * 0.9, 0.1))
        if gain <= best:
            break
        chosen, share, mixed, best = [*chosen, new], pi, now, gain
        while len(chosen) > 2:  # a language that later ones make needless leaves the set
            tried = [(*fitted([c for j, c in enumerate(chosen) if j != i], (rest := np.delete(share, i)) / max(rest.sum(), 1e-300)), i) for i in range(len(chosen) - 1)]
            gain, pi, now, i = max(tried, key=lambda x: x[0])
            if gain <= best:
                break
            chosen, share, mixed, best = [c for j, c in enumerate(chosen) if j != i], pi, now, gain
    out = np.zeros(logs.shape[1])
    out[chosen] = share
    return out


def predict(docs: DataFrame, languages: list[str], logs: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id_col, lang_pred, score, mixture, and the columns in carry.

    lang_pred is the language with the largest proportion (ties: the first by name) and
    score that proportion; mixture lists all chosen languages. Texts that are null or
    hold no letter are `und` with score 0, as are all texts if nothing was learned.
    Only the text is read; repeated rows and null ids give a row each; no shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(logs)  # buckets x languages floats, whatever the corpus

    def batches(found):
        table_ = shared.value
        for b in found:
            names, scores, mixtures = [], [], []
            for run in pieces(t.as_py() or "" for t in b.column(1)):
                for text in run:
                    if not languages or not _LETTER.search(text):
                        names.append("und"), scores.append(0.0), mixtures.append("")
                        continue
                    g = grams(text)
                    seen, n = (np.unique(g, return_counts=True)) if len(g) > 4000 else (g, np.ones(len(g)))
                    pi = mixture(table_[seen], n.astype(np.float64))
                    k = int(np.argmax(pi))
                    names.append(languages[k]), scores.append(float(min(1.0, max(0.0, pi[k]))))
                    mixtures.append(",".join(f"{languages[i]}:{pi[i]:.3f}" for i in np.argsort(-pi, kind="stable") if pi[i] > 0))
            new = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *new, *b.columns[2:]], names=["_id", "lang_pred", "score", "mixture", *[f"_c_{c}" for c in carry]])

    kept = [F.col(c).alias(f"_c_{c}") for c in carry]
    schema = [f"_id {docs.schema[id_col].dataType.simpleString()}", "lang_pred string", "score double", "mixture string", *[f"`_c_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *kept).mapInArrow(batches, ", ".join(schema))
    return rows.select(F.col("_id").alias(id_col), "lang_pred", "score", "mixture", *[F.col(f"_c_{c}").alias(c) for c in carry])


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id")))
    return predict(docs, *model).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "lang_pred", "score", "mixture")
