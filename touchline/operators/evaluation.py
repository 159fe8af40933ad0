"""Scoring rules, calibration, baselines, paired block bootstrap and sets of predictions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import spread

EPS = 1e-15
#: Edges of ten equal bins, as evenly spaced doubles.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def _of_truth():
    return F.when(F.col("outcome") == "H", F.col("home")).when(F.col("outcome") == "D", F.col("draw")).otherwise(F.col("away"))


def _pick():
    h, d, a = F.col("home"), F.col("draw"), F.col("away")
    return F.when((h >= d) & (h >= a), "H").when(d >= a, "D").otherwise("A")


def log_loss():
    return -F.ln(F.least(F.greatest(_of_truth(), F.lit(EPS)), F.lit(1.0)))


def brier():
    square = lambda p, o: F.pow(F.col(p) - (F.col("outcome") == o).cast("double"), 2)
    return square("home", "H") + square("draw", "D") + square("away", "A")


def outcome_scores(predictions: DataFrame) -> DataFrame:
    """By model, over rows (model, home, draw, away, outcome)."""
    return predictions.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(log_loss()), 6).alias("log_loss"), F.round(F.avg(brier()), 6).alias("brier"), F.round(F.avg((_pick() == F.col("outcome")).cast("double")), 6).alias("accuracy"))


def binary_scores(rows: DataFrame, p: str = "p", truth: str = "truth") -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    y = F.col(truth).cast("double")
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))), 6).alias("log_loss"), F.round(F.avg(F.pow(F.col(p) - y, 2)), 6).alias("brier"))


def numeric_scores(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(e), 6).alias("bias"))


def calibration(rows: DataFrame, p: str = "p", truth: str = "truth") -> DataFrame:
    """By model and bin: size, mean prediction, frequency, and the model's expected calibration error."""
    bin_ = F.lit(9)
    for k in range(8, -1, -1):
        bin_ = F.when(F.col(p) < EDGES[k + 1], k).otherwise(bin_)
    bins = rows.groupBy("model", bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("m"), F.avg(F.col(truth).cast("double")).alias("f"))
    every = Window.partitionBy("model")
    ece = F.sum(F.col("n") * F.abs(F.col("m") - F.col("f"))).over(every) / F.sum("n").over(every)
    return bins.select("model", "bin", "n", F.round("m", 6).alias("mean_predicted"), F.round("f", 6).alias("frequency"), F.round(ece, 6).alias("ece"))


def baselines(outcomes: DataFrame) -> DataFrame:
    """What outcome frequencies alone would score; one row."""
    share = lambda o: F.avg((F.col("outcome") == o).cast("double"))
    r = outcomes.agg(F.count("*").alias("n"), share("H").alias("h"), share("D").alias("d"), share("A").alias("a"))
    info = lambda c: F.when(F.col(c) > 0, -F.col(c) * F.ln(c)).otherwise(0.0)
    return r.select("n", F.round(info("h") + info("d") + info("a"), 6).alias("base_rate_log_loss"), F.round(1 - F.col("h") * F.col("h") - F.col("d") * F.col("d") - F.col("a") * F.col("a"), 6).alias("base_rate_brier"), F.round(F.greatest("h", "d", "a"), 6).alias("base_rate_accuracy"), F.round("h", 6).alias("always_home_accuracy"))


def paired_bootstrap(differences: DataFrame, replicates: int = 4000, seed: str = "7") -> DataFrame:
    """Resamples blocks (competition, ISO week) of rows (competition_id, day, diff): one row of mean, interval and P(better).

    Blocks are summed first; what is multiplied by replicates is weeks x competitions,
    not rows. Draws are md5 values, so any engine makes the same ones.
    """
    blocks = differences.groupBy("competition_id", F.extract(F.lit("YEAROFWEEK"), "day").alias("y"), F.weekofyear("day").alias("w")).agg(F.sum("diff").alias("s"), F.count("*").alias("n"))
    numbered = blocks.withColumn("k", F.row_number().over(Window.orderBy("competition_id", "y", "w")) - 1)
    size = blocks.agg(F.count("*").alias("b"))  # one row
    draws = numbered.select(F.col("k").alias("j")).join(F.broadcast(size)).select("j", "b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("r").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("b")
    means = draws.select("r", at.cast("int").alias("k")).join(numbered.select("k", "s", "n"), "k").groupBy("r").agg((F.sum("s") / F.sum("n")).alias("m"))
    total = blocks.agg((F.sum("s") / F.sum("n")).alias("d"))  # one row
    return means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"), F.avg((F.col("m") < 0).cast("double")).alias("pb")).join(F.broadcast(total)).select(F.round("d", 6).alias("difference"), F.round("lo", 6).alias("low"), F.round("hi", 6).alias("high"), F.round("pb", 6).alias("p_better"))


def complete_set(predictions: DataFrame, models: int) -> DataFrame:
    """Matches that every model predicts."""
    return predictions.groupBy("id").agg(F.count_distinct("model").alias("k")).where(F.col("k") == models).select("id")


def combine(predictions: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean by match over the models that predict it; without any weight, the plain mean."""
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("model")), F.lit(0.0))
    r = predictions.withColumn("w", w).withColumn("w", F.when(F.sum("w").over(Window.partitionBy("id")) > 0, F.col("w")).otherwise(1.0))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("w")) / F.sum("w"), 6).alias(c)
    return r.groupBy("id").agg(mean("home"), mean("draw"), mean("away"), F.count("*").alias("models"))


def versions(rows: DataFrame, key: str = "id", created: str = "created_at") -> DataFrame:
    """Numbers each match's predictions, marks all but the last as superseded, and tells what moved by 0.01 or more."""
    by = Window.partitionBy(key).orderBy(created)
    moved = lambda c: F.when(F.abs(F.col(c) - F.lag(c).over(by)) >= 0.01, F.concat(F.lit(c + ":"), F.format_number(F.col(c) - F.lag(c).over(by), 2)))
    return rows.select(key, created, F.row_number().over(by).alias("version"), F.lead(created).over(by).isNotNull().alias("superseded"), F.concat_ws(";", moved("home"), moved("draw"), moved("away")).alias("changes"))


def refit_checkpoints(days: DataFrame, every: int = 28) -> DataFrame:
    """The days on which a model is fitted anew: the first, then each first day at least every days later. One list of days a key."""
    step = F.aggregate("days", F.array().cast("array<date>"), lambda acc, d: F.when((F.size(acc) == 0) | (F.datediff(d, F.element_at(acc, -1)) >= every), F.array_append(acc, d)).otherwise(acc))
    return days.groupBy("competition_id").agg(F.array_sort(F.collect_set("day")).alias("days")).select("competition_id", F.explode(step).alias("checkpoint"))


def draw_multiplier(fit: DataFrame, score: DataFrame, low: float = 0.85, high: float = 1.25, steps: int = 81) -> DataFrame:
    """One row (multiplier, n_fitted, n_scored, before, after, difference): the factor on the draw's probability with the least log loss on fit,
    and what it does on score. Both hold rows (home, draw, away, outcome).

    All losses of the grid are sums of one pass: a row gives one value a step, which are added up where the row is.
    """
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    total = F.col("home") + F.col("draw") + F.col("away")

    def loss(k):
        p = F.when(F.col("outcome") == "D", F.col("draw") * k).otherwise(_of_truth())
        return -F.ln(F.least(F.greatest(p / (total + F.col("draw") * (k - 1)), F.lit(1e-12)), F.lit(1.0)))

    sums = fit.agg(F.count("*").alias("n_fitted"), *[F.avg(loss(F.lit(k))).alias(f"l{i}") for i, k in enumerate(grid)])  # one row
    best = sums.select("n_fitted", F.array_min(F.array(*[F.struct(F.round(f"l{i}", 9).alias("l"), F.lit(k).alias("k")) for i, k in enumerate(grid)])).alias("b")).select("n_fitted", F.col("b.k").alias("multiplier"))
    r = score.join(F.broadcast(best)).groupBy("multiplier", "n_fitted").agg(F.count("*").alias("n_scored"), F.avg(loss(F.lit(1.0))).alias("before"), F.avg(loss(F.col("multiplier"))).alias("after"))
    return r.select(F.round("multiplier", 6).alias("multiplier"), "n_fitted", "n_scored", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(F.col("after") - F.col("before"), 6).alias("difference"))


def poisson_edges(most: int = 8) -> list[float]:
    """Where a number between 0 and 1 stands for 0, 1, ... draws of a Poisson(1)."""
    edges, p, total = [], 0.36787944117144233, 0.0
    for k in range(most):
        total += p
        edges.append(total)
        p /= k + 1
    return edges


def md5_starts(head: bytes, tails: np.ndarray) -> np.ndarray:
    """The first 32 bits of md5(head + tail), as its hexadecimal form begins, for each row of bytes in tails (all of one length, 55 bytes in all at most)."""
    size = len(head) + tails.shape[1]
    block = np.zeros((len(tails), 64), np.uint8)
    block[:, : len(head)] = np.frombuffer(head, np.uint8)
    block[:, len(head) : size] = tails
    block[:, size] = 128
    block[:, 56:58] = (size * 8 & 255, size * 8 >> 8)
    used = {*range(size // 4 + 1), 14}  # the other words are zero
    words = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = (np.full(len(tails), x, np.uint32) for x in _MD5_START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # the last three steps don't touch these bits
        turn = i // 16
        if turn < 2:  # either c or d by the bits of b, or b or c by those of d
            x, y, z = (b, c, d) if turn == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = (i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16
        np.add(f, a, out=f)
        np.add(f, _MD5_SINES[i], out=f)
        if word in used:
            np.add(f, words[word], out=f)
        left = _MD5_TURNS[turn][i % 4]
        np.left_shift(f, left, out=t)
        np.right_shift(f, 32 - left, out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_MD5_START[0])).byteswap()


_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def _resampled(replicates: int, seed: str, rows: int = 16384):
    """Arrow rows (tail, diff) -> (r, s, k): of each replicate the sums of its draws x diff, and of its draws."""
    bounds = np.array([math.ceil(e * 2**32) for e in poisson_edges()], np.uint64)  # a start below one of them is below the edge

    def draws(starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, starts, side="right")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, k, known = np.zeros(replicates), np.zeros(replicates, np.int64), 0
        for batch in batches:
            diff = batch.column("diff")
            known += len(diff) - diff.null_count
            diff = diff.fill_null(0.0).to_numpy(zero_copy_only=False)
            tails = [x.encode() for x in batch.column("tail").to_pylist()]
            sizes = np.array([len(x) for x in tails], int)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for some in np.split(at, range(rows, len(at), rows)):
                    values, texts = diff[some], np.frombuffer(b"".join(tails[i] for i in some), np.uint8).reshape(len(some), size)
                    for r in range(replicates):
                        head = f"{seed}:{r}".encode()
                        if len(head) + size <= 55:
                            starts = md5_starts(head, texts)
                        else:
                            starts = np.array([int(hashlib.md5(head + tails[i]).hexdigest()[:8], 16) for i in some])
                        n = draws(starts)
                        s[r] += values @ n
                        k[r] += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(replicates), pa.int32()), pa.array(s if known else [None] * replicates, pa.float64()), pa.array(k)], ["r", "s", "k"])

    return fold


def bootstrap(differences: DataFrame, replicates: int = 4000, seed: str = "7") -> DataFrame:
    """One row (difference, low, high) over rows (id, diff): the mean and its interval over resamples in which each row is drawn a Poisson(1) number of
    times, by the md5 of seed, replicate and id. Rows meet no other rows: a task draws and sums its own, and sends a row a replicate."""
    rows = differences.select(F.coalesce(F.concat(F.lit(":"), F.col("id").cast("string")), F.lit("")).alias("tail"), F.col("diff").cast("double").alias("diff"))
    parts = spread(rows, "tail").mapInArrow(_resampled(replicates, seed), "r int, s double, k long")
    means = parts.groupBy("r").agg((F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("m"))
    every = differences.agg(F.avg("diff").alias("d"))  # one row
    return means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi")).join(F.broadcast(every)).select(F.round("d", 6).alias("difference"), F.round("lo", 6).alias("low"), F.round("hi", 6).alias("high"))
