"""Spelling variants: words of a corpus that differ by one character, grouped under the most frequent form.

Near words are found by pivotal grams. Bigrams have one order over the whole
vocabulary, rarest first. A word's prefix is its first three bigrams in that order
(with all places of the last), its pivots are two disjoint bigrams of the prefix,
chosen by dynamic programming so that their lists are short. One edit spoils at most
one of two disjoint bigrams. So of two near words, the one whose prefix ends earlier
has a pivot that stands in the other's prefix, at the same place from the left if
the edit is right of it, else at the same place from the right. Words meet in the
lists of (bigram, all that stands on its untouched side, length) and are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, table, written

#: The letters of a run; 90 of them are left when A-Z is lower-cased, so there are 8100 bigrams at most.
RUN = r"[A-Za-z\x{00C0}-\x{00FF}]+"
GRAM, EDITS = 2, 1


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97) -> DataFrame:
    """Rows (word): each run of letters of each whole text, with A-Z in lower case; where the crc32 of `<id>:<run>` is divisible
    by every, without its code point at crc32 % length. Null texts have no runs; a null id counts as an empty one."""
    found = docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("_run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.when(F.lower("_run") == F.col("_run"), F.col("_run")).otherwise(F.translate("_run", upper, upper.lower()))
    h = F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), F.col("_word")).cast("binary"))
    at = (F.col("_h") % F.length("_word")).cast("int")
    cut = F.concat(F.substring("_word", F.lit(1), at), F.substring("_word", at + 2, F.length("_word")))
    return found.select("_id", lowered.alias("_word")).withColumn("_h", h).select(F.when(F.col("_h") % every == 0, cut).otherwise(F.col("_word")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of words with at least so many code points and occurrences."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def pivots(grams: list[tuple[float, int]], wanted: int = EDITS + 1) -> list[int]:
    """Places of `wanted` disjoint bigrams with the smallest sum of costs; grams: (cost, place), by place. Fewer places than that if there are none.

    best[k] is the cheapest choice of k bigrams among those met so far that end before the next one's start.
    """
    best: list[list[tuple[float, tuple[int, ...]]]] = []  # for each gram and k, the cheapest choice of k up to it
    for i, (cost, place) in enumerate(grams):
        row = [(0.0, ())]
        free = next((j for j in range(i - 1, -1, -1) if grams[j][1] + GRAM <= place), None)
        for k in range(1, wanted + 1):
            options = []
            if i and len(best[i - 1]) > k:
                options.append(best[i - 1][k])
            before = best[free] if free is not None else [(0.0, ())]
            if len(before) >= k:
                options.append((before[k - 1][0] + cost, (*before[k - 1][1], place)))
            if options:
                row.append(min(options))
        best.append(row)
    return list(best[-1][-1][1]) if best else []


def _chosen(rank: dict[str, int], size: list[int]):
    """Arrow rows (word, last, a, b, places): rank of the prefix's last bigram, places of the pivots, and of all bigrams in the prefix."""
    import pyarrow as pa

    def choose(batches: Iterator) -> Iterator:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for word in batch.column(0).to_pylist():
                ranks = [rank[word[i : i + GRAM]] for i in range(len(word) - 1)]
                last = sorted(ranks)[GRAM * EDITS]
                places = [i for i, r in enumerate(ranks) if r <= last]
                # a list gets shorter with all that stands on the untouched side of the bigram, about by half a letter
                n = len(ranks)
                a, b = pivots([(size[ranks[i]] * 0.5 ** min(i, n - 1 - i), i) for i in places])
                for column, value in zip(out, (word, last, a, b, places), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *[pa.array(c, pa.int32()) for c in out[1:4]], pa.array(out[4], pa.list_(pa.int32()))], ["word", "last", "a", "b", "places"])

    return choose


def _shuffled(df: DataFrame) -> DataFrame:
    """df as a side that a join shuffles, never broadcasts: a table of words is small on disk, but its rows, and the lists that are
    made of them, would all pass through the driver."""
    return df.hint("merge")


def near(vocab: DataFrame) -> DataFrame:
    """Pairs (a, an, b, bn) of words that differ by exactly one inserted, deleted or replaced code point, each pair once.

    vocab: (word, n), words distinct, of four code points or more, in the letters of RUN. Words meet by shuffles only; what
    is broadcast is the order of bigrams (8100 rows at most).
    """
    grams = vocab.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))).alias("g")).groupBy("g").count().collect()
    ordered = sorted((r["count"], r["g"]) for r in grams)
    rank, size = {g: k for k, (_, g) in enumerate(ordered)}, [n for n, _ in ordered]
    chosen = written(vocab.select("word").mapInArrow(_chosen(rank, size), "word string, last int, a int, b int, places array<int>").join(_shuffled(vocab), "word"), "grams")
    length = F.length("word")
    # a list's key: the bigram with all that is left of it, or right of it, and the length of the words in the list
    left = lambda at: F.concat(F.lit("<"), F.substring("word", F.lit(1), at + GRAM))
    right = lambda at: F.concat(F.lit(">"), F.substring("word", at + 1, length))
    key = lambda text, size: F.xxhash64(text, size.cast("int"))
    lists = chosen.select("word", "n", "last", F.explode(F.flatten(F.transform("places", lambda p: F.array(key(left(p), length), key(right(p), length))))).alias("key"))
    ways = [F.struct(F.lit(way).alias("way"), key(side(F.col(at)), length + d).alias("key")) for way, side, at in (("<", left, "a"), (">", right, "b")) for d in (-1, 0, 1)]
    asks = chosen.select(F.col("word").alias("a_word"), F.col("n").alias("a_n"), F.col("last").alias("a_last"), F.substring("word", F.lit(1), F.col("b")).alias("head"), F.explode(F.array(*ways)).alias("ask")).select("*", "ask.*").drop("ask")
    # of a pair, the word whose prefix ends earlier asks (of two that end alike, the first); the pair is found from the left if all
    # before the second pivot agrees, and from the right only if it doesn't: so each pair comes once
    met = asks.join(_shuffled(lists), "key").where((F.col("a_last") < F.col("last")) | ((F.col("a_last") == F.col("last")) & (F.col("a_word") < F.col("word"))))
    met = met.where(F.col("word").startswith(F.col("head")) == (F.col("way") == "<")).where(F.levenshtein("a_word", "word", EDITS) == EDITS)
    return met.select(F.col("a_word").alias("a"), F.col("a_n").alias("an"), F.col("word").alias("b"), F.col("n").alias("bn"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from links (word, form): follows the forms to the last. Counts at least double along links, so chains are short and end."""
    held = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = held.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = written(held.join(_shuffled(onward), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "forms")
        moved = after.where("_moved").limit(1).count()
        drop_written(held)
        held = after.drop("_moved")
        if not moved:
            return held


def group(vocab: DataFrame, times: int = 2) -> DataFrame:
    """One row per word of vocab (word, n): word, form, root, n, n_near, form_n.

    form is the near word with the largest n (the first by code point among equals) if that n is times the word's or more.
    A vocabulary without rows gives none. vocab comes written: it is read several times.
    """
    each: list[Column] = [F.struct(F.col(x).alias("word"), (-F.col(f"{y}n")).alias("less"), F.col(y).alias("near")) for x, y in (("a", "b"), ("b", "a"))]
    best = near(vocab).select(F.explode(F.array(*each)).alias("p")).groupBy("p.word").agg(F.count("*").alias("n_near"), F.min(F.struct("p.less", "p.near")).alias("best"))
    known = F.col("best").isNotNull() & (-F.col("best.less") >= times * F.col("n"))
    rows = written(vocab.join(_shuffled(best), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("best.near")).alias("form"), F.when(known, -F.col("best.less")).cast("long").alias("form_n")), "near")
    return rows.join(_shuffled(roots(rows.where("form is not null"))), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return group(written(vocabulary(runs(table(spark, sf_dir, "documents"))), "words"))
