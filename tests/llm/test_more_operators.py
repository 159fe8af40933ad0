"""Spelling variants, filter audits and repeated strings against plain versions, and on rows that try to break them."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from touchline.llm import diagrams, spelling, suffixes

from .test_operators import SF, docs, none, same_rows, table  # noqa: F401


# 11 spelling
def plain_runs(rows):
    found = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            found[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return found


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :])


def plain_groups(counts, least=3, length=5):
    v = {w: n for w, n in counts.items() if n >= least and len(w) >= length}
    near = {w: [x for x in v if one_apart(w, x)] for w in v}
    form = {}
    for w, n in v.items():
        best = min(((-v[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), v.get(form[w])) for w, n in v.items()}


def grouped(rows):
    got = spelling.group(spelling.written(spelling.vocabulary(rows), "words")).collect()
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def test_pivots_are_disjoint_and_cheapest():
    r = random.Random(1)
    for _ in range(300):
        places = sorted(r.sample(range(12), r.randint(3, 8)))
        grams = [(float(r.randint(1, 9)), p) for p in places]
        got = spelling.pivots(grams)
        options = [(a[0] + b[0]) for a, b in itertools.combinations(grams, 2) if b[1] - a[1] >= 2]
        assert len(got) == 2 and got[1] - got[0] >= 2
        assert sum(dict((p, c) for c, p in grams)[p] for p in got) == min(options)


def test_spelling_against_all_pairs(spark):
    r = random.Random(7)
    rows = []
    for alphabet, size in (("ab", 700), ("abcdefghijéß", 900)):  # many near words and repeated bigrams, then few
        base = ["".join(r.choice(alphabet) for _ in range(r.randint(5, 9))) for _ in range(60)]
        for _ in range(size):
            w = r.choice(base)
            k = r.randrange(len(w))
            w = r.choice([w, w, w[:k] + w[k + 1 :], w[:k] + r.choice(alphabet) + w[k:], w[:k] + r.choice(alphabet) + w[k + 1 :]])
            rows += [(w,)] * r.choice([1, 3, 4, 9])
    counts = collections.Counter(w for (w,) in rows)
    assert grouped(spark.createDataFrame(rows, "word string").repartition(3)) == plain_groups(counts)


def test_spelling_of_documents(spark, docs, none):  # noqa: F811
    rows = table(spark, "documents").limit(60).select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    assert grouped(spelling.runs(rows)) == plain_groups(plain_runs([(x.doc_id, x.text) for x in rows.collect()]))
    assert spelling.group(spelling.vocabulary(spelling.runs(none))).count() == 0


def test_chains_end_at_the_last_form(spark):
    words = [("aaaaaa", 3), ("aaaaab", 6), ("aaaabb", 12), ("aaabbb", 24), ("aabbbb", 48), ("abbbbb", 96), ("zzzzz", 5)]
    got = spelling.group(spark.createDataFrame(words, "word string, n long")).collect()
    assert {x.root for x in got} == {"abbbbb", "zzzzz"} and max(x.n_near for x in got) == 2


def test_words_and_their_lists_are_never_broadcast(spark):
    """A table of words is small on disk, its lists are not: neither passes through the driver, however small Spark takes it to be."""
    vocab = spelling.written(spark.createDataFrame([("aaaaaa", 3), ("aaaaab", 6), ("aaaabb", 12), ("zzzzz", 5)], "word string, n long"), "words")
    for rows in (spelling.near(vocab), spelling.group(vocab)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_hot_list_holds_every_pair_once(spark):
    """A thousand words with one beginning and one ending that no other words have."""
    r = random.Random(3)
    words = sorted({"qx" + "".join(r.choice("abc") for _ in range(6)) + "xq" for _ in range(1000)})
    pairs = spelling.near(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).select("a", "b").collect()
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(words, 2) if one_apart(a, b)}
    assert len(pairs) == len(want) and {tuple(sorted(p)) for p in pairs} == want


# 12 audit
def test_swaps_meet_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in diagrams.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def test_diagrams_against_sums():
    r = random.Random(2)
    for n in (1, 3, 5):
        names = "ABCDE"[:n]
        counts = {m: (r.randint(1, 9), r.randint(0, 3), r.randint(0, 3)) for m in range(1 << n) if r.random() < 0.6}
        total = collections.Counter()
        rows = list(diagrams.steps(names, counts))
        for order, step, kept, removed, redundant, alone, good, toxic, _ in rows:
            bit = 1 << names.index(order[step - 1])
            before = sum(1 << names.index(v) for v in order[: step - 1])
            here = [c for m, c in counts.items() if m & bit and not m & before]
            assert (kept, removed) == (sum(c[0] for m, c in counts.items() if not m & (before | bit)), sum(c[0] for c in here))
            assert (redundant, alone) == (sum(c[0] for m, c in counts.items() if m & bit and m & before), counts.get(bit, (0,))[0])
            assert (good, toxic) == (sum(c[1] for c in here), sum(c[2] for c in here))
            total[order[step - 1]] += removed
        assert all(x[-1] == total[x[0][x[1] - 1]] for x in rows)


def test_a_diagram_shares_equal_nodes():
    d = diagrams.Diagram("ABCDE", {m: (1, 0, 0) for m in range(32)}, 3)
    assert len(d.kinds) == 7  # one a level, the leaf, and the leaf of zeros
    for k in diagrams.swaps(5):
        d.swap(k)
    d.compact()
    assert len(d.kinds) == 7


def test_audit_against_sql(spark):
    same_rows(spark, "op12_audit", diagrams.SQL)


def test_audit_of_odd_rows(spark, docs, none):  # noqa: F811
    """Null and repeated ids, null texts and parts, labels that are there twice or are null."""
    labels = spark.createDataFrame([(0, 1, None), (0, 0, 1), (1, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.mask): (r.n, r.good, r.toxic) for r in diagrams.masks(docs, labels).where("n > 0").collect()}
    rows = [(x.doc_id, x.text or "", x.lang or "") for x in docs.collect()]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    want = collections.defaultdict(lambda: [0, 0, 0])
    for i, t, part in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        c = want[part, sum(1 << k for k, f in enumerate(fails) if f)]
        c[0] += 1
        c[1] += i in (0, 3)
        c[2] += i == 0
    assert got == {k: tuple(c) for k, c in want.items()}
    assert diagrams.audit(diagrams.masks(none, labels), "ABCDE").count() == 0


# 13 suffixes
def test_deep_shallow_sorts():
    r = random.Random(5)
    for k in range(120):
        alphabet = (b"ab", b"\0\1", bytes(range(256)))[k % 3]
        some = [bytes(r.choice(alphabet) for _ in range(r.choice([0, 3, 8, 31, 32, 60]))) for _ in range(r.randint(1, 40))]
        some += [s + bytes(r.choice(alphabet) for _ in range(r.randint(0, 4))) for s in some]
        order, shared = suffixes.deep_shallow(some)
        got = [some[i] for i in order]
        assert got == sorted(some) and sorted(order.tolist()) == list(range(len(some)))
        assert all(a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or a == b for a, b, n in zip(got, got[1:], shared[1:].tolist(), strict=False))


def plain_clean(rows, length=100):
    rows = [(suffixes.LAST_ID if i is None else i, (t or "").encode()) for i, t in rows]
    first, out = {}, {}
    for i, b in sorted(set(rows)):
        for s in range(len(b) - length + 1):
            at = (i, s, zlib.crc32(b))
            first[b[s : s + length]] = min(at, first.get(b[s : s + length], at))
    for i, b in set(rows):
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (i, s, zlib.crc32(b)):
                gone[s : s + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", gone)]
        out[i, b] = (len(b), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return sorted((i, *out[i, b]) for i, b in rows)


def cleaned(df, **options):
    rows = suffixes.clean(df, **options).collect()
    return sorted((suffixes.LAST_ID if r.doc_id is None else r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans or []], hashlib.sha256(r.kept).hexdigest()) for r in rows)


@pytest.fixture(scope="module")
def passages():
    """Three hundred documents with parts of one passage, and texts that repeat within themselves."""
    r = random.Random(4)
    say = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passage = say(180)
    rows = [(i, say(r.randint(0, 150)) + passage[r.randint(0, 20) : r.randint(100, 180)] + say(r.randint(0, 150))) for i in range(300)]
    return rows + [(1, rows[1][1]), (1, rows[2][1]), (1, "x" + rows[1][1]), (None, rows[5][1]), (None, None), (7, ""), (400, "a" * 700), (401, "ab" * 300), (402, "a" * 99), (403, "é" * 120), (404, "ab" * 300 + "x"), (405, passage * 40)]


@pytest.mark.parametrize("most", [10_000, 3, 0])
def test_repeats_against_all_strings(spark, passages, most):
    """Sorted classes only, some classes spread by windows, all spread."""
    assert cleaned(spark.createDataFrame(passages, "doc_id long, text string").repartition(3), most=most) == plain_clean(passages)


def test_repeats_across_pieces(spark, passages):
    rows = passages[:40] + passages[-6:]
    assert cleaned(spark.createDataFrame(rows, "doc_id long, text string"), piece=130) == plain_clean(rows)


def test_other_lengths(spark, passages):
    rows = passages[:80]
    assert cleaned(spark.createDataFrame(rows, "doc_id long, text string"), length=70) == plain_clean(rows, 70)
    with pytest.raises(ValueError):
        suffixes.clean(spark.createDataFrame(rows, "doc_id long, text string"), length=20)


def test_repeats_in_odd_rows(spark, docs, none):  # noqa: F811
    assert cleaned(docs) == plain_clean([(x.doc_id, x.text) for x in docs.collect()])
    assert suffixes.clean(none).count() == 0
    with pytest.raises(TypeError):
        suffixes.clean(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_query_columns(spark):
    assert suffixes.op13_suffixes(spark, SF).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


# 2 vectors
def test_filters_reach_the_wanted_recall_or_all_pass():
    from touchline.llm.vectors import codes_for, found_together

    for dim, book, similarity, recall in ((64, 16, 0.9, 0.98), (64, 8, 0.3, 0.98), (8, 4, 0.5, 0.98), (3, 4, 0.2, 0.99)):
        assert found_together(codes_for(dim, book, similarity, recall), similarity) >= recall
