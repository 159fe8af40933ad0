"""What each filter of a cascade removes, in every order of the filters: decision diagrams of failure masks.

The corpus is read once and becomes counts of (part, failure mask, good, toxic): at
most 4 x 2^filters rows a part. Each part's counts form a count-weighted decision
diagram whose path is the filters' verdicts, in some order, and whose leaves are
counts. The order changes by swaps of adjacent levels, which rebuild the nodes of two
levels only; a walk through all orders by such swaps visits each order once, and the
all-pass path of the diagram in that order holds what every step keeps and removes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, table

Counts = tuple[int, ...]

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


class Diagram:
    """Vectors of counts by failure mask, as an ordered diagram: node = (level's variable, pass child, fail child).

    Equal nodes are stored once, by a table of nodes for each variable. A node whose children agree stays, as
    counts of both are needed on the way down; a sum of zero is the leaf of zeros at any level.
    """

    def __init__(self, variables: str, counts: dict[int, Counts], width: int):
        """counts: by mask; bit i of a mask is set if the document fails variables[i]."""
        self.order, self.zero = list(variables), (0,) * width
        self.kinds: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.sums: list[Counts] = []
        self.none = self._node(("", self.zero))
        bit = {v: 1 << i for i, v in enumerate(variables)}

        def build(level: int, rows: dict[int, Counts]) -> int:
            if not rows:
                return self.none
            if level == len(variables):
                (only,) = rows.values()
                return self._node(("", only))
            b = bit[variables[level]]
            return self._inner(variables[level], build(level + 1, {m: c for m, c in rows.items() if not m & b}), build(level + 1, {m: c for m, c in rows.items() if m & b}))

        self.root = build(0, counts)

    def _node(self, kind: tuple) -> int:
        if kind not in self.known:
            self.known[kind] = len(self.kinds)
            self.kinds.append(kind)
            self.sums.append(kind[1] if kind[0] == "" else tuple(a + b for a, b in zip(self.sums[kind[1]], self.sums[kind[2]], strict=True)))
        return self.known[kind]

    def _inner(self, variable: str, passed: int, failed: int) -> int:
        return self.none if passed == self.none and failed == self.none else self._node((variable, passed, failed))

    def _children(self, node: int, variable: str) -> tuple[int, int]:
        return (node, node) if node == self.none else self.kinds[node][1:] if self.kinds[node][0] == variable else (node, self.none)

    def swap(self, level: int) -> None:
        """Exchanges the variables of level and level + 1; only nodes of these two levels, and the path to them, are made anew."""
        upper, lower = self.order[level], self.order[level + 1]
        done: dict[int, int] = {}

        def exchanged(node: int) -> int:
            passed, failed = self._children(node, upper)
            (pp, pf), (fp, ff) = self._children(passed, lower), self._children(failed, lower)
            return self._inner(lower, self._inner(upper, pp, fp), self._inner(upper, pf, ff))

        def rebuilt(node: int, at: int) -> int:
            if node == self.none:
                return node
            if node not in done:
                variable, passed, failed = self.kinds[node]
                done[node] = exchanged(node) if at == level else self._inner(variable, rebuilt(passed, at + 1), rebuilt(failed, at + 1))
            return done[node]

        self.root = rebuilt(self.root, 0)
        self.order[level], self.order[level + 1] = lower, upper

    def all_pass_path(self) -> Iterator[tuple[str, Counts, Counts]]:
        """For each level from the top: its variable, the sums of what passes this and all before, and of what fails here first."""
        node = self.root
        for variable in self.order:
            passed, failed = self._children(node, variable)
            yield variable, self.sums[passed], self.sums[failed]
            node = passed

    def compact(self) -> None:
        """Forgets the nodes of earlier orders."""
        kinds, known, sums = self.kinds, self.known, self.sums
        self.kinds, self.known, self.sums = [], {}, []
        moved: dict[int, int] = {}

        def keep(node: int) -> int:
            if node not in moved:
                kind = kinds[node]
                moved[node] = self._node(kind if kind[0] == "" else (kind[0], keep(kind[1]), keep(kind[2])))
            return moved[node]

        self.none = self._node(("", self.zero))
        moved[known[("", self.zero)]] = self.none
        self.root = keep(self.root)


def swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after the other, so that all n! orders are met once: the largest item sweeps through each order of the others."""
    if n < 2:
        return
    down = True
    for inner in [*swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            yield inner + (1 if down else 0)  # the sweeping item is first, so the others are one level lower
        down = not down


def steps(variables: str, counts: dict[int, Counts]) -> Iterator[tuple]:
    """(order, step, *FIELDS) for every order and step of one part; counts by mask: documents, good ones, toxic ones."""
    diagram = Diagram(variables, counts, 3)
    fails = {v: sum(c[0] for m, c in counts.items() if m >> i & 1) for i, v in enumerate(variables)}
    alone = {v: counts.get(1 << i, (0, 0, 0))[0] for i, v in enumerate(variables)}
    shapley = dict.fromkeys(variables, 0)
    found = []
    for level in [None, *swaps(len(variables))]:
        if level is not None:
            diagram.swap(level)
            if len(diagram.kinds) > 64 << len(variables):
                diagram.compact()
        order = "".join(diagram.order)
        for step, (v, passed, failed) in enumerate(diagram.all_pass_path(), 1):
            shapley[v] += failed[0]
            found.append((order, step, v, passed[0], failed[0], fails[v] - failed[0], alone[v], failed[1], failed[2]))
    for order, step, v, *numbers in found:
        yield (order, step, *numbers, shapley[v])


def audit(counts: DataFrame, variables: str) -> DataFrame:
    """Every order and step from rows (part, mask, n, good, toxic), of which a part has 2^filters at most: filters come in
    dozens of bytes, not documents, so a part's rows meet in one task whatever the corpus. A part without rows has no result."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIELDS)

    def each(key, rows):
        import pandas as pd

        counted = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"], strict=True)}
        return pd.DataFrame([(key[0], *r) for r in steps(variables, counted)], columns=["part", "filter_order", "step", *FIELDS])

    return counts.groupBy("part").applyInPandas(each, schema)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that need one text alone, by letter; text isn't null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counts (part, mask, n, good, toxic) of the five filters; bits 0 to 4 are A to E.

    Null texts are empty texts; a null part is the empty string. Only rows with an id can be copies: E fails if the same
    text stands under any smaller id. Rows of one id and text are as many documents, none a copy of the others; a row without
    an id is never a copy and makes none. Several labels of an id count as 1 if any of them is 1; without labels, 0. Empty
    tables give no rows. Other columns are ignored.

    Rows of one id, part and text are counted first, then those of one text and part, which leaves each text as many rows as
    it has parts, masks and labels; the smallest id of a text is found among these few. No group of copies is gathered.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = text_filters(F.col("_text"))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.coalesce(F.col(part_col), F.lit("")).alias("part")).select(
        "_id", "part", F.unhex(F.sha2("_text", 256)).alias("_h"), sum((F.when(fails[v], 1 << i).otherwise(0) for i, v in enumerate("ABCD")), F.lit(0)).alias("mask")
    )
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(to) for c, to in (("quality", "_good"), ("toxic", "_toxic"))])
    marked = rows.groupBy("_id", "part", "_h", "mask").agg(F.count("*").alias("_n")).join(marks, "_id", "left").fillna(0, ["_good", "_toxic"])
    # of each text, part and labels: all rows, rows with an id, and the smallest id with its rows
    few = marked.groupBy("_h", "mask", "part", "_good", "_toxic").agg(
        F.sum("_n").alias("_all"), F.coalesce(F.sum(F.when(F.col("_id").isNotNull(), F.col("_n"))), F.lit(0)).alias("_named"), F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_n"))).alias("_first")
    )
    least = few.groupBy("_h").agg(F.min("_first._id").alias("_least"))
    copies = F.col("_named") - F.when(F.col("_first._id") == F.col("_least"), F.col("_first._n")).otherwise(0)
    split = few.join(least, "_h", "left").withColumn("_copies", copies).select(
        "part", "_good", "_toxic", F.explode(F.array(F.struct(F.col("mask"), (F.col("_all") - F.col("_copies")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("_copies").alias("n")))).alias("_m")
    )
    count = lambda on: F.sum(F.when(on, F.col("_m.n")).otherwise(0)).cast("long")
    return split.groupBy("part", F.col("_m.mask").alias("mask")).agg(count(F.lit(True)).alias("n"), count(F.col("_good") == 1).alias("good"), count(F.col("_toxic") == 1).alias("toxic"))


def op12_audit(spark, sf_dir: str) -> DataFrame:
    return audit(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "ABCDE")


#: The same in DuckDB: all orders by a join of letters, each step by sums over masks.
SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), f as (
  select doc_id, part, (len(w) < 100)::int as fa, (100 * len(list_distinct(w)) < 80 * len(w))::int as fb,
    (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::int as fc,
    regexp_matches(t, '[#$%&*|]')::int as fd, coalesce(doc_id > min(doc_id) over (partition by t), false)::int as fe from d
), l as (
  select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic from labels group by doc_id
), m as (
  select part, fa, fb, fc, fd, fe, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from f left join l using (doc_id) group by all
), v as (select unnest(['A', 'B', 'C', 'D', 'E']) as x
), o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from v a, v b, v c, v d, v e
  where b.x <> a.x and c.x not in (a.x, b.x) and d.x not in (a.x, b.x, c.x) and e.x not in (a.x, b.x, c.x, d.x)
), s as (
  select filter_order, step::int as step, filter_order[step] as v, filter_order[1:step - 1] as earlier from o, range(1, 6) r(step)
), q as (
  select part, n, good, toxic, concat(case when fa = 1 then 'A' else '' end, case when fb = 1 then 'B' else '' end, case when fc = 1 then 'C' else '' end,
    case when fd = 1 then 'D' else '' end, case when fe = 1 then 'E' else '' end) as failed from m
), t as (
  select part, filter_order, step, v,
    sum(case when translate(earlier || v, failed, '') = earlier || v then n else 0 end)::bigint as kept,
    sum(case when contains(failed, v) and translate(earlier, failed, '') = earlier then n else 0 end)::bigint as removed,
    sum(case when contains(failed, v) and translate(earlier, failed, '') <> earlier then n else 0 end)::bigint as redundant,
    sum(case when failed = v then n else 0 end)::bigint as unique_fails,
    sum(case when contains(failed, v) and translate(earlier, failed, '') = earlier then good else 0 end)::bigint as good_lost,
    sum(case when contains(failed, v) and translate(earlier, failed, '') = earlier then toxic else 0 end)::bigint as toxic_lost
  from q, s group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, v)::bigint as shapley from t
"""
