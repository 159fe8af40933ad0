"""Mixing sources to target weights by systematic sampling [native].

Every document of a source expects the same number of copies, target / size of the
source. The copies are prefix-summed over the source's documents in the order
(size band, slot, id); one offset per source is added, and a document is emitted
once per whole number that its step crosses. Ordering by size band makes the words
taken follow the target closely.

The prefix sum never gathers a source: documents are counted per (source, band,
slot), those few counts are summed up in order, and only the rows of one slot are
ranked together, so a source that holds a third of all rows is spread over
thousands of groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Size band: eight to an octave. Slot: 4096 to a band, from the md5 of the id.
_BAND = "case when size < 8 then size else length(bin(size)) * 8L + shiftright(size, length(bin(size)) - 4) end"
_SLOT = "substr(md5(cast({id} as string)), 1, 3)"
_OFFSET = " + ".join(
    f"(instr('0123456789abcdef', substr(md5(concat('{{seed}}', coalesce(source, ''))), {i}, 1)) - 1) / {16.0 ** i}D" for i in (1, 2, 3)
)


def targets(sizes: DataFrame, weights=(5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds weight and target to rows (source, source_size), one per source.

    Sources by code point, null last, take the weights in turn and share budget x all
    sizes; no target exceeds cap x its source's size. The shared level is the largest
    of (budget - caps below) / (weights from here on) in ascending order of cap per
    weight: below it a source is at its cap, above it its share is level x weight.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("_cap", cap * F.col("source_size"))
    up = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = budget * F.sum("source_size").over(everything)
    rows = rows.withColumn("_level", (total - before) / onward)
    level = F.max("_level").over(everything)
    return rows.withColumn("target", F.least("_cap", level * F.col("weight"))).drop("_cap", "_level")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(5, 2, 1),
    budget: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, copies, taken, and the columns in carry.

    size counts the words of the whole text; null or empty texts have size 0 and take
    nothing whatever their copies. A null source is a source of its own, the last one.
    A source without any words has target 0 and no copies. Rows with the same id are
    separate documents (ranked in any order, but each has its own step). An empty
    table gives an empty result. Other columns of docs are ignored.
    """
    sized = (
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *[F.col(c).alias(f"_c_{c}") for c in carry])
        .withColumn("_null", F.col("source").isNull())
        .withColumn("_key", F.coalesce("source", F.lit("")))
        .withColumn("_band", F.expr(_BAND))
        .withColumn("_slot", F.coalesce(F.expr(_SLOT.format(id="_id")), F.lit("")))
    )
    sized = written(sized, "sizes")  # words are counted once; what follows reads the columns it needs
    keys = ["_null", "_key", "_band", "_slot"]
    dealt = sized.repartition(*[F.col(k) for k in keys])
    groups = sized.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("size").alias("_words"))
    # per band first, so that no window holds more than the bands of a source or the slots of a band
    bands = groups.groupBy("_null", "_key", "_band").agg(F.sum("_n").alias("_bn"), F.sum("_words").alias("_bw"))
    sizes = bands.groupBy("_null", "_key").agg(F.sum("_bw").alias("source_size")).select(
        "_null", "_key", F.when(~F.col("_null"), F.col("_key")).alias("source"), "source_size"
    )
    shared = targets(sizes, weights, budget, cap).withColumn("_offset", F.expr(_OFFSET.format(seed=seed))).drop("source", "weight")
    by_band = Window.partitionBy("_null", "_key").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    by_slot = Window.partitionBy("_null", "_key", "_band").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("_b0", F.coalesce(F.sum("_bn").over(by_band), F.lit(0))).join(shared, ["_null", "_key"]).drop("_bn", "_bw")
    starts = (
        groups.withColumn("_s0", F.coalesce(F.sum("_n").over(by_slot), F.lit(0)))
        .join(bands, ["_null", "_key", "_band"])
        .select(*keys, (F.col("_b0") + F.col("_s0")).alias("_start"), "source_size", "target", "_offset")
    )
    ranked = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_id").asc_nulls_first(), "size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda k: F.floor(F.col("_offset") + rate * k)
    at = F.col("_start") + F.col("_rn")
    copies = F.least(upto(at) - upto(at - 1), F.ceil(rate)).cast("long")
    return (
        ranked.join(starts, keys)
        .withColumn("copies", copies)
        .select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"_c_{c}").alias(c) for c in carry])
    )


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The same in DuckDB: bands, slots and offsets by the same integer rules.
SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), k as (
  select *, case when size < 8 then size else length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)::int) end as band,
    substr(md5(doc_id::varchar), 1, 3) as slot from d
), s as (
  select source, sum(size)::bigint as source_size from k group by source
), w as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
    2.0::double * source_size as cap from s
), l as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as lvl from w
), t as (
  select source, source_size, least(cap, max(lvl) over () * weight) as target,
    (instr('0123456789abcdef', substr(md5('mix' || coalesce(source, '')), 1, 1)) - 1) / 16.0::double
    + (instr('0123456789abcdef', substr(md5('mix' || coalesce(source, '')), 2, 1)) - 1) / 256.0::double
    + (instr('0123456789abcdef', substr(md5('mix' || coalesce(source, '')), 3, 1)) - 1) / 4096.0::double as u from l
), r as (
  select k.doc_id, k.size, t.source_size, t.target, t.u, case when t.source_size > 0 then t.target / t.source_size else 0 end as c,
    row_number() over (partition by k.source order by band, slot, k.doc_id nulls first, k.size) as i
  from k join t on k.source is not distinct from t.source
)
select doc_id, size, source_size, target, (least(floor(u + c * i) - floor(u + c * (i - 1)), ceil(c)))::bigint * size as taken,
  (least(floor(u + c * i) - floor(u + c * (i - 1)), ceil(c)))::bigint as copies
from r
"""
