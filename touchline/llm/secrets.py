"""Secret scans [native]: patterns, and two character Markov models compared by log-likelihood ratio.

Three patterns find keys by their context or shape. Beyond them, every run of key
characters of a minimum length is scored: the sum over its pairs of neighbouring
characters of log P(next | previous) under a model of random strings less that under
a model of ordinary identifiers. Both models are pair counts of labelled samples,
smoothed, with weights rounded to thousandths so that sums are exact everywhere.

All of it is Spark expressions. Matches are located by marking them in the text with
two private-use characters and adding up the lengths of what lies between the marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order of their kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Runs that the models judge, and their characters.
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
OPEN, CLOSE = "\ue000", "\ue001"

_SPAN = "struct<start:int,ord:int,end:int,kind:string>"


def pair_counts(samples: DataFrame) -> DataFrame:
    """Rows (random, a, b, n) from samples (text, random boolean): counts of neighbouring key characters."""
    chars = samples.select("random", F.split("text", "").alias("c")).where("random is not null")
    pairs = chars.select("random", F.explode(F.arrays_zip(F.col("c").alias("a"), F.expr("slice(c, 2, 1 << 30)").alias("b"))).alias("p"))
    pairs = pairs.select("random", F.col("p.a").alias("x"), F.col("p.b").alias("y")).where("x <> '' and y <> ''")
    return pairs.groupBy("random", "x", "y").agg(F.count("*").alias("n")).select("random", F.instr(F.lit(ALPHABET), F.col("x")).alias("a"), F.instr(F.lit(ALPHABET), F.col("y")).alias("b"), "n").where((F.col("a") > 0) & (F.col("b") > 0))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[int]:
    """Weights in thousandths, row by row of ALPHABET squared. What is collected is bounded by 2 x 67 x 67 counts."""
    k = len(ALPHABET)
    counts = pair_counts(samples)
    grid = counts.sparkSession.range(2 * k * k).select(
        (F.col("id") % 2 == 1).alias("random"), (F.floor(F.col("id") / (2 * k)) + 1).cast("int").alias("a"), (F.floor(F.col("id") / 2) % k + 1).cast("int").alias("b")
    )
    totals = counts.groupBy("random", "a").agg(F.sum("n").alias("t"))
    logs = (
        grid.join(counts, ["random", "a", "b"], "left")
        .join(totals, ["random", "a"], "left")
        .select("random", "a", "b", F.log((F.coalesce("n", F.lit(0)) + smoothing) / (F.coalesce("t", F.lit(0)) + smoothing * k)).alias("p"))
    )
    weight = F.round(1000 * F.sum(F.when(F.col("random"), F.col("p")).otherwise(-F.col("p")))).cast("int")
    return [r.w for r in logs.groupBy("a", "b").agg(weight.alias("w")).orderBy("a", "b").collect()]


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000, random_strings: int = 2000) -> DataFrame:
    """Samples (text, random): hashes in four spellings, and the words of sample_docs documents taken by the md5 of their ids.

    Words that a base pattern matches, or with an equals sign or colon, aren't taken as
    ordinary identifiers. Both bounds are parameters of the fit; the scan covers all rows.
    """
    spark = docs.sparkSession
    base64 = F.expr("rtrim('=', base64(unhex(sha2(cast(id as string), 256))))")
    spelled = F.array(base64, F.translate(base64, "+/", "-_"), F.lower(base64), F.upper(base64))
    random = spark.range(random_strings).select(F.explode(spelled).alias("text"), F.lit(True).alias("random"))
    picked = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().orderBy(F.md5(F.col("_id").cast("string"))).limit(sample_docs)
    words = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(picked, "_id", "left_semi")
        .select(F.explode(F.split("_text", r"[\x20\x09-\x0D]+")).alias("text"))
        .where(~F.col("text").rlike(ACCESS) & ~F.col("text").rlike(HEX) & ~F.col("text").rlike("[=:]"))
    )
    return random.unionByName(words.select("text", F.lit(False).alias("random")))


def _spans(marked: str, kind: str, keep: str) -> Column:
    """The spans of the marked matches m for which keep holds, as an array in order."""
    split = f"split({marked}, '{OPEN}')"
    span = f"named_struct('start', a.pos, 'ord', {KINDS.index(kind)}, 'end', a.pos + instr(p, '{CLOSE}') - 1, 'kind', '{kind}')"
    return F.expr(
        f"""if(instr({marked}, '{OPEN}') > 0,
        aggregate(slice({split}, 2, 1 << 30),
          named_struct('pos', length(element_at({split}, 1)), 'out', cast(array() as array<{_SPAN}>)),
          (a, p) -> named_struct('pos', a.pos + length(p) - 1, 'out', if({keep.format(m=f"substring_index(p, '{CLOSE}', 1)")}, array_append(a.out, {span}), a.out)),
          a -> a.out),
        cast(array() as array<{_SPAN}>))"""
    )


def _ratio(weights: list[int]) -> str:
    """The log-likelihood ratio of {m} in thousandths: one pass over its characters."""
    k = len(ALPHABET)
    table = "array(" + ",".join(map(str, weights)) + ")"
    return (
        "aggregate(split({m}, ''), named_struct('at', 0, 'sum', 0L), (s, c) -> if(c = '', s, named_struct("
        f"'at', instr('{ALPHABET}', c), 'sum', if(s.at = 0, 0L, s.sum + element_at({table}, (s.at - 1) * {k} + instr('{ALPHABET}', c))))), s -> s.sum)"
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def scan(docs: DataFrame, weights: list[int], id_col: str = "doc_id", text_col: str = "text", min_length: int = 20, threshold: float = 15.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id_col, base (spans by pattern), found (all spans), and the columns in carry.

    A span is (start, ord, end, kind): code points, end exclusive; ordered by start, then
    kind. found holds base and the runs of kind random: those of min_length or more
    whose ratio is above threshold nats and that no base span touches. Null texts count
    as empty and have no spans. The two marks themselves, where a text holds them, are
    read as ~, which no pattern takes. Repeated rows and null ids give a row each; other
    columns are ignored; there is no shuffle.
    """
    kept = [F.col(c).alias(f"_c_{c}") for c in carry]
    rows = docs.select(F.col(id_col).alias("_id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), OPEN + CLOSE, "~~").alias("_t"), *kept)
    mark = lambda pattern: F.regexp_replace("_t", pattern, f"{OPEN}$0{CLOSE}")
    rows = rows.withColumns({"_m0": mark(ASSIGN), "_m1": mark(ACCESS), "_m2": mark(HEX), "_m3": mark(RUN % min_length)}).drop("_t")
    value = "regexp_extract({m}, '" + ASSIGN.replace("\\", "\\\\").replace("'", "\\'") + "', 1)"
    rows = rows.select(
        "_id",
        F.array_sort(F.concat(_spans("_m0", "assign", f"length({value}) >= 6"), _spans("_m1", "access", "true"), _spans("_m2", "hex", "true"))).alias("base"),
        _spans("_m3", "random", f"{_ratio(weights)} > {round(1000 * threshold)}").alias("_random"),
        *[F.col(f"_c_{c}") for c in carry],
    )
    alone = F.filter("_random", lambda r: ~F.exists("base", lambda b: (b.start < r.end) & (r.start < b.end)))
    return rows.select(F.col("_id").alias(id_col), "base", F.array_sort(F.concat("base", alone)).alias("found"), *[F.col(f"_c_{c}").alias(c) for c in carry])


def redact(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with each stretch of touching or overlapping spans replaced by mask."""
    parts = F.aggregate(
        found,
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda a, s: F.when(s.end <= a.pos, a).otherwise(
            F.struct(
                s.end.alias("pos"),
                F.when((s.start <= a.pos) & (a.pos > 0), a.out).otherwise(F.concat(a.out, F.substring(text, a.pos + 1, s.start - a.pos), F.lit(mask))).alias("out"),
            )
        ),
    )
    return F.when(F.size(found) > 0, F.concat(parts.out, F.substring(text, parts.pos + 1, F.lit(2**31 - 1)))).otherwise(text)


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    rows = scan(docs, train(labelled_samples(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def _sql() -> str:
    quoted = lambda s: s.replace("'", "''")
    split = lambda pattern, kind: f"select doc, '{kind}' as kind, {KINDS.index(kind)} as ord, unnest(string_split(regexp_replace(t, '{quoted(pattern)}', chr(57344) || '\\0' || chr(57345), 'g'), chr(57344))) as p, generate_subscripts(string_split(regexp_replace(t, '{quoted(pattern)}', chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)), 1) as i from d"
    k = len(ALPHABET)
    return f"""
with d as (
  select row_number() over () as doc, doc_id, translate(coalesce(text, ''), chr(57344) || chr(57345), '~~') as t from documents
), p as (
  {split(ASSIGN, "assign")} union all {split(ACCESS, "access")} union all {split(HEX, "hex")} union all {split(RUN % 20, "random")}
), q as (
  select doc, kind, ord, i, split_part(p, chr(57345), 1) as m,
    coalesce(sum(length(p) - case when i > 1 then 1 else 0 end) over (partition by doc, kind order by i rows between unbounded preceding and 1 preceding), 0)::bigint as s from p
), r as (
  select doc, kind, ord, s, s + length(m) as e, m from q
  where i > 1 and (kind <> 'assign' or length(regexp_extract(m, '{quoted(ASSIGN)}', 1)) >= 6)
), picked as (
  select doc_id from documents where doc_id is not null group by doc_id order by md5(doc_id::varchar) limit 2000
), b64 as (
  select rtrim(to_base64(unhex(sha256(i::varchar))), '=') as x from range(2000) as t(i)
), samples as (
  select unnest([x, translate(x, '+/', '-_'), lower(x), upper(x)]) as w, true as random from b64
  union all
  select w, false from (select unnest(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')) as w from documents where doc_id in (select doc_id from picked))
  where not regexp_matches(w, '{ACCESS}') and not regexp_matches(w, '{HEX}') and not regexp_matches(w, '[=:]')
), pairs as (
  select random, instr('{ALPHABET}', substr(w, i, 1)) as a, instr('{ALPHABET}', substr(w, i + 1, 1)) as b, count(*) as n
  from (select random, w, unnest(range(1, length(w))) as i from samples) group by 1, 2, 3
), counts as (
  select * from pairs where a > 0 and b > 0
), totals as (
  select random, a, sum(n) as t from counts group by 1, 2
), logs as (
  select x.random, x.a, x.b, ln((coalesce(n, 0) + 0.5::double) / (coalesce(t, 0) + 0.5::double * {k})) as p
  from (select unnest([true, false]) as random, a.i as a, b.i as b from range(1, {k + 1}) as a(i), range(1, {k + 1}) as b(i)) as x
  left join counts c on c.random = x.random and c.a = x.a and c.b = x.b
  left join totals t on t.random = x.random and t.a = x.a
), weights as (
  select a, b, round(1000 * sum(case when random then p else -p end))::bigint as w from logs group by 1, 2
), runs as (
  select distinct m from r where kind = 'random'
), scored as (
  select m from (select m, unnest(range(1, length(m))) as i from runs) x
  join weights on a = instr('{ALPHABET}', substr(m, i, 1)) and b = instr('{ALPHABET}', substr(m, i + 1, 1))
  group by m having sum(w) > 15000
), f as (
  select * from r where kind <> 'random'
  union all
  select r.* from r where kind = 'random' and m in (select m from scored)
    and not exists (select 1 from r as o where o.doc = r.doc and o.kind <> 'random' and o.s < r.e and r.s < o.e)
), g as (
  select doc, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) filter (kind <> 'random') as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) as spans
  from f group by doc
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc)
"""


SQL = _sql()
