"""Helpers shared by the operators: reading tables, cutting lineage, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new one where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="touchline-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def whole_ids(df: DataFrame, id_col: str) -> Column:
    """The ids as longs. Operators whose results are smallest ids take whole numbers only: other ids would become null."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; whole numbers are needed")
    return F.col(id_col).cast("long")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives a lost executor, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes a table made by written() that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable over undirected edges (a, b): rows (id, component_id) for every id in an edge.

    Alternates large-star and small-star steps (each a shuffle by id, no group is
    gathered beyond a running minimum) until a round changes no link.
    A hub's star is a minimum over its rows, not a collected list.
    """
    cur = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    changed = cur.limit(1).count() > 0
    while changed:
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a node go to the smallest of its neighbourhood
        large = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        # small star: neighbours below a node, and the node, go to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        after = written(small, "edges")
        # both are sets of links: equal if as many, and none is in one only
        changed = after.count() != cur.count() or after.join(cur, ["a", "b"], "left_anti").limit(1).count() > 0
        drop_written(cur)
        cur = after
    return cur.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component_id")).unionByName(
        cur.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    )


def bounded_sample(rows: DataFrame, id_col: str, class_col: str, per_class: int) -> DataFrame:
    """Ids and classes of at most per_class rows of each class, those with the smallest md5 of their ids.

    Classes are counted, and of a large one only the ids below a bound on the md5 that about four times per_class of them are
    below are ranked: no class is gathered in one task. One count for each class comes to the driver.
    """
    each = rows.where(F.col(id_col).isNotNull() & F.col(class_col).isNotNull()).select(id_col, class_col).distinct()
    counts = {r[class_col]: r["count"] for r in each.groupBy(class_col).count().collect()}
    large = {c: 4.0 * per_class / n for c, n in counts.items() if n > 4 * per_class + 1000}
    md5 = F.md5(F.col(id_col).cast("string"))
    place = F.conv(F.substring(md5, 1, 8), 16, 10).cast("double") / float(1 << 32)
    if large:
        bound = F.create_map(*[F.lit(x) for pair in large.items() for x in pair])
        each = each.where(place < F.coalesce(bound[F.col(class_col)], F.lit(1.0)))
    first = Window.partitionBy(class_col).orderBy(md5, F.col(id_col))
    return each.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= per_class).drop("_rn")


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether the crc32 of the id as text is divisible by folds; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def pieces(texts, most: int = 6_000_000):
    """The texts in lists of no more than most characters, or of one longer text."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def groups(batches, keys: int):
    """Tables of the rows that agree in the first keys columns (whole numbers), from batches sorted by these columns."""
    import numpy as np
    import pyarrow as pa

    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[:, start].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, stop - start))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


class Sets:
    """Disjoint sets of 0 to n-1; merge() returns whether it joined two."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def merge(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def spread_join(rows: DataFrame, classes: DataFrame, keys: list[str], n_col: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to classes (unique by keys, n_col rows each): classes with a thousandth of all rows or more,
    of which there are no more than a thousand, are broadcast; the others are joined by shuffling."""
    large = F.col(n_col) >= max(1, total // 1000)
    hot = F.broadcast(classes.where(large).withColumn("_hot", F.lit(True)))
    rest = classes.where(~large).drop(n_col)
    marked = rows.join(hot.select(*keys, "_hot"), keys, "left")
    out = [c for c in rows.columns if c not in keys] + [c for c in rest.columns if c not in keys]
    return (
        marked.where("_hot").drop("_hot").join(hot.drop("_hot", n_col), keys).select(*keys, *out)
        .unionByName(marked.where("_hot is null").drop("_hot").join(rest, keys, how).select(*keys, *out))
    )
