"""Names to teams: curated spellings, canonical names, learned aliases, plain names, close names, new teams.

Close names are found without meeting all names that share a word: at a closeness of t, two
names of mean length L match in t*L letters in no more than 4(1-t)L/2 + 1 runs, so
they share a number of their 3-grams that grows with L. It is enough to compare names that
share one of their rarest 3-grams, as many as that number leaves over.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import plain_name
from touchline.session import spread, written

from .entities import numbered

#: Clubs, and spellings of them that plain names can't reconcile. A table of others comes as a parameter.
CURATED = {
    "Manchester United": ("man united", "man utd", "manchester utd", "man u"),
    "Manchester City": ("man city",),
    "Tottenham Hotspur": ("tottenham", "spurs"),
    "Wolverhampton Wanderers": ("wolves", "wolverhampton"),
    "Nottingham Forest": ("nott m forest", "nottm forest", "nott forest"),
    "Newcastle United": ("newcastle", "newcastle utd"),
    "Brighton & Hove Albion": ("brighton", "brighton and hove albion"),
    "West Ham United": ("west ham", "west ham utd"),
    "Leeds United": ("leeds",),
    "Leicester City": ("leicester",),
    "Sheffield United": ("sheffield utd", "sheff united", "sheff utd"),
    "Sheffield Wednesday": ("sheffield weds", "sheff wed"),
    "West Bromwich Albion": ("west brom", "west bromwich"),
    "Queens Park Rangers": ("qpr",),
    "Bournemouth": (),
    "Stoke City": ("stoke",),
    "Hull City": ("hull",),
    "Cardiff City": ("cardiff",),
    "Swansea City": ("swansea",),
    "Norwich City": ("norwich",),
    "Ipswich Town": ("ipswich",),
    "Luton Town": ("luton",),
    "Birmingham City": ("birmingham",),
    "Derby County": ("derby",),
    "Middlesbrough": ("middlesboro",),
    "Atlético Madrid": ("ath madrid", "atl madrid", "atletico de madrid"),
    "Athletic Bilbao": ("ath bilbao", "athletic club"),
    "Real Betis": ("betis",),
    "Real Sociedad": ("sociedad",),
    "Celta Vigo": ("celta",),
    "Real Valladolid": ("valladolid",),
    "Deportivo Alavés": ("alaves",),
    "Espanyol": ("espanol", "rcd espanyol"),
    "Real Madrid": (),
    "Barcelona": (),
    "Rayo Vallecano": ("vallecano",),
    "Internazionale": ("inter", "inter milan"),
    "AC Milan": ("milan",),
    "AS Roma": ("roma",),
    "Hellas Verona": ("verona",),
    "Juventus": ("juve",),
    "Bayern Munich": ("bayern", "fc bayern munchen", "bayern munchen"),
    "Borussia Dortmund": ("dortmund", "bvb"),
    "Borussia Mönchengladbach": ("m gladbach", "mgladbach", "monchengladbach", "gladbach"),
    "Bayer Leverkusen": ("leverkusen",),
    "Eintracht Frankfurt": ("ein frankfurt", "frankfurt"),
    "RB Leipzig": ("leipzig",),
    "FC Köln": ("koln", "cologne", "1 fc koln"),
    "Hertha Berlin": ("hertha",),
    "Schalke 04": ("schalke",),
    "Werder Bremen": ("bremen",),
    "TSG Hoffenheim": ("hoffenheim",),
    "VfB Stuttgart": ("stuttgart",),
    "Mainz 05": ("mainz",),
    "Paris Saint-Germain": ("paris sg", "psg", "paris"),
    "Olympique Marseille": ("marseille", "om"),
    "Olympique Lyonnais": ("lyon", "ol"),
    "AS Monaco": ("monaco",),
    "Saint-Étienne": ("st etienne",),
    "Paris FC": (),
}


def curated_table(spark, spellings: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(alias, canonical), a row for each spelling and for the canonical name itself."""
    rows = [(a, c) for c, variants in (CURATED if spellings is None else spellings).items() for a in (c, *variants)]
    return spark.createDataFrame(rows, "alias string, canonical string")


def _grams(plain: Column) -> Column:
    """3-grams of a name, equal ones numbered so that they count as often as they occur."""
    raw = F.when(F.length(plain) >= 3, F.transform(F.sequence(F.lit(1), F.length(plain) - 2), lambda i: F.substring(plain, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return F.transform(raw, lambda g, i: F.concat(g, F.size(F.filter(F.slice(raw, 1, i + 1), lambda x: x == g)).cast("string")))


def close_pairs(names: DataFrame, known: DataFrame, least: float = 0.9, closer: DataFrame | None = None) -> DataFrame:
    """Candidates (plain, other) of distinct names (plain) and known (plain) that can be as close as least: 2 x matching letters over both
    lengths. None that is as close is missed for least of 0.9 or more; names up to four letters are close only if equal.

    Of a name of length n, the other's length m lies between n*least/(2-least) and n*(2-least)/least. Of both, no more than u = (1-least)(n+m) letters match
    nothing, a number as odd as n+m; the (n+m-u)/2 that match stand in u+1 runs, each with two 3-grams fewer than letters. Of the smallest such number
    c of shared 3-grams over all m follows: only the n-2-c+1 rarest ones of a name are looked up.

    closer (plain, least) tells of some names that a pair as close as that is known; of theirs, only pairs that can be as close as that are given.
    """
    if least < 0.9:
        raise ValueError("closeness below 0.9 isn't covered by shared 3-grams")
    every = written(names.select("plain").unionByName(known.select("plain")).distinct().where(F.length("plain") > 4).withColumn("g", F.explode(_grams(F.col("plain")))), "grams")
    often = every.groupBy("g").agg(F.count("*").alias("n"))
    n = F.length("plain")

    def needed(by: Column) -> Column:
        lengths = F.sequence(F.ceil(n * by / (2 - by) - 1e-9).cast("int"), F.floor(n * (2 - by) / by + 1e-9).cast("int"))

        def kept(m):
            most = F.floor((1 - by) * (n + m) + 1e-9)
            left = most - F.pmod(most - n - m, F.lit(2))
            return (n + m - left) / 2 - 2 * (left + 1)

        return F.greatest(F.array_min(F.transform(lengths, kept)).cast("int"), F.lit(1))

    rarest = Window.partitionBy("plain").orderBy("n", "g")
    ranked = written(every.join(often, "g").withColumn("_rn", F.row_number().over(rarest)).where(F.col("_rn") <= n - 2 - needed(F.lit(least)) + 1).select("plain", "g", "_rn"), "rarest-grams")
    mine = names.select("plain").distinct()
    if closer is None:
        mine = mine.join(ranked, "plain").withColumn("_by", F.lit(least))
    else:
        mine = mine.join(closer.select("plain", F.greatest(F.col("least") - 1e-9, F.lit(least)).alias("_by")), "plain", "left").fillna(least, ["_by"]).join(ranked, "plain").where(F.col("_rn") <= n - 2 - needed(F.col("_by")) + 1)
    other = known.select("plain").distinct().join(ranked.drop("_rn"), "plain").withColumnRenamed("plain", "other")
    fits = 2 * F.least(F.length("plain"), F.length("other")) >= F.col("_by") * (F.length("plain") + F.length("other"))
    return mine.join(other, "g").where(fits).select("plain", "other").distinct()


def first_pairs(names: DataFrame, known: DataFrame, each: int = 32) -> DataFrame:
    """Some pairs (plain, other) that are likely close: of the rarest 3-gram that a name shares with any known one, as many as each. They only say how close
    a name's closest at least is."""
    grams = lambda df: df.select("plain").distinct().where(F.length("plain") > 4).withColumn("g", F.explode(_grams(F.col("plain"))))
    other = written(grams(known), "known-grams")
    often = other.groupBy("g").agg(F.count("*").alias("n"))
    mine = grams(names).join(often, "g").withColumn("_rn", F.row_number().over(Window.partitionBy("plain").orderBy("n", "g"))).where("_rn = 1").select("plain", "g")
    some = other.withColumnRenamed("plain", "other")
    near = Window.partitionBy("plain").orderBy(F.levenshtein("plain", "other"), "other")
    return mine.join(some, "g").withColumn("_rn", F.row_number().over(near)).where(F.col("_rn") <= each).select("plain", "other")


def resolve(names: DataFrame, known: DataFrame, curated: DataFrame | None = None, learned: DataFrame | None = None, least: float = 0.9, create: bool = False) -> DataFrame:
    """(name, team_id, how) of distinct names: by the canonical name (a curated spelling stands for its canonical name), then a learned alias, then the
    plain name, then the closest plain name with a word in common; else a new team if create, else none.

    names (name), known (team_id, canonical), curated (alias, canonical), learned (alias, team_id). Names are compared plain, see
    plain_name. Blank names, and those of which nothing is left plain, resolve to nothing. Equal choices fall to the smallest id.
    New teams are numbered after all others, one for each plain name.
    """
    spark = names.sparkSession
    curated = curated_table(spark) if curated is None else curated
    learned = spark.createDataFrame([], "alias string, team_id long") if learned is None else learned
    plain = lambda c: plain_name(F.col(c)).alias("plain")
    spelled = curated.select(plain("alias"), "canonical").groupBy("plain").agg(F.min("canonical").alias("stands_for"))
    n = names.select(F.trim("name").alias("name")).where("name <> ''").distinct().withColumn("plain", plain_name(F.col("name"))).where("plain <> ''")
    n = n.join(spelled, "plain", "left").withColumn("canonical", F.coalesce("stands_for", "name")).withColumn("canonical_plain", plain_name(F.col("canonical")))
    k = known.select("team_id", "canonical", plain("canonical"))
    aliases = learned.select(plain("alias"), "team_id").groupBy("plain").agg(F.min("team_id").alias("id"))
    by = lambda df, on, to: df.select(F.col("plain").alias(on), F.col("id").alias(to))
    r = n.join(k.groupBy("canonical").agg(F.min("team_id").alias("exact_id")), "canonical", "left")
    r = r.join(by(aliases, "plain", "alias_id"), "plain", "left").join(by(aliases, "canonical_plain", "alias2_id"), "canonical_plain", "left")
    r = r.join(by(k.groupBy("plain").agg(F.min("team_id").alias("id")), "canonical_plain", "plain_id"), "canonical_plain", "left")
    sure = F.coalesce("exact_id", "alias_id", "alias2_id", "plain_id")
    rest = r.where(sure.isNull()).select(F.col("canonical_plain").alias("plain")).distinct()
    spellings = k.select("plain", F.col("team_id").alias("id")).unionByName(aliases).groupBy("plain").agg(F.min("id").alias("id"))

    @F.pandas_udf("double")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    word = F.arrays_overlap(F.split("plain", " "), F.split("other", " "))
    rest, spellings = written(rest, "names"), written(spellings, "spellings")
    closer = spread(first_pairs(rest, spellings, 4), "plain", "other").withColumn("ratio", close("plain", "other")).groupBy("plain").agg(F.max("ratio").alias("least"))
    scored = spread(close_pairs(rest, spellings, least, written(closer, "closer")), "plain", "other").withColumn("ratio", close("plain", "other")).where(F.col("ratio") >= least).join(spellings.select(F.col("plain").alias("other"), "id"), "other")
    best = scored.groupBy("plain").agg(F.max_by(F.struct("id", word.alias("word")), F.struct("ratio", -F.col("id"))).alias("b")).where("b.word").select(F.col("plain").alias("canonical_plain"), F.col("b.id").alias("fuzzy_id"))
    r = r.join(best, "canonical_plain", "left")
    how = F.when(F.col("exact_id").isNotNull(), F.when(F.col("canonical") == F.col("name"), "exact").when(F.col("plain") == F.col("canonical_plain"), "plain").otherwise("curated")).when(F.coalesce("alias_id", "alias2_id").isNotNull(), "alias").when(F.col("plain_id").isNotNull(), "plain").when(F.col("fuzzy_id").isNotNull(), "close").otherwise("none")
    out = r.select("name", F.coalesce(sure, F.col("fuzzy_id")).alias("team_id"), how.alias("how"), "canonical_plain")
    if not create:
        return out.drop("canonical_plain")
    new = numbered(out.where("how = 'none'").select("canonical_plain").distinct(), known.agg(F.max("team_id").alias("_last")), "new_id", ["canonical_plain"])
    return out.join(new, "canonical_plain", "left").select("name", F.coalesce("team_id", "new_id").alias("team_id"), F.when(F.col("how") == "none", "created").otherwise(F.col("how")).alias("how"))


def learn(resolved: DataFrame, learned: DataFrame) -> DataFrame:
    """(alias, team_id): the learned aliases and the plain names that a batch resolved; an alias that is known stays as it is."""
    new = resolved.where("team_id is not null").select(plain_name(F.col("name")).alias("alias"), "team_id").groupBy("alias").agg(F.min("team_id").alias("team_id"))
    old = learned.select(plain_name(F.col("alias")).alias("alias"), "team_id").groupBy("alias").agg(F.min("team_id").alias("team_id"))
    return old.unionByName(new.join(old.select("alias"), "alias", "left_anti"))
