"""Merging sources: near-date matching, conflicts, gap filling by reliability."""


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def near_date(rows: DataFrame, matches: DataFrame, days: int = 1, keys: tuple[str, ...] = ("competition_id", "home_team_id", "away_team_id")) -> DataFrame:
    """Each row's match with equal keys within days of it: the same day first, then the earlier, then the smaller id.

    The interval is an equi-join: every match stands under each day that it may meet.
    """
    spread = matches.select(*keys, F.col("id").alias("match_id"), "kickoff_date", F.explode(F.sequence(F.date_sub("kickoff_date", days), F.date_add("kickoff_date", days))).alias("day"))
    found = rows.join(spread, [*keys, "day"], "left")
    first = Window.partitionBy("row_id").orderBy(F.abs(F.datediff("kickoff_date", "day")).asc_nulls_last(), "kickoff_date", "match_id")
    return found.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def merge(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """old and new rows (key, reliability, fields) as one: gaps are always filled, other values replaced only by a source as
    reliable or more; conflicts lists the fields on which the two disagree."""
    a, b = old.select(key, *[F.col(c).alias(f"o_{c}") for c in ("reliability", *fields)]), new.select(key, *[F.col(c).alias(f"n_{c}") for c in ("reliability", *fields)])
    j = a.join(b, key, "full")
    may = F.coalesce(F.col("n_reliability") >= F.col("o_reliability"), F.col("o_reliability").isNull())
    value = lambda c: F.when(F.col(f"o_{c}").isNull() | (may & F.col(f"n_{c}").isNotNull()), F.coalesce(f"n_{c}", f"o_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
    clash = F.concat_ws(",", *[F.when(F.col(f"o_{c}") != F.col(f"n_{c}"), c) for c in fields])
    return j.select(key, *[value(c) for c in fields], F.when(may & F.col("n_reliability").isNotNull(), F.col("n_reliability")).otherwise(F.col("o_reliability")).alias("reliability"), clash.alias("conflicts"))


def latest_rows(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """An upsert sink's dedupe: the last row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def requested_fixtures(requests: DataFrame, matches: DataFrame, days: int = 2, hour: int = 15) -> tuple[DataFrame, DataFrame]:
    """(answers, placeholders) of requests (row_id, competition_id, home_team_id, away_team_id, day): each request's match within days of it, as near_date
    chooses; where there is none, a placeholder match that all requests of one fixture and day share, numbered after all matches.

    answers (row_id, match_id, placeholder); placeholders (id, competition_id, home_team_id, away_team_id, kickoff_date, kickoff_utc, kickoff_is_exact, status),
    scheduled at an hour that isn't exact. Requests without two different teams have neither.
    """
    from .entities import numbered

    keys = ["competition_id", "home_team_id", "away_team_id"]
    asked = requests.where("home_team_id <> away_team_id")
    found = near_date(asked, matches, days).select("row_id", *keys, "day", "match_id")
    lacking = found.where("match_id is null").select(*keys, "day").distinct()
    made = numbered(lacking, matches.agg(F.max("id").alias("_last")), "id", [*keys, "day"])
    answers = found.join(made.withColumnRenamed("id", "new_id"), [*keys, "day"], "left").select("row_id", F.coalesce("match_id", "new_id").alias("match_id"), F.col("match_id").isNull().alias("placeholder"))
    at = F.col("day").cast("timestamp") + F.make_interval(hours=F.lit(hour))
    return answers, made.select("id", *keys, F.col("day").alias("kickoff_date"), at.alias("kickoff_utc"), F.lit(False).alias("kickoff_is_exact"), F.lit("scheduled").alias("status"))
