"""Entities and their records: squads, joins of player rows to matches, upserts, sources behind evidence, registered models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import written

#: The models of the ensemble and their weights where none are stored.
DEFAULT_WEIGHTS = {"dixon_coles": 0.3893, "elo": 0.3961, "logistic": 0.2147}
#: Player markets, and those for which there is never enough data.
PLAYER_MARKETS = {"player_to_score": "prob_scores", "player_two_plus_goals": "prob_two_plus", "player_to_assist": "prob_assists", "player_goal_involvement": "prob_involvement", "player_expected_minutes": "expected_minutes"}
WITHHELD = ("player_shots", "player_key_passes")


def squads(rows: DataFrame, as_of) -> DataFrame:
    """(player_id, team_id): the team of each player's newest row before the cutoff's day; ties to the smaller team."""
    known = rows.where(F.col("match_date") < F.to_date(F.lit(as_of).cast("timestamp")))
    return known.groupBy("player_id").agg(F.min_by("team_id", F.struct(-F.datediff("match_date", F.lit("1900-01-01").cast("date")), F.col("team_id"))).alias("team_id"))


def rows_to_matches(rows: DataFrame, matches: DataFrame, days: int = 1) -> DataFrame:
    """Player rows with the match of their team within days: the nearest, then the earlier, then the smaller id. Rows without one go."""
    sides = matches.select(F.col("id").alias("match_id"), F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), "kickoff_date")
    near = sides.withColumn("match_date", F.explode(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda i: F.date_add("kickoff_date", i))))  # an equi-join on (team, day)
    found = rows.join(near, ["team_id", "match_date"])
    by = F.struct(F.abs(F.datediff("kickoff_date", "match_date")), F.col("kickoff_date"), F.col("match_id"))
    return found.groupBy(*rows.columns).agg(F.min_by("match_id", by).alias("match_id"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row a key: a new row's values where it has them, the old row's otherwise; keys of either side stay."""
    both = old.select(*keys, *[F.col(v).alias(f"_o_{v}") for v in values]).join(new.select(*keys, *[F.col(v).alias(f"_n_{v}") for v in values]), keys, "full_outer")
    return both.select(*keys, *[F.coalesce(f"_n_{v}", f"_o_{v}").alias(v) for v in values])


def upgrade_kickoffs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Matches (id, kickoff_utc, kickoff_is_exact, status): an exact time replaces a mere date, never the other way; a status only moves to played."""
    n = new.select("id", F.col("kickoff_utc").alias("_k"), F.col("kickoff_is_exact").alias("_e"), F.col("status").alias("_s"))
    better = F.coalesce(F.col("_e"), F.lit(False)) & ~F.col("kickoff_is_exact")
    return old.join(n, "id", "left").select(
        "id", F.when(better, F.col("_k")).otherwise(F.col("kickoff_utc")).alias("kickoff_utc"), (F.col("kickoff_is_exact") | better).alias("kickoff_is_exact"),
        F.when(F.coalesce(F.col("_s") == "played", F.lit(False)), "played").otherwise(F.col("status")).alias("status"))


def numbered(rows: DataFrame, last: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with key: numbers on from last (one row, _last) in the order of columns that tell all rows apart.

    Rows are range-partitioned by the order; each part's rows are ranked where they are and start after all parts before it, of
    which only the counts meet in one task. No window holds all rows, however many are new.
    """
    parts = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = written(parts, "numbered")  # parts keep their rows for the count and the rank
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a part
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    r = dealt.withColumn("_rank", rank).join(F.broadcast(starts.select("_part", "_start")), "_part").join(F.broadcast(last))  # a row a part, one row
    return r.select((F.coalesce("_last", F.lit(0)) + F.col("_start") + F.col("_rank")).alias(key), *rows.columns)


def get_or_create(names: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    """known (key, name) and the new names, numbered on from the largest key in order of name."""
    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(known.select(name), name, "left_anti")
    made = numbered(fresh, known.agg(F.max(key).alias("_last")), key, [name])
    return known.select(key, name).unionByName(made.select(key, name))


def sources_behind(fixtures: DataFrame, history: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, source_id): the distinct sources of the statistics in both sides' history (team_id, id)."""
    evidence = history.select("team_id", F.col("id").alias("match_id"))
    used = candidates.select("match_id", "team_id", "source_id").join(evidence, ["match_id", "team_id"]).select("team_id", "source_id").distinct()
    sides = fixtures.select("id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    return sides.join(used, "team_id").select("id", "source_id").distinct()


def stored_weights(stored: DataFrame, competitions: DataFrame, version: str, least: int = 2, tie: str = "id") -> DataFrame:
    """(competition_id, model, weight, source): of each competition's stored rows (weights map, model_version, at, tie) of this version with least
    weights or more the newest; the default weights where there is none."""
    ok = stored.where((F.col("model_version") == version) & (F.size("weights") >= least))
    newest = ok.groupBy("competition_id").agg(F.max_by("weights", F.struct("at", tie)).alias("w"))
    default = F.create_map(*[F.lit(x) for pair in DEFAULT_WEIGHTS.items() for x in pair])
    r = competitions.join(newest, "competition_id", "left").select("competition_id", F.coalesce("w", default).alias("w"), F.when(F.col("w").isNull(), "default").otherwise("stored").alias("source"))
    return r.select("competition_id", "source", F.explode("w").alias("model", "weight"))


def player_markets(projections: DataFrame, confidence: float = 0.8) -> DataFrame:
    """(player_id, market, value, confidence, sufficient_data): every player's markets, and those that are always withheld."""
    cells = [F.struct(F.lit(m).alias("market"), F.col(c).cast("double").alias("value"), F.when(F.col("sufficient_data"), F.lit(confidence)).alias("confidence"), F.col("sufficient_data").alias("sufficient_data")) for m, c in PLAYER_MARKETS.items()]
    cells += [F.struct(F.lit(m).alias("market"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("sufficient_data")) for m in WITHHELD]
    return projections.select("player_id", F.inline(F.array(*cells)))


def top_players(rows: DataFrame, k: int = 14) -> DataFrame:
    """Each team's k players with the most expected goals and assists, then minutes, then the smaller id."""
    t = rows.groupBy("team_id", "player_id").agg(F.round(F.coalesce(F.sum("xg"), F.lit(0.0)) + F.coalesce(F.sum("xa"), F.lit(0.0)), 6).alias("xgi"), F.sum("minutes").alias("minutes"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("xgi"), F.desc_nulls_last("minutes"), "player_id"))).where(F.col("rank") <= k)


def reliability_bands(rows: DataFrame, width: float = 0.1, least: int = 40) -> DataFrame:
    """(model, band, n, predicted, observed) from rows (model, p, truth): bands of width with least rows or more."""
    r = rows.withColumn("band", F.floor(F.round(F.col("p") / width, 9)).cast("int")).groupBy("model", "band").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg(F.col("truth").cast("double")), 6).alias("observed"))
    return r.where(F.col("n") >= least)
