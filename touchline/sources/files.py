"""Scans of match feeds: CSV and JSON files to canonical rows, and the registry that routes capabilities to them.

Files are read from a landing folder by Spark; nothing is fetched from executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.scalars import to_day, to_number, to_whole

#: Columns of statistics, in lower case, whatever they look like.
STATISTIC_COLUMNS = frozenset(
    "hs as hst ast hc ac hf af hy ay hr ar ho ao hhw ahw hbp abp fthg ftag ftr hthg htag htr sot shots shots_on_target possession corners fouls saves passes attendance referee date time div hometeam awayteam season xg xga xa".split()
)
#: Bookmakers, what a price may be of (after C for closing prices and Mx or Av for the largest or mean), words of prices, handicaps.
BOOKMAKERS = "b365|bw|iw|ps|p|wh|vc|gb|bs|so|sj|sy|sb|ls|lb|bf|bfe|bfc|bfd|avg|max|bb|1xb|bmgm|pin|bet365|betfair|cl"
PRICED = "ahh|ahca|ahch|aha|ah|ou|o|u|h|d|a"
WORDS = ("odds", "bookmaker", "betfair", "pinnacle", "bet365", "implied_prob", "market_price", "closing_price", "price_")
HANDICAPS = frozenset(("ah", "ahh", "ahch", "ahca", "bbah", "bbahh", "bbav", "bbmx"))
_ODDS = re.compile(rf"({BOOKMAKERS})(?=.)c?(mx|av)?({PRICED})?([<>]=?\d+(\.\d+)?)?")


#: Canonical names of statistics' columns.
MATCH_STATS = {"HS": "home_shots", "AS": "away_shots", "HST": "home_shots_on_target", "AST": "away_shots_on_target", "HC": "home_corners", "AC": "away_corners", "HF": "home_fouls", "AF": "away_fouls", "HY": "home_yellows", "AY": "away_yellows", "HR": "home_reds", "AR": "away_reds"}
#: Availability codes.
STATUS = {"a": "available", "d": "doubtful", "i": "injured", "s": "suspended", "u": "unavailable", "n": "unavailable"}


def is_odds(column: str) -> bool:
    """Whether a column's name has the shape of a price; known statistics never do."""
    name = column.strip().lower().replace(" ", "_")
    return name not in STATISTIC_COLUMNS and (name in HANDICAPS or name.startswith("pin_") or any(w in name for w in WORDS) or _ODDS.fullmatch(name) is not None)


def match_csv(spark: SparkSession, path, season_of_path: bool = False) -> DataFrame:
    """Results with statistics: odds columns aren't read on, rows without a date or a side go, played means both scores parse."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    raw = raw.select(*[F.col(f"`{c}`") for c in raw.columns if not is_odds(c)])
    text = lambda c: F.trim(F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    whole = lambda c: to_whole(text(c))
    day = to_day(text("Date"))
    time = F.when(text("Time").rlike(r"^\d{1,2}:\d{2}$"), text("Time"))
    rows = raw.select(
        day.alias("kickoff_date"), F.when(time.isNotNull(), F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), F.lpad(time, 5, "0")), F.lit("yyyy-MM-dd HH:mm"))).alias("kickoff_utc"), time.isNotNull().alias("kickoff_is_exact"),
        text("HomeTeam").alias("home"), text("AwayTeam").alias("away"), whole("FTHG").alias("ft_home_goals"), whole("FTAG").alias("ft_away_goals"), whole("HTHG").alias("ht_home_goals"), whole("HTAG").alias("ht_away_goals"),
        F.nullif(text("Referee"), F.lit("")).alias("referee"), *[whole(c).alias(a) for c, a in MATCH_STATS.items()],
        *([F.regexp_extract(F.input_file_name(), r"season-(\d{4})", 1).alias("season")] if season_of_path else []),
    )
    played = F.col("ft_home_goals").isNotNull() & F.col("ft_away_goals").isNotNull()
    return rows.where("kickoff_date is not null and home <> '' and away <> ''").withColumn("status", F.when(played, "played").otherwise("scheduled"))


def availability_json(spark: SparkSession, path) -> DataFrame:
    """elements joined to teams: status by code, chance as a share, observed when the news was added."""
    schema = "teams array<struct<id:bigint,name:string>>, elements array<struct<id:bigint,first_name:string,second_name:string,team:bigint,element_type:int,status:string,chance_of_playing_next_round:double,news:string,news_added:string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    teams = raw.select(F.explode("teams").alias("t")).select(F.col("t.id").alias("team"), F.col("t.name").alias("team_name"))
    people = raw.select(F.explode("elements").alias("e")).select("e.*")
    codes = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return people.join(teams, "team", "left").select(
        F.col("id").alias("player_id"), F.trim(F.concat_ws(" ", "first_name", "second_name")).alias("player"), "team_name", F.coalesce(F.element_at(codes, F.col("status")), F.lit("unknown")).alias("status"),
        (F.col("chance_of_playing_next_round") / 100).alias("chance_of_playing"), "news", F.try_to_timestamp("news_added").alias("observed_at"))


def fixtures_json(spark: SparkSession, path, teams: DataFrame) -> DataFrame:
    """Fixtures with both teams known and a kickoff; scores only of finished ones. teams: (team, team_name)."""
    raw = spark.read.schema("kickoff_time string, team_h bigint, team_a bigint, finished boolean, team_h_score int, team_a_score int, event int, id bigint").json(path, multiLine=True)
    side = lambda k, a: teams.select(F.col("team").alias(k), F.col("team_name").alias(a))
    done = F.coalesce("finished", F.lit(False))
    return raw.join(side("team_h", "home"), "team_h").join(side("team_a", "away"), "team_a").select("id", F.try_to_timestamp("kickoff_time").alias("kickoff_utc"), "home", "away", F.when(done, F.col("team_h_score")).alias("ft_home_goals"), F.when(done, F.col("team_a_score")).alias("ft_away_goals"), F.col("event").alias("round")).where("kickoff_utc is not null")


def results_json(spark: SparkSession, path) -> DataFrame:
    """matches[] with score {ft, ht}; a score of another shape counts as none."""
    raw = spark.read.schema("matches array<struct<date:string,time:string,round:string,team1:string,team2:string,score:string>>").json(path, multiLine=True)
    m = raw.select(F.explode("matches").alias("m")).select("m.*").withColumn("s", F.try_parse_json("score"))
    goal = lambda part, i: F.try_variant_get("s", f"$.{part}[{i}]", "int")
    return m.select(F.to_date("date").alias("kickoff_date"), "round", F.col("team1").alias("home"), F.col("team2").alias("away"), goal("ft", 0).alias("ft_home_goals"), goal("ft", 1).alias("ft_away_goals"), goal("ht", 0).alias("ht_home_goals"), goal("ht", 1).alias("ht_away_goals"),
                    F.when(F.col("time").rlike(r"^\d{1,2}:\d{2}"), F.try_to_timestamp(F.concat_ws(" ", "date", F.lpad(F.regexp_extract("time", r"^\d{1,2}:\d{2}", 0), 5, "0")), F.lit("yyyy-MM-dd HH:mm"))).alias("kickoff_utc"))


def player_csv(spark: SparkSession, path, teams: DataFrame) -> DataFrame:
    """Player rows of one file a round, all of which are read at once; opponent by team number."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    text = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    whole, real = lambda c: to_whole(text(c)), lambda c: to_number(text(c))
    rows = raw.select(whole("element").cast("long").alias("player_id"), text("name").alias("player"), F.coalesce(text("position"), F.lit("")).alias("position"), text("team").alias("team_name"), whole("opponent_team").cast("long").alias("opponent"), (F.lower(text("was_home")) == "true").alias("is_home"),
                      F.try_to_timestamp(text("kickoff_time")).alias("kickoff_utc"), *[whole(c).alias(a) for c, a in {"minutes": "minutes", "goals_scored": "goals", "assists": "assists", "tackles": "tackles", "saves": "saves", "yellow_cards": "yellows", "red_cards": "reds"}.items()],
                      real("expected_goals").alias("xg"), real("expected_assists").alias("xa"), F.when(whole("starts").isNotNull(), whole("starts") > 0).alias("started"), F.regexp_extract(F.input_file_name(), r"gw(\d+)", 1).cast("int").alias("round"))
    return rows.join(teams.select(F.col("team").alias("opponent"), F.col("team_name").alias("opponent_name")), "opponent", "left")


def weather_json(spark: SparkSession, path, kickoffs: DataFrame) -> DataFrame:
    """The hour nearest to each kickoff (match_id, kickoff_utc), the exact one where there is one."""
    raw = spark.read.schema("hourly struct<time:array<string>,temperature_2m:array<double>,relative_humidity_2m:array<double>,precipitation:array<double>,wind_speed_10m:array<double>>").json(path, multiLine=True)
    hours = raw.select(F.explode(F.arrays_zip(*[F.col(f"hourly.{c}").alias(c) for c in ("time", "temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m")])).alias("h")).select("h.*").withColumn("ts", F.try_to_timestamp("time"))
    near = kickoffs.withColumn("day", F.to_date("kickoff_utc")).join(hours.withColumn("day", F.explode(F.array(F.to_date("ts"), F.date_add(F.to_date("ts"), 1), F.date_sub(F.to_date("ts"), 1)))), "day")
    return near.groupBy("match_id").agg(F.min_by(F.struct("ts", "temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m"), F.struct(F.abs(F.unix_timestamp("ts") - F.unix_timestamp("kickoff_utc")), F.col("ts"))).alias("h")).select("match_id", "h.*")


def lag_days(rows: DataFrame, now) -> DataFrame:
    """Days from the newest kickoff to now, one row."""
    return rows.agg(F.datediff(F.to_date(F.lit(now).cast("timestamp")), F.max(F.to_date("kickoff_utc"))).alias("lag_days"))


@dataclass(frozen=True)
class Source:
    """What a feed provides; read(spark, path, ...) gives its rows."""

    key: str
    reliability: float
    capabilities: frozenset
    read: object


REGISTRY: dict[str, Source] = {}


def register(key: str, reliability: float, *capabilities: str, read=None) -> Source:
    REGISTRY[key] = Source(key, reliability, frozenset(capabilities), read)
    return REGISTRY[key]


def sources_for(capability: str) -> list[Source]:
    """Feeds that provide a capability, the most reliable first."""
    return sorted((s for s in REGISTRY.values() if capability in s.capabilities), key=lambda s: (-s.reliability, s.key))


register("publisher_csv", 0.90, "matches", "team_stats", read=match_csv)
register("mirror_csv", 0.85, "matches", "team_stats", read=match_csv)
register("results_json", 0.70, "matches", read=results_json)
register("fixtures_json", 0.80, "fixtures", read=fixtures_json)
register("availability_json", 0.80, "availability", read=availability_json)
register("player_csv", 0.80, "player_stats", read=player_csv)
register("weather_json", 0.75, "weather", read=weather_json)
