"""Form, splits, rates, schedule, opponent adjustment, standings, head to head and league baselines.

Everything is conditional aggregation over one ranked team view: one shuffle by team
serves all windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import half_life

from .asof import PER_MATCH, AsOf

WINDOWS = {"last5": 5, "last10": 10, "last20": 20, "all": 80}
HISTORY = 80
#: The 23 features, in the order that models expect.
FEATURES = (
    "home_gf_10", "home_ga_10", "away_gf_10", "away_ga_10", "home_gf_home", "home_ga_home", "away_gf_away", "away_ga_away",
    "home_sot_10", "away_sot_10", "home_sot_against_10", "away_sot_against_10", "home_ppg_5", "away_ppg_5", "home_ppg_all", "away_ppg_all",
    "home_attack_index", "away_attack_index", "home_defence_index", "away_defence_index", "home_rest_advantage_days", "congestion_difference", "position_difference",
)


def _long(wide: DataFrame, keys: list[str], names: dict[str, tuple], columns: tuple[str, ...]) -> DataFrame:
    """names: label -> one column of wide for each of columns."""
    cells = [F.struct(*[F.lit(x).alias(k) for k, x in zip(("scope", "stat"), label, strict=True)], *[F.col(c).alias(a) for a, c in zip(columns, cols, strict=True)]) for label, cols in names.items()]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def window_means(history: DataFrame, stats=PER_MATCH) -> DataFrame:
    """(team_id, scope, stat, value, n): means over the newest 5, 10, 20 and 80 rows."""
    aggs, names = [], {}
    for w, size in WINDOWS.items():
        for s in stats:
            inside = F.when(F.col("rn") <= size, F.col(s))
            aggs += [F.round(F.avg(inside), 6).alias(f"v_{w}_{s}"), F.count(inside).alias(f"n_{w}_{s}")]
            names[w, s] = (f"v_{w}_{s}", f"n_{w}_{s}")
    return _long(history.groupBy("team_id").agg(*aggs), ["team_id"], names, ("value", "n"))


def decayed_means(history: DataFrame, as_of, days: float = 90.0, stats=PER_MATCH) -> DataFrame:
    """(team_id, stat, value, n, effective_n): means weighted by half-lives of age."""
    rows = history.withColumn("w", half_life(F.datediff(F.to_date(F.lit(as_of).cast("timestamp")), "kickoff_date"), days))
    aggs, names = [], {}
    for s in stats:
        w = F.sum(F.when(F.col(s).isNotNull(), F.col("w")))
        aggs += [F.round(F.sum(F.col(s) * F.col("w")) / F.nullif(w, F.lit(0.0)), 6).alias(f"v_{s}"), F.count(s).alias(f"n_{s}"), F.round(F.coalesce(w, F.lit(0.0)), 6).alias(f"e_{s}")]
        names["decayed", s] = (f"v_{s}", f"n_{s}", f"e_{s}")
    return _long(rows.groupBy("team_id").agg(*aggs), ["team_id"], names, ("value", "n", "effective_n")).drop("scope")


def venue_splits(history: DataFrame, stats=(*PER_MATCH, "points")) -> DataFrame:
    aggs, names = [], {}
    for venue, is_home in (("home", True), ("away", False)):
        for s in stats:
            inside = F.when(F.col("is_home") == is_home, F.col(s))
            aggs += [F.round(F.avg(inside), 6).alias(f"v_{venue}_{s}"), F.count(inside).alias(f"n_{venue}_{s}")]
            names[venue, s] = (f"v_{venue}_{s}", f"n_{venue}_{s}")
    return _long(history.groupBy("team_id").agg(*aggs), ["team_id"], names, ("value", "n"))


def rate(condition, known):
    return F.round(F.avg(F.when(known, condition.cast("double"))), 6)


def outcome_rates(history: DataFrame) -> DataFrame:
    gf, ga = F.col("goals_for"), F.col("goals_against")
    both = gf.isNotNull() & ga.isNotNull()
    return history.groupBy("team_id").agg(
        rate(ga == 0, ga.isNotNull()).alias("clean_sheet_rate"), rate(gf > 0, gf.isNotNull()).alias("scoring_rate"), rate(ga > 0, ga.isNotNull()).alias("conceding_rate"),
        rate((gf > 0) & (ga > 0), both).alias("btts_rate"), F.count(F.when(both, 1)).alias("n"),
    )


def form_points(history: DataFrame) -> DataFrame:
    """Points per game by window, the trend, first-half share, rest and congestion need as_of: see schedule()."""
    p = {w: F.round(F.avg(F.when(F.col("rn") <= size, F.col("points"))), 3) for w, size in WINDOWS.items()}
    halves = F.col("ht_goals_for").isNotNull() & (F.col("goals_for") > 0)
    return history.groupBy("team_id").agg(*[v.alias(f"ppg_{w}") for w, v in p.items()], F.round(F.sum(F.when(halves, F.col("ht_goals_for"))) / F.sum(F.when(halves, F.col("goals_for"))), 3).alias("first_half_share")).withColumn("trend", F.round(F.col("ppg_last5") - F.col("ppg_all"), 3))


def schedule(history: DataFrame, as_of) -> DataFrame:
    age = F.datediff(F.to_date(F.lit(as_of).cast("timestamp")), "kickoff_date")
    return history.groupBy("team_id").agg(F.min(age).alias("rest_days"), F.count(F.when(age <= 14, 1)).alias("matches_last_14_days"), F.max("kickoff_date").alias("last_date"))


def opponent_adjusted(history: DataFrame, window: int = 20, opponent_window: int = 30, baseline: float = 1.35) -> DataFrame:
    """Goals for and against relative to what the opponents allowed and scored before each match.

    An opponent's earlier matches come from its newest opponent_window rows at the cutoff;
    five or more are needed, with a mean above 0.05.
    """
    rows = history.where((F.col("rn") <= window) & F.col("goals_for").isNotNull() & F.col("goals_against").isNotNull()).select("team_id", "id", "opponent_id", "kickoff_date", "goals_for", "goals_against")
    past = history.where(F.col("rn") <= opponent_window).select(F.col("team_id").alias("opponent_id"), F.col("kickoff_date").alias("d"), F.col("goals_for").alias("gf"), F.col("goals_against").alias("ga"))
    each = rows.join(past, (rows.opponent_id == past.opponent_id) & (past.d < rows.kickoff_date)).groupBy("team_id", "id").agg(
        F.first("goals_for").alias("goals_for"), F.first("goals_against").alias("goals_against"), F.count("ga").alias("nc"), F.avg("ga").alias("conceded"), F.count("gf").alias("ns"), F.avg("gf").alias("scored"))
    attack = F.when((F.col("nc") >= 5) & (F.col("conceded") > 0.05), F.col("goals_for") / F.col("conceded"))
    defence = F.when((F.col("ns") >= 5) & (F.col("scored") > 0.05), F.col("goals_against") / F.col("scored"))
    return each.groupBy("team_id").agg(
        F.round(F.avg(attack), 3).alias("attack_index"), F.round(F.avg(attack) * baseline, 3).alias("adjusted_goals_for"), F.count(attack).alias("attack_sample"),
        F.round(F.avg(defence), 3).alias("defence_index"), F.round(F.avg(defence) * baseline, 3).alias("adjusted_goals_against"), F.count(defence).alias("defence_sample"),
    ).where("attack_sample > 0 or defence_sample > 0")


def league_table(rows: DataFrame) -> DataFrame:
    """Standings of each competition: points, goal difference, goals; then whose newest match came first in the list."""
    r = rows.where(F.col("goals_for").isNotNull() & F.col("goals_against").isNotNull())
    won, drawn = F.count(F.when(F.col("points") == 3, 1)), F.count(F.when(F.col("points") == 1, 1))
    table = r.groupBy("competition_id", "team_id").agg(
        F.count("*").alias("played"), won.alias("won"), drawn.alias("drawn"), F.count(F.when(F.col("points") == 0, 1)).alias("lost"),
        F.sum("goals_for").alias("gf"), F.sum("goals_against").alias("ga"), F.sum("points").alias("points"), F.max(F.struct("kickoff_date", "id", "is_home")).alias("_last"))
    gd = F.col("gf") - F.col("ga")
    order = Window.partitionBy("competition_id").orderBy(F.desc("points"), gd.desc(), F.desc("gf"), F.desc("_last"))
    return table.withColumn("goal_difference", gd).withColumn("ppg", F.round(F.col("points") / F.col("played"), 3)).withColumn("position", F.row_number().over(order)).drop("_last")


def head_to_head(as_of: AsOf, limit: int = 12, listed: int = 6) -> DataFrame:
    """Summary of each ordered pair's newest meetings, from the first team's side."""
    rows = as_of.head_to_head(limit).where(F.col("goals_for").isNotNull() & F.col("goals_against").isNotNull())
    score = F.concat_ws("-", F.col("goals_for").cast("string"), F.col("goals_against").cast("string"))
    return rows.groupBy("team_id", "opponent_id").agg(
        F.count("*").alias("matches"), F.count(F.when(F.col("points") == 3, 1)).alias("wins"), F.count(F.when(F.col("points") == 1, 1)).alias("draws"), F.count(F.when(F.col("points") == 0, 1)).alias("losses"),
        F.round(F.avg("goals_for"), 2).alias("avg_goals_for"), F.round(F.avg("goals_against"), 2).alias("avg_goals_against"), F.round(F.avg(F.col("goals_for") + F.col("goals_against")), 2).alias("avg_total_goals"),
        F.count(F.when(F.col("is_home"), 1)).alias("at_this_venue"), F.max("kickoff_date").alias("most_recent"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("meeting", score.alias("score")))), 1, listed), lambda x: x.score), ",").alias("scores"),
    )


def league_baseline(as_of: AsOf, since, newest_rows: int = 400) -> DataFrame:
    """Averages and outcome shares of each competition; corners and cards over its newest matches only."""
    m = as_of.completed(since=since)
    s = as_of.stats().select(F.col("match_id").alias("id"), "team_id", "corners", "yellows", "reds")
    pair = m.join(s.select("id", F.col("team_id").alias("home_team_id"), *[F.col(c).alias(f"h_{c}") for c in ("corners", "yellows", "reds")]), ["id", "home_team_id"], "left").join(
        s.select("id", F.col("team_id").alias("away_team_id"), *[F.col(c).alias(f"a_{c}") for c in ("corners", "yellows", "reds")]), ["id", "away_team_id"], "left")
    pair = pair.withColumn("rn", F.row_number().over(Window.partitionBy("competition_id").orderBy(F.desc("kickoff_date"), F.desc("id"))))
    recent = F.col("rn") <= newest_rows
    corners = F.when(recent, F.col("h_corners") + F.col("a_corners"))
    cards = F.when(recent & F.col("h_yellows").isNotNull() & F.col("a_yellows").isNotNull(), F.col("h_yellows") + F.col("a_yellows") + F.coalesce("h_reds", F.lit(0)) + F.coalesce("a_reds", F.lit(0)))
    h, a = F.col("ft_home_goals"), F.col("ft_away_goals")
    return pair.groupBy("competition_id").agg(
        F.count(h).alias("matches"), F.round(F.avg(h), 3).alias("avg_home_goals"), F.round(F.avg(a), 3).alias("avg_away_goals"), F.round((F.sum(h) + F.sum(a)) / F.count(h), 3).alias("avg_total_goals"),
        F.round(F.avg((h > a).cast("double")), 3).alias("home_win_rate"), F.round(F.avg((h == a).cast("double")), 3).alias("draw_rate"), F.round(F.avg((h < a).cast("double")), 3).alias("away_win_rate"),
        F.round(F.avg(corners), 3).alias("avg_total_corners"), F.count(corners).alias("corner_sample"), F.round(F.avg(cards), 3).alias("avg_total_cards"), F.count(cards).alias("card_sample"),
    )


def absent_last_season(rows: DataFrame, season_start) -> DataFrame:
    """Teams of this season's rows that had none in the season before; none at all if that season is empty."""
    start = F.lit(season_start).cast("date")
    now = rows.where(F.col("kickoff_date") >= start).select("competition_id", "team_id").distinct()
    before = rows.where((F.col("kickoff_date") < start) & (F.col("kickoff_date") >= F.add_months(start, -12))).select("competition_id", "team_id").distinct()
    return now.join(before, ["competition_id", "team_id"], "left_anti").join(before.select("competition_id").distinct(), "competition_id", "left_semi")


def team_features(as_of: AsOf, at) -> DataFrame:
    """One row a team: the inputs that a fixture's features need."""
    h = as_of.history(newest_rows=HISTORY)
    mean = lambda s, n: F.avg(F.when(F.col("rn") <= n, F.col(s)))
    venue = lambda s, home: F.avg(F.when(F.col("is_home") == home, F.col(s)))
    base = h.groupBy("team_id").agg(
        mean("goals_for", 10).alias("gf10"), mean("goals_against", 10).alias("ga10"), mean("goals_for", HISTORY).alias("gf"), mean("goals_against", HISTORY).alias("ga"),
        venue("goals_for", True).alias("gf_home"), venue("goals_against", True).alias("ga_home"), venue("goals_for", False).alias("gf_away"), venue("goals_against", False).alias("ga_away"),
        mean("shots_on_target", 10).alias("sot10"), mean("sot_against", 10).alias("sota10"), F.count("*").alias("n"),
        F.round(mean("points", 5), 3).alias("ppg5"), F.round(mean("points", HISTORY), 3).alias("ppg"), venue("points", True).alias("ppg_home"), venue("points", False).alias("ppg_away"),
    )
    return base.join(schedule(h, at).drop("last_date"), "team_id", "left").join(opponent_adjusted(h), "team_id", "left")


def match_features(fixtures: DataFrame, teams: DataFrame, standings: DataFrame) -> DataFrame:
    """The 23 features of each fixture, missing ones filled by their defaults."""
    side = lambda p: teams.select(F.col("team_id").alias(f"{p}_team_id"), *[F.col(c).alias(f"{p}_{c}") for c in teams.columns if c != "team_id"])
    place = lambda p: standings.select("competition_id", F.col("team_id").alias(f"{p}_team_id"), F.col("position").alias(f"{p}_position"))
    r = fixtures.select("id", "competition_id", "home_team_id", "away_team_id")
    for p in ("home", "away"):
        r = r.join(side(p), f"{p}_team_id", "left").join(place(p), ["competition_id", f"{p}_team_id"], "left")
    return r.select("id", *feature_columns())


def feature_columns() -> list:
    """The 23 features from a fixture's inputs with prefixes home_ and away_, in the order that models expect."""
    c = lambda name, default, *more: F.round(F.coalesce(name if not isinstance(name, str) else F.col(name), *[F.col(m) for m in more], F.lit(float(default))), 6)
    out = {
        "home_gf_10": c("home_gf10", 1.3), "home_ga_10": c("home_ga10", 1.3), "away_gf_10": c("away_gf10", 1.3), "away_ga_10": c("away_ga10", 1.3),
        "home_gf_home": c("home_gf_home", 1.3, "home_gf"), "home_ga_home": c("home_ga_home", 1.3, "home_ga"), "away_gf_away": c("away_gf_away", 1.3, "away_gf"), "away_ga_away": c("away_ga_away", 1.3, "away_ga"),
        "home_sot_10": c("home_sot10", 4.5), "away_sot_10": c("away_sot10", 4.5), "home_sot_against_10": c("home_sota10", 4.5), "away_sot_against_10": c("away_sota10", 4.5),
        "home_ppg_5": c("home_ppg5", 1.4), "away_ppg_5": c("away_ppg5", 1.4), "home_ppg_all": c("home_ppg", 1.4), "away_ppg_all": c("away_ppg", 1.4),
        "home_attack_index": c("home_attack_index", 1.0), "away_attack_index": c("away_attack_index", 1.0), "home_defence_index": c("home_defence_index", 1.0), "away_defence_index": c("away_defence_index", 1.0),
        "home_rest_advantage_days": c((F.col("home_rest_days") - F.col("away_rest_days")).cast("double"), 0.0),
        "congestion_difference": F.round(F.coalesce("home_matches_last_14_days", F.lit(0)).cast("double") - F.coalesce("away_matches_last_14_days", F.lit(0)), 6),
        "position_difference": c((F.col("away_position") - F.col("home_position")).cast("double"), 0.0),
    }
    return [out[k].alias(k) for k in FEATURES]
