"""Data-quality tiers and explanation factors: rules that emit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Plausible ranges of a side's statistics in one match.
PLAUSIBLE = {"goals_for": (0, 12), "shots": (0, 50), "shots_on_target": (0, 30), "corners": (0, 25), "fouls": (0, 40), "yellows": (0, 12), "reds": (0, 5)}
COVERED = ("shots", "shots_on_target", "corners", "fouls", "yellows", "xg")
MATERIAL, LEAST = 0.12, 6


def suspicious(rows: DataFrame) -> DataFrame:
    """(id, team_id, stat, value) of every value outside its plausible range."""
    cells = [F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for s, (lo, hi) in PLAUSIBLE.items()]
    return rows.select("id", "team_id", F.explode(F.array(*cells)).alias("c")).select("id", "team_id", "c.*").where("value < lo or value > hi").select("id", "team_id", "stat", "value")


def coverage(history: DataFrame) -> DataFrame:
    """Share of each team's rows in which a statistic is recorded."""
    return history.groupBy("team_id").agg(F.count("*").alias("n"), F.max("kickoff_date").alias("last_date"), *[F.round(F.avg(F.col(s).isNotNull().cast("double")), 3).alias(s) for s in COVERED])


def quality(fixtures: DataFrame, cover: DataFrame, meetings: DataFrame, as_of, sources: int = 1, lineups: str = "unavailable", team_news: bool = False, flagged: DataFrame | None = None) -> DataFrame:
    """Issues by severity, score, tier and confidence of each fixture (id, home_team_id, away_team_id, kickoff_date).

    flagged: what flags() found for the fixtures; without it all have the lineups and news given, and a warning for lineups that aren't confirmed.
    """
    day = F.to_date(F.lit(as_of).cast("timestamp"))
    side = lambda p: cover.select(F.col("team_id").alias(f"{p}_team_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "last_date", *COVERED)])
    h2h = meetings.select(F.col("team_id").alias("home_team_id"), F.col("opponent_id").alias("away_team_id"), F.col("matches").alias("h2h"))
    r = fixtures.join(side("home"), "home_team_id", "left").join(side("away"), "away_team_id", "left").join(h2h, ["home_team_id", "away_team_id"], "left")
    hn, an, met = F.coalesce("home_n", F.lit(0)), F.coalesce("away_n", F.lit(0)), F.coalesce("h2h", F.lit(0))
    age = F.datediff(day, F.greatest("home_last_date", "away_last_date"))
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    serious = one(hn < 5) + one(an < 5) + one(age > 45)
    missing = [one(F.col(f"{p}_{s}") == 0) for p in ("home", "away") for s in COVERED]
    warnings = one((hn >= 5) & (hn < 10)) + one((an >= 5) & (an < 10)) + one((age > 21) & (age <= 45)) + (0 if lineups == "confirmed" or flagged is not None else 1)
    for m in missing:
        warnings = warnings + m
    sparse = one(met < 3) + one(F.datediff("kickoff_date", day) > 10)
    for p in ("home", "away"):
        for s in COVERED:
            sparse = sparse + one((F.col(f"{p}_{s}") > 0) & (F.col(f"{p}_{s}") < 0.5))
    small = F.least(hn, an)
    base = F.when(small == 0, 0.0).when(small < 5, 0.35).when(small < 10, 0.6).when(small < 20, 0.85).otherwise(1.0)
    kind, known = F.lit(lineups), F.lit(team_news)
    if flagged is not None:
        r = r.join(flagged.select("id", F.col("lineups").alias("_lineups"), F.col("team_news").alias("_news"), "issues"), "id", "left")
        kind, known = F.coalesce("_lineups", kind), F.coalesce("_news", known)
        count = lambda severity: F.coalesce(F.size(F.filter("issues", lambda x: x.severity == severity)), F.lit(0))
        serious, warnings, sparse = serious + count("serious"), warnings + count("warning"), sparse + count("info")
    fixed = (1.05 if sources >= 3 else 0.9 if sources <= 1 else 1.0) * F.when(kind == "confirmed", 1.08).when(kind == "unavailable", 0.95).otherwise(1.0) * F.when(known, 1.0).otherwise(0.92)
    r = r.select("id", hn.cast("long").alias("home_matches"), an.cast("long").alias("away_matches"), met.cast("long").alias("h2h_matches"), serious.alias("serious"), warnings.alias("warnings"), sparse.alias("infos"), base.alias("_b"), age.alias("freshness_days"), fixed.alias("_f"))
    score = F.col("_b") * F.greatest(F.lit(0.3), 1 - 0.15 * F.col("serious")) * F.greatest(F.lit(0.5), 1 - 0.05 * F.col("warnings")) * F.col("_f") * F.when(F.col("freshness_days") > 45, 0.85).otherwise(1.0)
    r = r.withColumn("score", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6)).drop("_b", "_f")
    tier = F.when((F.col("score") <= 0) | (F.least("home_matches", "away_matches") == 0), "INSUFFICIENT").when((F.col("score") >= 0.8) & (F.col("serious") == 0), "HIGH").when(F.col("score") >= 0.55, "MEDIUM").otherwise("LOW")
    return r.withColumn("tier", tier).withColumn("confidence", F.round(0.35 + 0.65 * F.col("score"), 6))


def explain(rows: DataFrame) -> DataFrame:
    """(id, category, favours, impact, statement): one row for each rule that fires.

    rows holds a fixture's id, its sides' features with prefixes home_ and away_ (as
    team_features names them), positions, trends, meetings and the league's home goals.
    """
    c = F.col

    def gap(a, b):
        m = (F.abs(a) + F.abs(b)) / 2
        return F.when(m > 0, (a - b) / m)

    def factor(when, category, home, impact, text):
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(category).alias("category"), F.when(home, "home").otherwise("away").alias("favours"), F.round(impact, 6).alias("impact"), text.alias("statement")))

    enough10 = (c("home_n") >= LEAST) & (c("away_n") >= LEAST)
    said = lambda what, a, b: F.format_string(what + ": %.2f against %.2f", a.cast("double"), b.cast("double"))
    attack10, attack = gap(c("home_gf10"), c("away_gf10")), gap(c("home_gf"), c("away_gf"))
    defence = gap(c("away_ga10"), c("home_ga10"))
    shots = gap(c("home_sot10"), c("away_sot10"))
    index = gap(c("home_attack_index"), c("away_attack_index"))
    one = lambda x, scale: F.least(F.abs(x) / scale, F.lit(1.0))
    home_venue, away_venue = c("home_ppg_home") - c("home_ppg"), c("away_ppg_away") - c("away_ppg")
    places, rest, busy, wins = c("away_position") - c("home_position"), c("home_rest_days") - c("away_rest_days"), c("home_matches_last_14_days") - c("away_matches_last_14_days"), c("wins") - c("losses")
    road = c("away_ga_away") / c("avg_home_goals") - 1
    made = [
        factor(enough10 & (F.abs(attack10) >= MATERIAL), "attack", attack10 > 0, one(attack10, 1) * 0.9, said("goals a match, last 10", c("home_gf10"), c("away_gf10"))),
        factor(enough10 & ~F.coalesce(F.abs(attack10) >= MATERIAL, F.lit(False)) & (F.abs(attack) >= MATERIAL), "attack", attack > 0, one(attack, 1) * 0.6, said("goals a match", c("home_gf"), c("away_gf"))),
        factor(enough10 & (F.abs(defence) >= MATERIAL), "defence", defence > 0, one(defence, 1) * 0.85, said("conceded a match, last 10", c("home_ga10"), c("away_ga10"))),
        factor((c("home_n_home") >= LEAST) & (c("home_ppg") != 0) & (F.abs(home_venue) >= 0.25), "venue", home_venue > 0, one(home_venue, 1.5) * 0.8, said("points at home and overall", c("home_ppg_home"), c("home_ppg"))),
        factor((c("away_n_away") >= LEAST) & (c("away_ppg") != 0) & (F.abs(away_venue) >= 0.25), "venue", away_venue < 0, one(away_venue, 1.5) * 0.8, said("points away and overall", c("away_ppg_away"), c("away_ppg"))),
        factor((c("away_n_away") >= LEAST) & (road > 0.15), "defence", F.lit(True), F.least(road, F.lit(1.0)) * 0.7, said("conceded away, league's home goals", c("away_ga_away"), c("avg_home_goals"))),
        factor(enough10 & (F.abs(shots) >= MATERIAL), "chance_creation", shots > 0, one(shots, 1) * 0.65, said("shots on target, last 10", c("home_sot10"), c("away_sot10"))),
        factor(F.abs(c("home_trend")) >= 0.4, "form", c("home_trend") > 0, one(c("home_trend"), 1.5) * 0.6, said("trend, home", c("home_trend"), F.lit(0.0))),
        factor(F.abs(c("away_trend")) >= 0.4, "form", c("away_trend") < 0, one(c("away_trend"), 1.5) * 0.6, said("trend, away", c("away_trend"), F.lit(0.0))),
        factor(F.abs(places) >= 4, "standing", places > 0, one(places, 15) * 0.55, said("places", c("home_position"), c("away_position"))),
        factor(F.abs(rest) >= 2, "rest", rest > 0, one(rest, 7) * 0.45, said("days of rest", c("home_rest_days"), c("away_rest_days"))),
        factor(F.abs(busy) >= 2, "congestion", busy < 0, one(busy, 4) * 0.4, said("matches in 14 days", c("home_matches_last_14_days"), c("away_matches_last_14_days"))),
        factor((c("meetings") >= 5) & (F.abs(wins) >= 2), "head_to_head", wins > 0, F.least(F.abs(wins) / c("meetings"), F.lit(1.0)) * 0.4, said("meetings won", c("wins"), c("losses"))),
        factor((c("home_attack_sample") >= 8) & (c("away_attack_sample") >= 8) & (F.abs(index) >= MATERIAL), "strength_adjusted", index > 0, one(index, 1) * 0.75, said("goals relative to opponents", c("home_attack_index"), c("away_attack_index"))),
    ]
    return rows.select("id", F.explode(F.array_compact(F.array(*made))).alias("f")).select("id", "f.*")


def availability_factors(fixtures: DataFrame, out: DataFrame, listed: int = 4) -> DataFrame:
    """(id, category, favours, impact, statement): a side that misses squad members favours the other one.

    fixtures (id, home_team_id, away_team_id), out (team_id, player, status); players who are injured, suspended or unavailable count, doubtful ones don't.
    """
    gone = out.where(F.col("status").isin("injured", "suspended", "unavailable")).groupBy("team_id").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("player")), 1, listed).alias("names"))
    sides = fixtures.select("id", F.explode(F.array(*[F.struct(F.lit(p).alias("side"), F.col(f"{p}_team_id").alias("team_id")) for p in ("home", "away")])).alias("s")).select("id", "s.*")
    said = F.concat(F.lit("without "), F.col("n").cast("string"), F.lit(": "), F.array_join("names", ", "), F.when(F.col("n") > listed, F.concat(F.lit(" and "), (F.col("n") - listed).cast("string"), F.lit(" more"))).otherwise(""))
    return sides.join(gone, "team_id").select("id", F.lit("availability").alias("category"), F.when(F.col("side") == "home", "away").otherwise("home").alias("favours"), F.round(F.least(F.col("n") / 6.0, F.lit(1.0)) * 0.7, 6).alias("impact"), said.alias("statement"))


def model_factors(fits: DataFrame) -> DataFrame:
    """(id, category, favours, impact, statement) of what the fitted models say of fixtures (id, home_rated, away_rated, home_new, away_new, home_attack,
    away_defence, home_advantage, home_rating, away_rating): sides without a rating of their own or new to the competition favour the other
    one; strengths and ratings favour neither. What is null is not said."""
    c = F.col
    say = lambda when, favours, impact, text: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit("model").alias("category"), F.lit(favours).alias("favours"), F.lit(impact).alias("impact"), text.alias("statement")))
    made = []
    for side, other in (("home", "away"), ("away", "home")):
        made += [say(~c(f"{side}_rated"), other, 0.5, F.lit(f"{side} side rated by the prior of new teams")), say(c(f"{side}_rated") & c(f"{side}_new"), other, 0.35, F.lit(f"{side} side not in this competition last season"))]
    made.append(say(c("home_attack").isNotNull() & c("away_defence").isNotNull() & c("home_advantage").isNotNull(), "neutral", 0.3, F.format_string("attack %+.2f, defence %+.2f, home advantage %+.2f", "home_attack", "away_defence", "home_advantage")))
    made.append(say(c("home_rating").isNotNull() & c("away_rating").isNotNull(), "neutral", 0.28, F.format_string("ratings %.0f and %.0f, gap %+.0f", "home_rating", "away_rating", c("home_rating") - c("away_rating"))))
    return fits.select("id", F.inline(F.array_compact(F.array(*made))))


def flags(fixtures: DataFrame, as_of, lineups: DataFrame, conflicts: DataFrame, out: DataFrame, player_rows: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row a fixture (id, home_team_id, away_team_id, kickoff): lineups (confirmed, predicted or unavailable), and issues as an array of (code, severity).

    lineups (id, kind), conflicts (id), out (team_id) of any availability news, player_rows (team_id) of statistics, conditions (id). A missing lineup is serious within
    two hours of the kickoff; each conflict of sources is a warning; no news of either squad is a warning, no players' rows of the home side an info.
    """
    kinds = lineups.groupBy("id").agg(F.max((F.col("kind") == "confirmed").cast("int")).alias("_confirmed"), F.max((F.col("kind") == "predicted").cast("int")).alias("_predicted"))
    r = fixtures.join(kinds, "id", "left").join(conflicts.groupBy("id").agg(F.count("*").alias("_conflicts")), "id", "left").join(conditions.select("id").distinct().withColumn("_weather", F.lit(True)), "id", "left")
    news, stats = out.select("team_id").distinct(), player_rows.select("team_id").distinct()
    for p in ("home", "away"):
        r = r.join(news.select(F.col("team_id").alias(f"{p}_team_id"), F.lit(True).alias(f"_{p}_news")), f"{p}_team_id", "left")
    r = r.join(stats.select(F.col("team_id").alias("home_team_id"), F.lit(True).alias("_players")), "home_team_id", "left")
    kind = F.when(F.col("_confirmed") == 1, "confirmed").when(F.col("_predicted") == 1, "predicted").otherwise("unavailable")
    soon = F.coalesce(F.unix_timestamp("kickoff") - F.unix_timestamp(F.lit(as_of).cast("timestamp")) <= 7200, F.lit(False))
    issue = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    known = F.coalesce("_home_news", "_away_news", F.lit(False))
    one = F.array(issue(kind == "predicted", "lineups_predicted", "warning"), issue((kind == "unavailable") & soon, "lineups_missing_late", "serious"), issue((kind == "unavailable") & ~soon, "lineups_missing", "warning"), issue(~known, "no_team_news", "warning"), issue(F.col("_players").isNull(), "no_player_data", "info"))
    clashes = F.array_repeat(F.struct(F.lit("source_conflict").alias("code"), F.lit("warning").alias("severity")), F.coalesce("_conflicts", F.lit(0)).cast("int"))
    return r.select("id", kind.alias("lineups"), known.alias("team_news"), F.col("_weather").isNotNull().alias("weather"), F.concat(F.array_compact(one), clashes).alias("issues"))
