"""Walk-forward runs of the count models: corners and card points, fitted anew at checkpoints, scored on the matches that follow.

A fit is sums alone (league means, decayed and shrunk team rates, variance over mean, referees' multipliers), so all fits of
a run are four aggregations by (competition, checkpoint, ...) over one written table of sides; no Python runs and no group is gathered.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import half_life
from touchline.operators import evaluation, scores
from touchline.session import spread, written

from .backtest import Run, checkpoints, trained_by


@dataclasses.dataclass(frozen=True)
class CountRun:
    """The bounds of a count fit: matches of the competition, rows of a team and of a referee, matches for a variance. lines by market."""

    least_matches: int = 150
    least_team: int = 8
    least_referee: int = 20
    least_totals: int = 50
    seasons_back: int = 3
    half_life_days: float = 365.0
    shrinkage: float = 6.0
    most: int = 30
    lines: tuple[tuple[str, tuple[float, ...]], ...] = (("corners", (9.5, 10.5)), ("cards", (3.5, 4.5)))


def values(market: str) -> tuple[Column, Column]:
    """A side's count in a match, null where unrecorded, and whether it can be scored: card points need either card to be fitted, the yellows to be scored."""
    if market == "corners":
        return F.col("corners").cast("double"), F.col("corners").isNotNull()
    known = F.col("yellows").isNotNull() | F.col("reds").isNotNull()
    return F.when(known, (F.coalesce("yellows", F.lit(0)) + 2 * F.coalesce("reds", F.lit(0))).cast("double")), F.col("yellows").isNotNull()


def sides(played: DataFrame, stats: DataFrame, market: str) -> DataFrame:
    """One row a match and side whose count is recorded: (id, competition_id, kickoff_date, known_at, referee, team_id, opponent_id, is_home, v, whole)."""
    v, whole = values(market)
    both = F.array(*[F.struct(F.col(f"{us}_team_id").alias("team_id"), F.col(f"{them}_team_id").alias("opponent_id"), F.lit(us == "home").alias("is_home")) for us, them in (("home", "away"), ("away", "home"))])
    rows = played.select("id", "competition_id", "kickoff_date", "known_at", "referee", F.inline(both))
    return rows.join(stats.select(F.col("match_id").alias("id"), "team_id", v.alias("v"), whole.alias("whole")), ["id", "team_id"]).where("v is not null")


def count_fits(training: DataFrame, bounds: CountRun, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leagues, teams, referees) by competition and checkpoint, from a written table of sides, each once with its checkpoint, or with usable, the
    array of all that train on it. wanted: (competition_id, checkpoint, team) of the teams' rates that are needed, all if none.

    A league without enough rows, or with a mean of zero, has no fit. A team's rates are shrunk towards its league's mean and then relative to it.
    Sides are never multiplied by their checkpoints: what has no decay is summed over sides with the same checkpoints first, and a team's sides
    meet only the checkpoints at which the team is wanted.
    """
    key = ["competition_id", "checkpoint"]
    r = training if "usable" in training.columns else training.withColumn("usable", F.array("checkpoint")).drop("checkpoint")
    r = r.where(F.size("usable") > 0)
    same = ["competition_id", "usable"]
    at_each = lambda sums, *by: sums.withColumn("checkpoint", F.explode("usable")).groupBy(*key, *by)
    v = {True: F.when(F.col("is_home"), F.col("v")), False: F.when(~F.col("is_home"), F.col("v"))}
    sums = r.groupBy(*same).agg(F.sum(v[True]).alias("hs"), F.count(v[True]).alias("hn"), F.sum(v[False]).alias("vs"), F.count(v[False]).alias("vn"), F.count("*").alias("rows"))
    mean = lambda s, n: (F.sum(s) / F.nullif(F.sum(n), F.lit(0)))
    means = at_each(sums).agg(mean("hs", "hn").alias("mh"), mean("vs", "vn").alias("ma"), F.sum("rows").alias("rows"))
    # counts are whole numbers: the sums of their squares are exact
    both = r.groupBy(*same, "id").agg(F.sum("v").alias("t"), F.count("*").alias("k")).where("k = 2").groupBy(*same).agg(F.count("*").alias("n"), F.sum("t").alias("s"), F.sum(F.col("t") * F.col("t")).alias("q"))
    totals = at_each(both).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    uneven = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0)) / F.nullif(F.col("s") / F.col("n"), F.lit(0.0))
    leagues = means.where((F.col("rows") >= 2 * bounds.least_matches) & (F.col("mh") > 0) & (F.col("ma") > 0)).join(totals.select(*key, "n", uneven.alias("d")), key, "left")
    leagues = leagues.select(*key, "mh", "ma", F.when(F.col("n") >= bounds.least_totals, F.col("d")).alias("dispersion"))

    roles = F.array(F.struct(F.col("team_id").alias("team"), F.lit(True).alias("own")), F.struct(F.col("opponent_id").alias("team"), F.lit(False).alias("own")))
    if wanted is None:
        each = r.withColumn("checkpoint", F.explode("usable")).select(*key, "kickoff_date", "is_home", "v", F.inline(roles))
    else:  # the usable ones are all of the competition's between the first and the last
        each = r.select("competition_id", "kickoff_date", F.array_min("usable").alias("_first"), F.array_max("usable").alias("_last"), "is_home", "v", F.inline(roles)).join(wanted, ["competition_id", "team"]).where(F.col("checkpoint").between(F.col("_first"), F.col("_last")))
    each = each.withColumn("w", half_life(F.greatest(F.datediff("checkpoint", "kickoff_date"), F.lit(0)), bounds.half_life_days))
    sums = []
    for name, own, home in (("for_home", True, True), ("for_away", True, False), ("against_away", False, True), ("against_home", False, False)):
        here = (F.col("own") == own) & (F.col("is_home") == home)
        sums += [F.sum(F.when(here, F.col("v") * F.col("w"))).alias(f"{name}_s"), F.sum(F.when(here, F.col("w"))).alias(f"{name}_w")]
    teams = each.groupBy(*key, "team").agg(F.count(F.when(F.col("own"), 1)).alias("n"), *sums)

    judged = r.withColumn("referee", F.trim("referee")).where("referee <> ''").groupBy(*same, "referee").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    per = at_each(judged, "referee").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    overall = per.groupBy(*key).agg((F.sum("s") / F.sum("n")).alias("o"))
    referees = per.where(F.col("n") >= bounds.least_referee).join(overall, key).where("o > 0").select(*key, "referee", F.least(F.greatest(F.col("s") / F.col("n") / F.col("o"), F.lit(0.7)), F.lit(1.4)).alias("factor"))
    return leagues, teams, referees


def count_predictions(at: DataFrame, fitted: tuple[DataFrame, DataFrame, DataFrame], market: str, lines, bounds: CountRun) -> DataFrame:
    """(id, market, checkpoint, expected, line, p_over) of matches with their checkpoint, where both teams have enough rows; a referee without a multiplier has 1."""
    leagues, teams, referees = fitted
    key = ["competition_id", "checkpoint"]
    r = at.select("id", *key, "home_team_id", "away_team_id", F.trim("referee").alias("referee")).join(leagues, key)
    rates = ("for_home", "for_away", "against_home", "against_away")
    for p in ("home", "away"):
        r = r.join(teams.select(*key, F.col("team").alias(f"{p}_team_id"), F.col("n").alias(f"{p}_n"), *[F.col(f"{k}_{x}").alias(f"{p}_{k}_{x}") for k in rates for x in "sw"]), [*key, f"{p}_team_id"])
    r = r.where((F.col("home_n") >= bounds.least_team) & (F.col("away_n") >= bounds.least_team)).join(referees, [*key, "referee"], "left")

    def rate(name: str, mean: str) -> Column:
        return F.coalesce((F.col(f"{name}_s") + bounds.shrinkage * F.col(mean)) / (F.col(f"{name}_w") + bounds.shrinkage) / F.col(mean), F.lit(1.0))

    factor = F.coalesce("factor", F.lit(1.0))
    home = F.col("mh") * rate("home_for_home", "mh") * rate("away_against_away", "mh") * factor
    away = F.col("ma") * rate("away_for_away", "ma") * rate("home_against_home", "ma") * factor
    r = scores.count_columns(spread(r.select("id", "checkpoint", "dispersion", (home + away).alias("expected")), "id"), F.greatest("expected", F.lit(0.05)), F.col("dispersion"), bounds.most)
    over = [F.struct(F.lit(float(x)).alias("line"), scores.beyond(x, bounds.most).alias("p_over")) for x in lines]
    return r.select("id", F.lit(market).alias("market"), "checkpoint", "expected", F.inline(F.array(*over)))


def walk_forward_counts(matches: DataFrame, stats: DataFrame, run: Run, bounds: CountRun | None = None) -> DataFrame:
    """(id, market, checkpoint, expected, line, p_over, actual): every match of the run's days that a count model predicts, and what it recorded (null: unknown).

    matches as AsOf has them, stats one row a match and team. A fit sees what was known at its checkpoint's midnight.
    """
    bounds = bounds or CountRun()
    played = matches.where("status = 'played' and ft_home_goals is not null and ft_away_goals is not null")
    test = played.where(F.col("kickoff_date").between(F.lit(run.start).cast("date"), F.lit(run.end).cast("date")))
    days = written(checkpoints(test, run), "count-checkpoints")
    at = test.join(days, "competition_id").withColumn("checkpoint", F.array_max(F.filter("checkpoints", lambda c: c <= F.col("kickoff_date"))))
    at = written(at.select("id", "competition_id", "checkpoint", "home_team_id", "away_team_id", "referee"), "count-matches")
    wanted = written(at.select("competition_id", "checkpoint", F.explode(F.array("home_team_id", "away_team_id")).alias("team")).distinct(), "count-teams")
    out = []
    for market, lines in bounds.lines:
        seen = trained_by(sides(played, stats, market), days, dataclasses.replace(run, seasons_back=bounds.seasons_back))
        seen = written(seen.select("competition_id", "usable", "id", "kickoff_date", "referee", "team_id", "opponent_id", "is_home", "v", "whole"), f"{market}-sides")
        leagues, teams, referees = count_fits(seen, bounds, wanted)
        actual = seen.where("whole").where(F.col("kickoff_date").between(F.lit(run.start).cast("date"), F.lit(run.end).cast("date"))).groupBy("id").agg(F.sum("v").alias("actual"), F.count("*").alias("k")).where("k = 2").drop("k")
        out.append(count_predictions(at, (leagues, written(teams, f"{market}-teams"), referees), market, lines, bounds).join(actual, "id", "left"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def count_report(rows: DataFrame) -> DataFrame:
    """(model, market, metric, n, value) of predictions whose counts are recorded: every line's log loss and Brier score, the expected count's errors once a match."""
    known = written(rows.where("actual is not null").select("id", "market", "line", "expected", "p_over", "actual"), "counted")
    over = known.select(F.struct("market", "line").alias("model"), F.col("p_over").alias("p"), (F.col("actual") > F.col("line")).alias("truth"))
    lines = evaluation.binary_scores(over).select(F.col("model.market").alias("model"), F.concat_ws("_over_under_", "model.market", F.col("model.line").cast("string")).alias("market"), "n", "log_loss", "brier")
    once = known.select("id", F.col("market").alias("model"), "expected", "actual").distinct()
    errors = evaluation.numeric_scores(once, "expected", "actual").select("model", F.concat(F.lit("expected_"), "model").alias("market"), "n", "mae", "rmse", "bias")
    long = lambda df, names: df.select("model", "market", "n", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])))
    return long(lines, ("log_loss", "brier")).unionByName(long(errors, ("mae", "rmse", "bias"))).select("model", "market", "metric", "n", "value")
