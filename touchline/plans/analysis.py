"""One analysis of every fixture at a cutoff: models, ensemble, reconciled score matrix, markets, quality and explanation from one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import evaluation, features, judgement, scores
from touchline.operators.asof import AsOf
from touchline.operators.entities import DEFAULT_WEIGHTS
from touchline.operators.timeline import kickoff_features
from touchline.session import written

from . import backtest, models

CORNERS, CARDS = (8.5, 9.5, 10.5), (3.5, 4.5)


def fitted_at(a: AsOf, day: str, run: backtest.Run) -> DataFrame:
    """The models' fits on all that was known at the cutoff, as the walk-forward run has them, for one checkpoint: the cutoff's day."""
    rows = a.recorded().where(a.visible())
    played = rows.where(F.col("kickoff_date") >= F.lit(f"{int(day[:4]) - run.seasons_back}-07-01").cast("date")).where("ft_home_goals is not null and ft_away_goals is not null")
    played = backtest.with_shots(played, None).withColumn("known_at", F.lit(day).cast("timestamp"))  # all that is known at the cutoff trains
    days = played.select("competition_id").distinct().withColumn("checkpoints", F.array(F.lit(day).cast("date")))
    newest = written(backtest.newest_trained(played, days, run), "newest")  # features of no other match are read
    return backtest.fits(played, days, newest, kickoff_features(rows, None, newest), run)


def fixture_features(a: AsOf, at: str, season_start: str) -> DataFrame:
    """The 23 features of fixtures at the cutoff, with home_n and away_n."""
    teams = features.team_features(a, at)
    rows = features.match_features(a.scheduled(), teams, features.league_table(a.history(since=season_start)))
    n = lambda p: teams.select(F.col("team_id").alias(f"{p}_team_id"), F.coalesce("n", F.lit(0)).alias(f"{p}_n"))
    f = a.scheduled().select("id", "competition_id", "home_team_id", "away_team_id", "kickoff_date", "referee")
    return f.join(n("home"), "home_team_id", "left").join(n("away"), "away_team_id", "left").fillna(0, ["home_n", "away_n"]).join(rows, "id")


def analyze(a: AsOf, at: str, season_start: str, since: str, explanation_rows, weights: dict[str, float] | None = None, run: backtest.Run | None = None) -> dict[str, DataFrame]:
    """Of every fixture that isn't played: predictions by model, outcomes (the ensemble over the models that have enough evidence), markets from the
    goals model's matrix moved to the ensemble's outcomes, corner and card counts by side and line, quality and factors. Each is a table by fixture.

    A fixture for which no model has evidence has no outcomes and markets; its quality says why. Without a goals model the ensemble has no
    matrix to move, and only outcomes are given.
    """
    day = at[:10]
    run = run or backtest.Run(day, day)
    fixtures = written(fixture_features(a, at, season_start).withColumn("checkpoint", F.lit(day).cast("date")), "fixtures")
    fitted = fitted_at(a, day, run)
    made = written(backtest.predict(fixtures, fitted, run), "predictions")
    outcomes = written(evaluation.combine(made.select("id", "model", "home", "draw", "away"), weights or DEFAULT_WEIGHTS), "outcomes")
    shared = fitted.where("model = 'dixon_coles' and team_id is null").select("competition_id", F.col("values").alias("s"))
    teams = fitted.where("model = 'dixon_coles' and team_id is not null").select("competition_id", "team_id", F.col("values").alias("t"))
    strengths = teams.join(shared, "competition_id").select("competition_id", "team_id", F.get("t", F.lit(0)).alias("attack"), F.get("t", F.lit(1)).alias("defence"), F.get("s", F.lit(0)).alias("intercept"), F.get("s", F.lit(1)).alias("home"), F.get("s", F.lit(2)).alias("rho"))
    matrix = scores.rescale_columns(scores.score_columns(models.expected_goals(fixtures, strengths).join(outcomes.select("id", "home", "draw", "away"), "id")))
    history = a.history(since=since)
    cards = history.withColumn("cards", F.coalesce("yellows", F.lit(0)) + 2 * F.coalesce("reds", F.lit(0))).withColumn("cards", F.when(F.col("yellows").isNotNull() | F.col("reds").isNotNull(), F.col("cards")))
    referees = scores.referee_multipliers(cards, "cards")
    corners = scores.count_targets(scores.count_expectations(fixtures, history, "corners", at), "corners", CORNERS)
    booked = scores.count_targets(scores.count_expectations(fixtures, cards, "cards", at, referees), "cards", CARDS)
    meetings = a.head_to_head(12).groupBy("team_id", "opponent_id").agg(F.count("*").alias("matches"))
    quality = judgement.quality(fixtures.select("id", "home_team_id", "away_team_id", "kickoff_date"), judgement.coverage(a.history(newest_rows=80)), meetings, at)
    factors = judgement.explain(explanation_rows(a))
    wide = fitted.where("team_id is not null").groupBy("competition_id", "team_id").pivot("model", ["dixon_coles", "elo"]).agg(F.first("values"))
    said = fixtures.select("id", "competition_id", "home_team_id", "away_team_id").join(shared, "competition_id")
    for p in ("home", "away"):
        said = said.join(wide.select("competition_id", F.col("team_id").alias(f"{p}_team_id"), F.col("dixon_coles").alias(f"{p}_d"), F.col("elo").alias(f"{p}_e")), ["competition_id", f"{p}_team_id"], "left")
    new = features.absent_last_season(a.history(), season_start)
    for p in ("home", "away"):
        said = said.join(new.select("competition_id", F.col("team_id").alias(f"{p}_team_id"), F.lit(True).alias(f"{p}_new")), ["competition_id", f"{p}_team_id"], "left")
    get = lambda c, i: F.get(c, F.lit(i))
    internals = judgement.model_factors(said.select("id", F.col("home_d").isNotNull().alias("home_rated"), F.col("away_d").isNotNull().alias("away_rated"), F.coalesce("home_new", F.lit(False)).alias("home_new"), F.coalesce("away_new", F.lit(False)).alias("away_new"), get("home_d", 0).alias("home_attack"), get("away_d", 1).alias("away_defence"), get("s", 1).alias("home_advantage"), get("home_e", 0).alias("home_rating"), get("away_e", 0).alias("away_rating")))
    return {"predictions": made, "outcomes": outcomes, "markets": scores.goal_markets_of(matrix), "corners": corners, "cards": booked, "quality": quality, "factors": factors.unionByName(internals)}


def as_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """(id, section, market, selection, value, note): an analysis as one table."""
    none = F.lit(None).cast("string")
    out = parts["outcomes"].select("id", F.lit("outcome").alias("section"), F.lit("1x2").alias("market"), F.explode(F.array(*[F.struct(F.lit(s).alias("selection"), F.col(s).alias("value")) for s in ("home", "draw", "away")])).alias("x")).select("id", "section", "market", "x.*", none.alias("note"))
    rows = [out, parts["markets"].select("id", F.lit("goals").alias("section"), "market", "selection", "value", none.alias("note"))]
    rows += [parts[k].select("id", F.lit(k).alias("section"), "market", "selection", "value", F.when(~F.col("sufficient_data"), "too few matches with this count").alias("note")) for k in ("corners", "cards")]
    rows.append(parts["quality"].select("id", F.lit("quality").alias("section"), F.lit("score").alias("market"), F.col("tier").alias("selection"), F.col("score").alias("value"), none.alias("note")))
    rows.append(parts["factors"].select("id", F.lit("factor").alias("section"), F.col("category").alias("market"), F.col("favours").alias("selection"), F.col("impact").alias("value"), F.col("statement").alias("note")))
    made = rows[0]
    for r in rows[1:]:
        made = made.unionByName(r)
    return made


def change_summary(before: DataFrame, after: DataFrame, least: float = 0.01) -> DataFrame:
    """(id, version, created_at, summary) of fixtures analysed again: before and after hold (id, version, home, draw, away, tier), after created_at too.

    A first version has no summary; probabilities that moved by least or more are named, then a tier that changed.
    """
    old = before.select("id", F.col("version").alias("_v"), *[F.col(c).alias(f"_{c}") for c in ("home", "draw", "away", "tier")])
    r = after.join(old, "id", "left")
    moved = F.array_compact(F.array(*[F.when(F.abs(F.round(F.col(c) - F.col(f"_{c}"), 9)) >= least, F.concat(F.lit(f"{c} "), F.format_string("%+.1f", 100 * (F.col(c) - F.col(f"_{c}"))), F.lit("%"))) for c in ("home", "draw", "away")]))
    tier = F.when(F.col("tier") != F.col("_tier"), F.concat(F.lit("; data quality "), "_tier", F.lit(" -> "), "tier")).otherwise("")
    known = F.col("_home").isNotNull() & F.col("home").isNotNull()
    text = F.when(~known, "recalculated with the latest available data").when(F.size(moved) == 0, F.concat(F.lit("no material change in match-result probabilities"), tier)).otherwise(F.concat(F.lit("changes: "), F.array_join(moved, ", "), tier))
    return r.select("id", (F.coalesce("_v", F.lit(0)) + 1).alias("version"), "created_at", F.when(F.col("_v").isNotNull(), text).alias("summary"))

