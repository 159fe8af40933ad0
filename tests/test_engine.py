import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from touchline.functions import scalars
from touchline.operators import asof, evaluation, features, judgement, merge, scores
from touchline.operators import names as names_to_teams
from touchline.plans import models
from touchline.sources import files


def test_a_cutoff_is_required(league):
    with pytest.raises(ValueError):
        asof.AsOf(*league, None)


@pytest.mark.parametrize("at, expected", [("2025-01-01 17:29:59", 0), ("2025-01-01 17:30:00", 1), ("2025-01-04 15:00:00", 1), ("2026-06-01 00:00:00", 144)])
def test_matches_are_visible_when_they_are_over(league, at, expected):
    assert asof.AsOf(*league, at).completed().count() == expected


def test_no_competitions_means_none(league):
    assert asof.AsOf(*league, "2026-01-01").completed([]).count() == 0


def test_leaks_are_raised(league):
    a = asof.AsOf(*league, "2025-02-01")
    with pytest.raises(Exception, match=asof.LEAK):
        a.verified(league[0]).collect()
    seen = Observation("reads")
    assert len(a.verified(a.completed(), seen).collect()) == 11
    assert seen.get["rows"] == 11 and seen.get["leaks"] == 0 and str(seen.get["newest"]) <= "2025-02-01"


def test_table_grows_and_balances(league):
    before, after = (features.league_table(asof.AsOf(*league, at).history()).toPandas() for at in ("2025-03-01", "2025-06-01"))
    assert after.played.sum() > before.played.sum()
    for t in (before, after):
        assert t.gf.sum() == t.ga.sum() and t.won.sum() == t.lost.sum() and sorted(t.position) == [1, 2, 3, 4]
        assert t.sort_values("position").points.is_monotonic_decreasing


def test_the_most_reliable_source_wins_and_then_the_first(spark):
    rows = spark.createDataFrame([(1, 1, 0.6, 9, 5), (1, 1, 0.9, 7, 9), (1, 1, 0.9, 8, 8)], "match_id long, team_id long, reliability double, shots int, arrival int")
    assert asof.best_stats(rows).first().shots == 8


def test_windows_and_features(league):
    a = asof.AsOf(*league, "2026-06-01")
    h = a.history(newest_rows=80)
    w = {(r.team_id, r.scope, r.stat): (r.value, r.n) for r in features.window_means(h).collect()}
    assert w[0, "last5", "goals_for"][1] == 5 and w[0, "all", "goals_for"][1] == 72 and w[0, "all", "xg"] == (None, 0)
    rates = features.outcome_rates(h).toPandas()
    assert rates[["clean_sheet_rate", "scoring_rate", "btts_rate"]].stack().between(0, 1).all()
    assert features.head_to_head(a).where("team_id = 0 and opponent_id = 1").first().matches == 12


def test_prior_means_see_nothing_later(league):
    m = league[0]
    facts = m.select("id", "kickoff_date", "known_at", F.col("home_team_id").alias("team_id"), F.col("ft_home_goals").alias("goals"))
    got = {r.id: (r.n, r.mean) for r in asof.prior_means(facts, m.select("id", F.col("home_team_id").alias("team_id"), F.col("kickoff_utc").alias("at")), "team_id", "goals", 10).collect()}
    rows = facts.orderBy("id").toPandas()
    for r in rows.itertuples():
        past = rows[(rows.team_id == r.team_id) & (rows.id < r.id)].goals.tail(10)
        assert got[r.id] == (len(past), pytest.approx(past.mean()) if len(past) else None)


def test_score_matrix_is_a_distribution_and_rescales(spark):
    r = spark.createDataFrame([(1, 1.4, 1.1, -0.05), (2, 0.3, 2.2, 0.0)], "id long, lam double, mu double, rho double")
    m = scores.score_matrix(r)
    assert all(abs(x.s - 1) < 1e-12 for x in m.groupBy("id").agg(F.sum("p").alias("s")).collect())
    o = scores.outcomes(scores.rescale(m, r.select("id", F.lit(0.5).alias("home"), F.lit(0.2).alias("draw"), F.lit(0.3).alias("away")))).first()
    assert (o.home, o.draw, o.away) == (0.5, 0.2, 0.3)
    k = {(x.market, x.selection): x.value for x in scores.goal_markets(m).where("id = 1").collect()}
    assert k["over_under_2.5", "over"] + k["over_under_2.5", "under"] == pytest.approx(1, abs=1e-5)
    assert k["over_under_0.5", "over"] > k["over_under_1.5", "over"] > k["over_under_4.5", "over"]
    assert k["expected_goals", "home"] == pytest.approx(1.4, abs=0.03)


def test_count_distributions(spark):
    d = spark.createDataFrame([(1, 10.0, None), (2, 10.0, 1.5)], "id long, mean double, dispersion double")
    p = {r.id: np.array(r.p) for r in d.select("id", scalars.counts(F.col("mean"), F.col("dispersion"), 60).alias("p")).collect()}
    k = np.arange(61)
    for i, spread in ((1, 1.0), (2, 1.5)):
        assert p[i].sum() == pytest.approx(1) and (p[i] @ k) == pytest.approx(10, rel=1e-3) and (p[i] @ (k - 10) ** 2) == pytest.approx(10 * spread, rel=1e-2)


def test_parsing(spark):
    t = spark.createDataFrame([("3.7", "1/2/93"), ("", "01/02/2019"), ("x", "2019-02-01"), (" -4 ", "1-2-2019"), ("inf", "1.2.2019"), ("1e400", "31/02/2019"), (None, "1/2/68")], "n string, d string")
    rows = t.select(scalars.to_whole(F.col("n")).alias("n"), scalars.to_day(F.col("d")).alias("d")).collect()
    assert [r.n for r in rows] == [3, None, None, -4, None, None, None]
    assert [str(r.d) for r in rows] == ["1993-02-01"] + ["2019-02-01"] * 4 + ["None", "2068-02-01"]


@pytest.mark.parametrize("a, b, same", [("Bayern München", "bayern munchen", True), ("Arsenal FC", "Arsenal", True), ("Saint-Étienne", "saint etienne", True), ("Manchester United", "Manchester City", False), ("FC", "AFC", False)])
def test_names(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(scalars.plain_name(F.col("a")), scalars.plain_name(F.col("b"))).first()
    assert (r[0] == r[1]) is same


def test_resolution_by_name_then_closeness(spark):
    known = spark.createDataFrame([(1, "Real Sociedad"), (2, "Athletic Bilbao")], "team_id long, canonical string")
    names = spark.createDataFrame([("Real Sociedad",), ("REAL SOCIEDAD CF",), ("Real Sociedadd",), ("Unknown",)], "name string")
    got = {r.name: (r.team_id, r.how) for r in names_to_teams.resolve(names, known).collect()}
    assert got == {"Real Sociedad": (1, "exact"), "REAL SOCIEDAD CF": (1, "plain"), "Real Sociedadd": (1, "close"), "Unknown": (None, "none")}


def test_merge_fills_gaps_and_trusts_reliability(spark):
    old = spark.createDataFrame([(1, 0.9, 1, None), (2, 0.6, 1, 5), (3, 0.9, 7, 7)], "id long, reliability double, x int, y int")
    new = spark.createDataFrame([(1, 0.6, 2, 3), (2, 0.9, 2, None), (4, 0.5, 8, 8)], "id long, reliability double, x int, y int")
    got = {r.id: (r.x, r.y, r.reliability, r.conflicts) for r in merge.merge(old, new, "id", ["x", "y"]).collect()}
    assert got == {1: (1, 3, 0.9, "x"), 2: (2, 5, 0.9, "x"), 3: (7, 7, 0.9, ""), 4: (8, 8, 0.5, "")}


def test_slope_matches_finite_differences():
    r = np.random.default_rng(1)
    n, t = 80, 5
    h, a = r.integers(0, t, n), r.integers(0, t, n)
    yh, ya = r.poisson(1.4, n).astype(float), r.poisson(1.1, n).astype(float)
    f, unpack = models.goals_objective(h, a, yh, ya, yh, ya, r.random(n), t, 1.0, np.full(t, -0.1))
    x = r.normal(size=2 * t + 1) * 0.1
    _, g = f(x)
    for i in range(len(x)):
        e = np.zeros(len(x))
        e[i] = 1e-6
        assert (f(x + e)[0] - f(x - e)[0]) / 2e-6 == pytest.approx(g[i], rel=1e-4, abs=1e-4)
    best = models.minimise(f, np.zeros(2 * t + 1), np.full(2 * t + 1, -3.0), np.full(2 * t + 1, 3.0))
    att, dfn, *_ = unpack(best)
    assert abs(att.sum()) < 1e-9 and abs(dfn.sum()) < 1e-9 and np.abs(f(best)[1]).max() < 1e-2


def test_elo_is_zero_sum_and_strengths_are_centred(league):
    m = league[0]
    r = models.elo(m).toPandas().sort_values("id")
    assert len(r) == 144 and r.iloc[0].home_before == 1500 and r.home_before.std() > 0
    s = models.scoring_strengths(m, "2026-06-01").toPandas()
    assert s.attack.sum() == pytest.approx(0, abs=1e-6) and s.defence.sum() == pytest.approx(0, abs=1e-6) and s.rho.between(-0.4, 0.4).all()
    assert models.scoring_strengths(m.where("id < 50"), "2026-06-01").count() == 0
    p = models.elo_predict(models.elo(m), models.draw_curve(models.elo(m))).toPandas()
    assert np.allclose(p.home + p.draw + p.away, 1)


def test_ensemble_weights_favour_the_better_model(spark):
    rows = [(1, i, m, p) for i in range(400) for m, p in (("good", 0.6), ("bad", 1 / 3))]
    got = {r.model: r.weight for r in models.ensemble_weights(spark.createDataFrame(rows, "competition_id long, id long, model string, p double"), ["good", "bad"]).collect()}
    assert got["good"] > 0.8 and sum(got.values()) == pytest.approx(1, abs=1e-3)


def test_quality_of_unknown_sides_is_insufficient(league, spark):
    a = asof.AsOf(*league, "2025-06-01")
    fixtures = spark.createDataFrame([(1, 0, 1, dt.date(2025, 6, 3)), (2, 0, 99, dt.date(2025, 6, 3))], "id long, home_team_id long, away_team_id long, kickoff_date date")
    meetings = features.head_to_head(a).select("team_id", "opponent_id", "matches")
    got = {r.id: r for r in judgement.quality(fixtures, judgement.coverage(a.history(newest_rows=80)), meetings, "2025-06-01").collect()}
    assert got[2].tier == "INSUFFICIENT" and got[2].score == 0 and got[1].tier != "INSUFFICIENT" and got[1].h2h_matches > 0


@pytest.mark.parametrize("column, odds", [("B365H", True), ("Avg>2.5", True), ("BbMxA", True), ("PSCD", True), ("AHh", True), ("HS", False), ("AS", False), ("HST", False), ("FTHG", False), ("Referee", False), ("BWA", True), ("BFDH", True), ("LSH", True), ("PSC<2.5", True), ("pinnacle_home", True), ("home_odds", True), ("best_bookmaker", True), ("pin_x", True), ("HTHG", False), ("Attendance", False), ("Date", False)])
def test_odds_columns_by_shape(column, odds):
    assert files.is_odds(column) is odds


def test_prices_of_every_line_and_word_are_odds():
    prices = "bet365_home implied_prob_home market_price closing_price price_home B365>1.5 Max>3.5 Avg<3.5 PO PU BbMx>2.5 BbAvAHH AHCh PAHH B365AHA BMGMH 1XBD BFECH BbOU AvgC<2.5 Bet365 Home".split()
    assert [c for c in prices if not files.is_odds(c) and c != "Home"] == []
    statistics = "Div Date HS AS AF HHW AHW HBP ABP SoT xG xGA xA possession shots_on_target key_passes minutes assists saves tackles bps influence P Max Avg".split()
    assert [c for c in statistics if files.is_odds(c)] == []


def test_feeds(spark, tmp_path):
    (tmp_path / "season-2425.csv").write_text("Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,HS,AS,B365H,Avg>2.5\n16/08/24,20:00,A,B,1,0,10,4,1.5,1.9\n17/08/24,,C,,1,0,1,1,1,1\n18/08/24,,C,D,,,,,1,1\n")
    rows = files.match_csv(spark, str(tmp_path / "season-2425.csv"), season_of_path=True).orderBy("home").collect()
    assert [(r.home, r.status, r.season, r.home_shots) for r in rows] == [("A", "played", "2425", 10), ("C", "scheduled", "2425", None)] and rows[0].kickoff_utc.hour == 20
    (tmp_path / "a.json").write_text('{"teams":[{"id":1,"name":"T"}],"elements":[{"id":7,"first_name":"X","second_name":"Y","team":1,"status":"d","chance_of_playing_next_round":75,"news":"","news_added":"2024-08-01T10:00:00Z"}]}')
    p = files.availability_json(spark, str(tmp_path / "a.json")).first()
    assert (p.player, p.team_name, p.status, p.chance_of_playing) == ("X Y", "T", "doubtful", 0.75)
    (tmp_path / "r.json").write_text('{"matches":[{"date":"2024-08-01","time":"19:30","team1":"A","team2":"B","score":{"ft":[2,1],"ht":[1,0]}},{"date":"2024-08-02","team1":"C","team2":"D","score":[1,2]}]}')
    got = files.results_json(spark, str(tmp_path / "r.json")).orderBy("kickoff_date").collect()
    assert [(r.ft_home_goals, r.ht_away_goals) for r in got] == [(2, 0), (None, None)]
    (tmp_path / "w.json").write_text('{"hourly":{"time":["2024-08-01T18:00","2024-08-01T19:00","2024-08-01T20:00"],"temperature_2m":[1.0,2.0,3.0],"relative_humidity_2m":[1.0,1.0,1.0],"precipitation":[0.0,0.0,0.0],"wind_speed_10m":[1.0,1.0,1.0]}}')
    k = spark.createDataFrame([(1, dt.datetime(2024, 8, 1, 19, 10))], "match_id long, kickoff_utc timestamp")
    assert files.weather_json(spark, str(tmp_path / "w.json"), k).first().temperature_2m == 2.0
    assert [s.key for s in files.sources_for("matches")] == ["publisher_csv", "mirror_csv", "results_json"]


def test_bootstrap_draws_are_the_same_each_time(spark):
    d = spark.createDataFrame([(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 0.1 * ((i % 3) - 1) - 0.01) for i in range(200)], "competition_id long, day date, diff double")
    a, b = evaluation.paired_bootstrap(d).first(), evaluation.paired_bootstrap(d).first()
    assert a == b and a.low <= a.difference <= a.high


def test_scoring_targets_blend_shots_and_absent_teams_start_lower(league):
    m, stats = league
    some = stats.where("match_id % 4 <> 1 or team_id <> 0")  # one side without statistics: goals stand in for both
    known, rows = some.toPandas().set_index(["match_id", "team_id"]), m.toPandas().set_index("id")
    pairs = {i: (known.loc[(i, r.home_team_id)], known.loc[(i, r.away_team_id)]) for i, r in rows.iterrows() if (i, r.home_team_id) in known.index and (i, r.away_team_id) in known.index}
    goals = sum(rows.ft_home_goals[i] + rows.ft_away_goals[i] for i in pairs)
    sot, sh = (goals / sum(h[s] + a[s] for h, a in pairs.values()) for s in ("shots_on_target", "shots"))
    got = models.scoring_targets(m, some).toPandas().set_index("id")
    assert 0 < len(pairs) < len(rows) == len(got)
    for i, r in rows.iterrows():
        for k, (y, g) in enumerate(((got.yh[i], r.ft_home_goals), (got.ya[i], r.ft_away_goals))):
            want = 0.5 * g + 0.35 * sot * pairs[i][k].shots_on_target + 0.15 * sh * pairs[i][k].shots if i in pairs else g
            assert y == pytest.approx(want)
    plain, blended = (models.scoring_strengths(m, "2026-06-01", s).toPandas().set_index("team_id") for s in (None, stats))
    assert (plain.attack - blended.attack).abs().max() > 1e-3
    late = m.where("kickoff_date >= '2025-07-01' or (home_team_id <> 3 and away_team_id <> 3)")  # team 3 was absent in 2024/25
    free, drawn = (models.scoring_strengths(late, "2026-03-01", stats, absent=x).toPandas().set_index("team_id").attack for x in (0.0, -0.3))
    assert drawn[3] < free[3] - 1e-3 and drawn[0] > free[0]


def test_bootstrap_has_4000_replicates_unless_told_otherwise(spark):
    d = spark.createDataFrame([(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 0.1 * ((i * i % 11) - 5) + 0.08) for i in range(200)], "competition_id long, day date, diff double")
    whole, part = evaluation.paired_bootstrap(d).first(), evaluation.paired_bootstrap(d, 200).first()
    assert whole == evaluation.paired_bootstrap(d, 4000).first() != part
    assert round(part.p_better * 200, 3).is_integer() and round(whole.p_better * 4000, 3).is_integer() and not round(whole.p_better * 200, 3).is_integer()


def test_prior_means_of_a_team_with_most_facts(spark):
    r = np.random.default_rng(3)
    on = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(r.integers(0, 500_000)) // 30 * 30)
    facts = [(i, on().date(), on() if i % 50 else None, None if i % 11 == 0 else 1 if i % 3 else int(i % 5), int(r.integers(0, 6))) for i in range(1500)]
    probes = [(i, None if i % 9 == 0 else 1 if i % 2 else int(i % 6), on() if i % 40 else None) for i in range(300)] + [(500, 1, dt.datetime(1890, 1, 1)), (501, 1, dt.datetime(2300, 1, 1))]
    f = spark.createDataFrame(facts, "id long, kickoff_date date, known_at timestamp, team_id long, goals int")
    df = asof.prior_means(f, spark.createDataFrame(probes, "id long, team_id long, at timestamp"), "team_id", "goals", 4)
    got = {r.id: (r.n, r.mean) for r in df.collect()}
    for i, team, at in probes:
        known = sorted(((k, j, g) for j, k, t, u, g in facts if u == team and t is not None and at is not None and t <= at), reverse=True)[:4]
        assert got[i] == (len(known), pytest.approx(sum(g for _, _, g in known) / len(known)) if known else None)
    plan = df._jdf.queryExecution().analyzed().toString()
    windows = re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", plan)
    assert windows and all("day#" in w or "block#" in w for w in windows)  # no window holds a team's whole history


def test_entities(spark):
    from touchline.operators import entities

    day = dt.date
    rows = spark.createDataFrame([(1, 10, day(2025, 1, 5)), (1, 11, day(2025, 2, 5)), (2, 10, day(2025, 1, 5)), (3, 12, day(2025, 9, 1))], "player_id long, team_id long, match_date date")
    assert sorted(map(tuple, entities.squads(rows, "2025-06-01").collect())) == [(1, 11), (2, 10)]
    matches = spark.createDataFrame([(7, 10, 99, day(2025, 1, 4)), (8, 98, 10, day(2025, 1, 6)), (9, 11, 10, day(2025, 2, 7))], "id long, home_team_id long, away_team_id long, kickoff_date date")
    assert sorted((r.player_id, r.match_id) for r in entities.rows_to_matches(rows, matches).collect()) == [(1, 7), (2, 7)]
    kick = "id long, kickoff_utc string, kickoff_is_exact boolean, status string"
    old = spark.createDataFrame([(1, "a", False, "played"), (2, "b", True, "scheduled"), (3, "c", False, "scheduled")], kick)
    new = spark.createDataFrame([(1, "x", True, "scheduled"), (2, "y", True, "played")], kick)
    assert sorted(map(tuple, entities.upgrade_kickoffs(old, new).collect())) == [(1, "x", True, "played"), (2, "b", True, "played"), (3, "c", False, "scheduled")]
    known = spark.createDataFrame([(4, "a")], "k long, n string")
    assert sorted(map(tuple, entities.get_or_create(spark.createDataFrame([("c",), ("b",), ("a",), ("b",), (None,)], "n string"), known, "k", "n").collect())) == [(4, "a"), (5, "b"), (6, "c")]
    assert entities.get_or_create(known.select("n"), known.where("1 = 0"), "k", "n").first().k == 1


def test_scores_of_a_row_are_ranked_and_summed_where_it_is(spark):
    rates = spark.createDataFrame([(1, 1.5, 1.1, -0.05), (2, 1.2, 1.2, 0.0), (3, 0.4, 3.0, -0.1)], "id long, lam double, mu double, rho double")
    wide, rows = scores.score_columns(rates), scores.score_matrix(rates)
    got = scores.top_scores_of(wide)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, scores.top_scores(rows).collect()))


def test_ratings_pass_as_a_stream(spark, league):
    """A competition's matches come in many batches; its plan gathers no group."""
    m = league[0].unionByName(league[0].withColumn("competition_id", F.lit(2).cast("long")).withColumn("id", F.col("id") + 1000))
    want = {r[0]: r[2:] for c in (1, 2) for r in models.fold_ratings(m.where(F.col("competition_id") == c).orderBy("kickoff_date", "id").toPandas())[2]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = models.elo(m)
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
        got = {r.id: (r.home_before, r.away_before, r.gap, r.drawn) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_halves_are_rounded_as_their_multiple_is(spark):
    assert round(0.5025 * 1000) == 502 and 0.5025 * 1000 < 502.5  # SQL rounds the multiple
    day = lambda i: dt.date(2024, 1, 1 + i)
    rows = spark.createDataFrame([(1, 1, day(i), 90, 0, 0, 3.35 if i == 0 else 0.0, 0.0, True) for i in range(4)], "player_id long, team_id long, match_date date, minutes int, goals int, assists int, xg double, xa double, started boolean")
    news = spark.createDataFrame([], "player_id long, status string, chance_of_playing double")
    assert scores.player_projection(rows, news, "2024-06-01").first().expected_goals == 0.502


def test_count_markets_are_made_in_the_row(spark):
    """No shuffle of cells; the interval and the lines are those of the distribution."""
    d = spark.createDataFrame([(1, 10.0, None), (2, 3.0, 1.5)], "id long, mean double, dispersion double")
    got = scores.count_markets(d, (8.5,))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    for r in got.collect():
        p = d.where(F.col("id") == r.id).select(scalars.counts(F.col("mean"), F.col("dispersion"), 30).alias("p")).first().p
        c = np.cumsum(p)
        assert (r.expected, r.over_8_5) == pytest.approx((np.dot(p, range(31)), sum(p[9:])), abs=2e-6) and (r.interval_low, r.interval_high) == ((c < 0.1).sum(), (c < 0.9).sum())


def test_count_markets_are_compiled_and_equal_the_distribution(spark):
    """No lambda runs once a cell, and the row's method is small enough for the JVM to compile it; results are those of the array counts() makes."""
    d = spark.createDataFrame([(i, m, x) for i, (m, x) in enumerate((m, x) for m in (0.0, 0.7, 5.0, 17.0, 40.0, 600.0, 900.0, None) for x in (None, 1.0, 1.1, 1.4, 3.0))], "id long, mean double, dispersion double")
    got = scores.count_markets(d, (0.5, 8.5, 30.5))
    plan = got._jdf.queryExecution().executedPlan()
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    assert "lambda" not in plan.toString() and 0 < max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000
    known = d.where("coalesce(mean, 0) < 100")
    want = {r.id: r.p for r in known.select("id", scalars.counts(F.greatest("mean", F.lit(0.05)), F.col("dispersion"), 30).alias("p")).collect()}
    for r in got.collect():
        if r.id in want:
            p = np.array(want[r.id])
            c = np.round(np.cumsum(p), 9)
            assert (r.expected, r.over_0_5, r.over_8_5, r.over_30_5) == pytest.approx((p @ range(31), p[1:].sum(), p[9:].sum(), 0), abs=1e-6) and (r.interval_low, r.interval_high) == ((c < 0.1).sum(), (c < 0.9).sum())
    assert got.where("id in (30, 31, 32) and expected is null and interval_low is null").count() == 3  # e to the power of -900 is none


def test_strengths_are_fitted_from_a_stream_and_by_blocks(spark, league, monkeypatch):
    """No competition is gathered as a pandas frame; how many matches are evaluated at once, and how they are cut into batches, changes no bit."""
    m = league[0]
    both = m.unionByName(m.withColumn("competition_id", F.lit(2).cast("long")).withColumn("away_team_id", F.when(F.col("away_team_id") == 3, 30).otherwise(F.col("away_team_id"))).withColumn("id", F.col("id") + 1000))
    got = models.scoring_strengths(both, "2026-06-01")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    found = {(r.competition_id, r.team_id): r for r in got.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = m.toPandas().sort_values("id")
    rows["yh"], rows["ya"] = rows.ft_home_goals.astype(float), rows.ft_away_goals.astype(float)
    age = np.array([(dt.date(2026, 6, 1) - d).days for d in rows.kickoff_date], float)
    monkeypatch.setattr(models, "AT_ONCE", 7)
    want = models.fit_goals(rows, age, models.last_full_season(rows.kickoff_date, dt.date(2026, 6, 1)))
    assert sorted(t for c, t in found if c == 1) == want["teams"] and sorted(t for c, t in found if c == 2) == [0, 1, 2, 3, 30]
    for t, att, dfn in zip(want["teams"], want["attack"], want["defence"], strict=True):
        r = found[1, t]
        assert (r.attack, r.defence, r.intercept, r.home, r.rho, r.matches) == (att, dfn, want["intercept"], want["home"], want["rho"], len(rows))


def test_count_targets_run_no_lambda_a_cell(spark):
    e = spark.createDataFrame([(1, 5.0, 4.5, True), (2, None, None, False)], "id long, mu_home double, mu_away double, sufficient_data boolean")
    got = scores.count_targets(e, "corners", (8.5,))
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    p = np.array(e.where("id = 1").select(scalars.counts(F.lit(9.5), F.lit(None).cast("double"), 30).alias("p")).first().p)
    found = {(r.id, r.market, r.selection): r for r in got.collect()}
    total = found[1, "expected_corners", "total"]
    assert (total.low, total.high) == ((np.cumsum(p) < 0.1).sum(), (np.cumsum(p) < 0.9).sum()) and found[1, "corners_over_under_8.5", "over"].value == pytest.approx(p[9:].sum(), abs=1e-6)
    assert len(found) == 6 and not found[2, "corners", ""].sufficient_data


def test_count_targets_read_what_is_expected_once(spark, league):
    """Known and withheld rows come from one read, rates are made once for both sides, and what makes the rows is compiled."""
    a = asof.AsOf(*league, "2025-06-01")
    fixtures = league[0].where("id >= 100").select("id", "home_team_id", F.when(F.col("id") % 2 == 0, F.col("away_team_id")).otherwise(99).alias("away_team_id"), F.lit(" Test Referee ").alias("referee"))
    referees = scores.referee_multipliers(a.history().withColumn("cards", F.col("yellows") + 2 * F.col("reds")), "cards")
    got = scores.count_targets(scores.count_expectations(fixtures, a.history(), "corners", "2025-06-01", referees), "corners", (8.5, 9.5, 10.5))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else nothing is compiled before it runs
    plan = got.select("*")._jdf.queryExecution().executedPlan()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    assert "Union" not in plan.toString() and "POWER(0.5" not in plan.toString() and 0 < max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000
    n = fixtures.count()
    assert got.where("not sufficient_data and market = 'corners' and selection = '' and value is null").count() == n // 2 and got.where("sufficient_data and value is not null").count() == 9 * (n - n // 2)
