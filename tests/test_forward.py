"""Walk-forward runs, features at kickoffs, batches, names, feeds, experiments: against plain versions."""

import bisect
import dataclasses
import datetime as dt
import difflib
import hashlib
import json
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.functions import scalars
from touchline.operators import asof, evaluation, features, ingest, names, timeline
from touchline.plans import analysis, backtest, catalog, catalog_forward, catalog_ingest, count_runs, experiments, models
from touchline.sources import derived, feeds

from .conftest import SF


def test_lineitem_is_scanned_twice(spark):
    """After the snapshot, plans read its tables alone, with a bounded number of shuffles."""
    a = catalog.snapshot(spark, SF)
    df = features.match_features(a.scheduled(), features.team_features(a, "1999-06-15"), features.league_table(a.history(since="1998-07-01")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "orders" not in plan and plan.count("Exchange hashpartitioning") <= 60


def test_snapshot_reads_as_the_sources_do(spark):
    plain, kept = catalog.cut(spark, SF), catalog.snapshot(spark, SF)
    for since, comps in ((None, None), ("1998-07-01", [1, 3]), (None, [])):
        rows = [sorted(map(repr, x.history(comps, since, 5).select("team_id", "id", "rn", "shots", "xga").collect())) for x in (plain, kept)]
        assert rows[0] == rows[1]


def test_snapshot_is_written_once_from_one_shuffle_of_the_lines(spark, monkeypatch):
    made = []
    for module in (asof, catalog):
        if hasattr(module, "written"):
            monkeypatch.setattr(module, "written", lambda df, name: made.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    catalog.snapshot(spark, SF)
    assert len(made) == 1 and made[0].count("lineitem.parquet") == 1 and made[0].count("orders.parquet") == 1 and made[0].count("Exchange hashpartitioning") <= 2


def test_snapshot_of_odd_lines_reads_as_the_sources_do(spark, tmp_path):
    """One line, one supplier, a missing supplier, number or order, equal lines, sources of all kinds and of none."""
    r, some = random.Random(25), []
    for order in range(120):
        for _ in range(r.randint(1, 7)):
            some.append((order if order else None, r.choice([1, 2, 3, None]) or 4, r.choice([1, 2, 3, 3, None]), r.choice([1, 1, 2, 3, -2, None]), float(r.randint(1, 50)), r.choice([1.0, 2.0]), r.choice([0.0, 0.05]), 0.02, r.choice("RAN"), r.choice(["F", "O", None]), dt.datetime(1997, 1, r.randint(1, 3))))
    some += some[::5]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(some, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, k * 3, r.choice("FOP"), 1.0, dt.datetime(1997, 1 + k % 12, 1), r.choice(["1-URGENT", "2-HIGH", "5-LOW", None])) for k in range(100)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    plain, kept = catalog.cut(spark, str(tmp_path)), catalog.snapshot(spark, str(tmp_path))
    for read in (lambda a: a.history(), lambda a: a.matches(), lambda a: a.stats().select("match_id", "team_id", "source_id", "reliability", *asof.SIDE_STATS)):
        x, y = read(plain), read(kept)
        want = sorted(map(repr, x.collect()))
        assert x.columns and set(x.columns) == set(y.columns) and len(want) > 20 and want == sorted(map(repr, y.select(x.columns).collect()))


def test_features_at_one_kickoff_equal_those_at_its_cutoff(spark):
    a = catalog.snapshot(spark, SF)
    m, stats = a.matches(), a.stats()
    row = m.where("status = 'played' and kickoff_is_exact and kickoff_date > '1997-03-01'").orderBy("kickoff_date", "id").first()
    got = timeline.kickoff_features(m, stats).where(F.col("id") == row.id).first()
    start = f"{row.kickoff_date.year - (row.kickoff_date.month < 7)}-07-01"
    b = asof.AsOf(m, derived.stat_candidates(spark, SF), row.kickoff_utc)
    want = features.match_features(m.where(F.col("id") == row.id), features.team_features(b, row.kickoff_utc), features.league_table(b.history(since=start))).first()
    assert [got[f] for f in features.FEATURES] == [want[f] for f in features.FEATURES]


RUN = backtest.Run("1996-08-01", "1998-08-02", refit_days=120, least_rows=40, least_history=3, least_matches=40, least_team=2)


@pytest.fixture(scope="module")
def forward(spark):
    a = catalog.snapshot(spark, SF)
    test, fitted, made = backtest.walk_forward(a.matches(), a.stats(), RUN)
    return a, test.cache(), fitted.cache(), made.cache()


def test_fits_see_nothing_after_their_checkpoint(spark, forward):
    a, test, fitted, made = forward
    days = backtest.checkpoints(test, RUN)
    played = a.matches().where("status = 'played'")
    rows = backtest.training_sets(played, days, RUN)
    assert rows.where("known_at > checkpoint or year(kickoff_date) < year(checkpoint) - 5").count() == 0 and rows.count() > 0
    n = {(r.competition_id, r.checkpoint): r.n for r in rows.groupBy("competition_id", "checkpoint").agg(F.count("*").alias("n")).collect()}
    shared = fitted.where("team_id is null and model = 'elo'").collect()
    assert shared and all(x["values"][2] == n[x.competition_id, x.checkpoint] for x in shared)
    assert made.where("checkpoint > kickoff_date").count() == 0


def test_predictions_are_probabilities_of_three_models(forward):
    made = forward[3]
    assert {r.model for r in made.select("model").distinct().collect()} == set(backtest.MODELS)
    assert made.where("abs(home + draw + away - 1) > 1e-9 or least(home, draw, away) < 0").count() == 0
    assert made.where("model = 'dixon_coles' and (over_1_5 < over_2_5 or over_2_5 < over_3_5 or btts > 1)").count() == 0


def test_scores_equal_sql_on_the_written_predictions(spark, forward, tmp_path):
    _, test, _, made = forward
    rows = backtest.scored(test, made)
    rows.write.parquet(str(tmp_path / "rows"))
    got = {(r.model, r.market, r.metric): (r.n, r.value) for r in backtest.report(rows, RUN).collect()}
    sql = f"""select model, count(*), round(avg(-ln(case outcome when 'H' then home when 'D' then draw else away end)), 6), round(avg((case when home >= draw and home >= away then 'H' when draw >= away then 'D' else 'A' end = outcome)::int), 6),
      round(avg(case when goals > 2.5 then -ln(over_2_5) else -ln(1 - over_2_5) end), 6), round(avg(pow(btts - "both"::int, 2)), 6), round(avg(abs(expected_goals - goals)), 6) from '{tmp_path}/rows/*.parquet' group by 1"""
    for model, n, loss, accuracy, over, btts, mae in duckdb.sql(sql).fetchall():
        assert got[model, "1x2", "log_loss"] == (n, pytest.approx(loss, abs=2e-6)) and got[model, "1x2", "accuracy"] == (n, pytest.approx(accuracy, abs=2e-6))
        if model == "dixon_coles":
            assert got[model, "over_2_5", "log_loss"][1] == pytest.approx(over, abs=2e-6) and got[model, "btts", "brier"][1] == pytest.approx(btts, abs=2e-6) and got[model, "expected_goals", "mae"][1] == pytest.approx(mae, abs=2e-6)
    assert {m for m, *_ in got} == {*backtest.MODELS, "ensemble", "baseline"}
    skips = {r.reason: r.n for r in backtest.skipped(test, made).collect()}
    assert skips["scored"] == got["elo", "1x2", "log_loss"][0] and sum(skips.get(k, 0) for k in ("scored", "incomplete_model_set", "no_model_output")) == test.count()


def test_a_model_alone_predicts_as_among_others(forward):
    """The light run of each model against the full run's predictions of it; what it counts, and goals over 2.5 by hand."""
    a, test, fitted, made = forward
    for model in ("elo", "dixon_coles"):
        rows, summary = backtest.light_run(a.matches(), a.stats(), RUN, model)
        pick = lambda df: sorted((r.id, r.checkpoint, round(r.home, 6), round(r.draw, 6), round(r.away, 6)) for r in df.select("id", "checkpoint", "home", "draw", "away").collect())  # noqa: E731, B023
        assert pick(rows) == pick(made.where(F.col("model") == model)) != []
        got, each = summary.first(), rows.collect()
        assert got.n == len(each) and got.declined == test.count() - len(each) and got.fits == test.select("competition_id").distinct().count() + sum(
            r.n - 1 for r in backtest.checkpoints(test, RUN).select(F.size("checkpoints").alias("n")).collect())
        losses = [-np.log(r.over_2_5 if r.goals > 2.5 else 1 - r.over_2_5) for r in each if r.over_2_5 is not None]
        assert got.ou25_n == (len(losses) if model == "dixon_coles" else None) and (not losses or got.ou25_log_loss == pytest.approx(np.mean(losses), abs=1e-6))
    rows, summary = backtest.light_run(a.matches().where("1 = 0"), a.stats(), RUN, "elo")
    assert rows.count() == 0 and summary.count() == 0


COUNTS = count_runs.CountRun(least_matches=20, least_team=3, least_referee=3, least_totals=10, lines=(("corners", (8.5, 10.5)), ("cards", (2.5,))))


def duck_tables(matches, stats):
    c = duckdb.connect()
    c.register("m", matches.toPandas())
    c.register("s", stats.drop("arrival").toPandas())
    return c


def counts_by_sql(matches, stats, b):
    """The catalogue's SQL over given matches and statistics in place of those derived from the order lines."""
    text = catalog_forward.counts_sql("select id, market, line, round(expected, 6) as expected, round(p_over, 6) as p_over, actual from scored", RUN, b)
    own = text[text.index("played as ("):]
    return sorted(duck_tables(matches, stats).sql(f"with recursive matches as (select * replace (kickoff_date::date as kickoff_date) from m), stats as (select * from s), {own}").fetchall())


def test_count_runs_equal_sql(spark):
    """As the tables are, and with counts so uneven that their distribution is wide, cards of one kind, unnamed referees."""
    a = catalog.snapshot(spark, SF)
    m, s = a.matches(), a.stats()
    odd = s.withColumn("corners", F.when(F.col("match_id") % 4 == 0, F.col("corners") * 3).otherwise(F.col("corners"))).withColumn("yellows", F.when(F.col("match_id") % 5 != 0, F.col("yellows"))).withColumn("reds", F.when(F.col("match_id") % 3 != 0, F.col("reds")))
    unnamed = m.withColumn("referee", F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "referee")))
    for matches, stats, wide in ((m, s, False), (unnamed, odd, True)):
        got = count_runs.walk_forward_counts(matches, stats, RUN, COUNTS)
        rows = sorted((r.id, r.market, r.line, round(r.expected, 6), round(r.p_over, 6), r.actual) for r in got.collect())
        want = counts_by_sql(matches, stats, COUNTS)
        assert len(rows) == len(want) > 100
        for x, y in zip(rows, want, strict=True):
            assert x[:3] == y[:3] and x[3:5] == pytest.approx(y[3:5], abs=2e-6) and x[5] == y[5]
        if wide:
            played = matches.where("status = 'played'")
            days = backtest.checkpoints(played.where("kickoff_date between '1996-08-01' and '1998-08-02'"), RUN)
            leagues, _, referees = count_runs.count_fits(backtest.training_sets(count_runs.sides(played, stats, "corners"), days, RUN), COUNTS)
            assert leagues.where("dispersion > 1.1").count() and referees.count() and referees.where("trim(referee) = ''").count() == 0
            assert any(x[1] == "cards" and x[5] is None for x in rows)  # reds alone are fitted, not scored


def test_count_fits_see_nothing_after_their_checkpoint(spark):
    """What happens from a checkpoint on changes no prediction made with the fit of that day."""
    a = catalog.snapshot(spark, SF)
    m, s = a.matches(), a.stats()
    late = m.where("kickoff_date >= '1997-09-01'").select("id")
    changed = s.join(late, s.match_id == late.id, "left").withColumn("corners", F.when(F.col("id").isNull(), F.col("corners")).otherwise(F.col("corners") + 9)).drop("id")
    before = lambda stats: sorted(map(repr, count_runs.walk_forward_counts(m, stats, RUN, COUNTS).where("market = 'corners' and checkpoint <= '1997-09-01'").select("id", "line", F.round("expected", 9), F.round("p_over", 9)).collect()))
    assert before(s) == before(changed) != []


def test_count_runs_without_evidence_are_empty(spark):
    a = catalog.snapshot(spark, SF)
    assert count_runs.walk_forward_counts(a.matches(), a.stats(), RUN).count() == 0  # no competition has 150 matches in three seasons
    assert count_runs.count_report(count_runs.walk_forward_counts(a.matches().where("1 = 0"), a.stats(), RUN, COUNTS)).count() == 0
    assert count_runs.walk_forward_counts(a.matches(), a.stats().withColumn("corners", F.lit(None).cast("int")), RUN, COUNTS).where("market = 'corners'").count() == 0


def test_coefficients_are_the_largest_of_each_outcome(forward):
    rows = backtest.coefficients(forward[2]).collect()
    assert rows and len(rows) % 18 == 0 and {r.outcome for r in rows} == {"home", "draw", "away"} and all(r.feature in features.FEATURES for r in rows)


def test_regression_finds_the_least_loss():
    r = np.random.default_rng(4)
    x, w = r.normal(size=(300, 4)), r.random(300)
    y = (x @ r.normal(size=(4, 3)) + r.gumbel(size=(300, 3))).argmax(1)
    m, b = backtest.softmax_fit(x, y, w, 0.35)

    def loss(m, b):
        z = x @ m.T + b
        return 0.35 * (w * (np.log(np.exp(z).sum(1)) - z[np.arange(300), y])).sum() + 0.5 * (m * m).sum()

    best = loss(m, b)
    for _ in range(200):
        assert loss(m + r.normal(size=m.shape) * 1e-2, b + r.normal(size=3) * 1e-2) > best


def test_slope_is_flat_where_the_low_score_term_is_floored():
    h, a = np.array([0, 1]), np.array([1, 0])
    y = np.array([0.0, 0.0])
    f, _ = models.goals_objective(h, a, y, y, y, y, np.ones(2), 2, 1.0, np.zeros(2))
    x = np.array([0.1, -0.1, 1.5, 0.2, 0.4])  # 1 - lam mu rho < 0
    _, g = f(x)
    step = 1e-6
    for i in range(5):
        up, down = x.copy(), x.copy()
        up[i] += step
        down[i] -= step
        assert g[i] == pytest.approx((f(up)[0] - f(down)[0]) / (2 * step), abs=1e-4)


def test_strengths_by_sums_equal_the_fit_of_one_task(spark):
    a = catalog.snapshot(spark, SF)
    rows = a.completed([1]).where("ft_home_goals is not null").withColumn("yh", F.col("ft_home_goals").cast("double")).withColumn("ya", F.col("ft_away_goals").cast("double"))
    rows = rows.withColumn("age", F.datediff(F.lit("1999-06-15").cast("date"), "kickoff_date")).withColumn("last_season", F.col("home_team_id") % 5 != 0).select("id", "home_team_id", "away_team_id", "ft_home_goals", "ft_away_goals", "yh", "ya", "age", "last_season", "kickoff_date")
    one = rows.toPandas().sort_values("id")
    want = models.fit_goals(one, one.age.to_numpy(float), one.last_season.to_numpy(bool))
    got = {r.team_id: (r.attack, r.defence, r.intercept, r.home, r.rho) for r in models.strengths_by_sums(rows).collect()}
    for t, att, dfn in zip(want["teams"], want["attack"], want["defence"], strict=True):
        assert got[t] == pytest.approx((att, dfn, want["intercept"], want["home"], want["rho"]), abs=1e-4)


def test_an_analysis_moves_the_matrix_to_the_ensemble(spark):
    a = catalog.snapshot(spark, SF)
    from touchline.plans.catalog_more import explanation_rows

    run = dataclasses.replace(RUN, start="1999-06-15", end="1999-06-15")
    parts = analysis.analyze(a, "1999-06-15 14:30:00", "1998-07-01", "1996-07-01", explanation_rows, run=run)
    outcomes = {r.id: r for r in parts["outcomes"].collect()}
    margins = parts["markets"].where("market = 'winning_margin'").groupBy("id").agg(F.sum(F.when(F.col("selection").startswith("home"), F.col("value"))).alias("home")).collect()
    assert margins and all(r.home <= outcomes[r.id].home + 1e-4 for r in margins)
    rows = analysis.as_rows(parts)
    assert {r.section for r in rows.select("section").distinct().collect()} == {"outcome", "goals", "corners", "cards", "quality", "factor"}


# ingestion
def plain_fold(records):
    state, clashes = None, 0
    for x in records:
        if state is None:
            state = dict(x)
            continue
        if None not in (state["ft_home_goals"], x["ft_home_goals"]) and (state["ft_home_goals"], state["ft_away_goals"]) != (x["ft_home_goals"], x["ft_away_goals"]):
            clashes += 1
            if x["reliability"] <= state["reliability"]:
                continue
        may, changed = x["reliability"] >= state["reliability"], False
        for f in ingest.FIELDS:
            if x[f] not in (None, "") and (state[f] in (None, "") or (may and state[f] != x[f])):
                state[f], changed = x[f], True
        if x["status"] == "played" != state["status"]:
            state["status"], changed = "played", True
        merged = {**(state["external_ids"] or {}), **(x["external_ids"] or {})}
        if merged != (state["external_ids"] or {}):
            state["external_ids"], changed = merged, True
        if changed and may:
            state["source"], state["reliability"] = x["source"], x["reliability"]
    return state, clashes


def test_a_batch_of_many_records_a_match(spark):
    r = random.Random(9)
    base = {"competition_id": 1, "kickoff_utc": None, "kickoff_is_exact": False}
    some = lambda *x: r.choice(x)
    stored, staged, by = [], [], {}
    for k in range(60):
        pair = {"home_team_id": 2 * k, "away_team_id": 2 * k + 1, "kickoff_date": "2024-09-01"}
        new = lambda: {"ft_home_goals": some(None, 1, 2), "ft_away_goals": some(1, 1, 3), "ht_home_goals": some(None, 0), "ht_away_goals": None, "referee": some(None, "", "A", "B"), "matchday": some(None, 3, 4), "status": some("played", "scheduled"), "source": some("x", "y", "z"), "reliability": some(0.5, 0.7, 0.9), "external_ids": some(None, {"x": "1"}, {"y": str(k)})}
        by[k] = []
        if k % 3:
            stored.append({"id": k, **base, **pair, **new()})
            by[k].append(stored[-1])
        more = [{"record_id": 10 * k + i, "arrival": some(0, 1, 2), **base, **pair, **new()} for i in range(r.randint(0 if k % 3 else 1, 7))]
        staged += more
        by[k] += sorted(more, key=lambda x: (x["reliability"], x["arrival"], x["record_id"]))
    fields = ", ".join(f"{c} {t.replace('timestamp', 'string').replace('date', 'string') if c in ('kickoff_utc', 'kickoff_date') else t}" for c, t in ingest.RECORD.items())
    cast = lambda df: df.withColumn("kickoff_date", F.to_date("kickoff_date")).withColumn("kickoff_utc", F.col("kickoff_utc").cast("timestamp"))
    keys = "competition_id long, home_team_id long, away_team_id long"
    old = cast(spark.createDataFrame(stored, f"id long, {keys}, {fields}"))
    new = cast(spark.createDataFrame(staged, f"record_id long, arrival int, {keys}, {fields}"))
    folded = ingest.fold(old, new).cache()
    got = {x.home_team_id // 2: x for x in folded.collect()}
    assert set(got) == {k for k in by if by[k]}
    for k, x in got.items():
        state, clashes = plain_fold(by[k])
        assert [x[f] for f in (*ingest.FIELDS, "status", "source", "reliability", "external_ids")] == [state[f] for f in (*ingest.FIELDS, "status", "source", "reliability", "external_ids")], k
        assert len(x.conflicts) == clashes
    odd = cast(spark.createDataFrame([{"record_id": 9001, "arrival": 0, **base, "kickoff_date": "2024-09-01", "home_team_id": 5, "away_team_id": x, **{f: None for f in ingest.FIELDS}, "status": "played", "source": "x", "reliability": 0.5, "external_ids": None} for x in (5, None)], new.schema.simpleString()[7:-1].replace(":", " ").replace("map<string,string>", "map<string,string>").replace("kickoff_date date", "kickoff_date string").replace("kickoff_utc timestamp", "kickoff_utc string")))
    log = {x.source: x for x in ingest.run_log(ingest.fold(old, new.unionByName(odd)), new.unionByName(odd)).collect()}
    assert log["x"].skipped == 2 and sum(x.records for x in log.values()) == len(staged) + 2 and sum(x.written for x in log.values()) == sum(1 for k in by if k % 3 == 0)
    assert ingest.fold(old, new.limit(0)).count() == len(stored) and ingest.fold(old.limit(0), new).count() == len({x["home_team_id"] for x in staged})


# names
def test_no_close_name_is_missed_and_few_are_compared(spark):
    r = random.Random(2)
    words = ["united", "city", "rovers", "athletic", "real", "sporting"]
    known = sorted({f"{''.join(r.choice('abcdefgh') for _ in range(r.randint(2, 9)))} {r.choice(words)}" for _ in range(250)})
    asked = []
    for k in known:
        i = r.randrange(len(k))
        asked.append(r.choice([k[:i] + k[i + 1 :], k[:i] + "z" + k[i:], k[:i] + "q" + k[i + 1 :], k[::-1], k + " x"]))
    asked = sorted(set(a.strip() for a in asked))
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "plain string")
    got = {(p.plain, p.other) for p in names.close_pairs(df(asked), df(known)).collect()}
    want = {(a, k) for a in asked for k in known if a != k and difflib.SequenceMatcher(None, a, k).ratio() >= 0.9}
    assert want <= got and len(want) > 50
    # short names over eight letters are the hard case: 3888 candidates, where 5021 pairs share a word
    assert len(got) < sum(1 for a in asked for k in known if set(a.split()) & set(k.split()))
    with pytest.raises(ValueError):
        names.close_pairs(df(asked), df(known), 0.8)


def test_a_word_that_all_names_hold_makes_no_pairs(spark):
    r = random.Random(8)
    all_names = sorted({"supplier " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)) for _ in range(400)})
    df = spark.createDataFrame([(x,) for x in all_names], "plain string")
    # measured: 6824 of 159600 pairs, which share a rarer 3-gram; the bound was set after that
    assert names.close_pairs(df, df).where("plain <> other").count() < 0.05 * len(all_names) ** 2


def test_names_by_every_way(spark):
    known = spark.createDataFrame([(1, "Manchester United"), (2, "Real Betis"), (3, "Somewhere Rovers"), (9, "Ajax")], "team_id long, canonical string")
    learned = spark.createDataFrame([("the old lady", 9)], "alias string, team_id long")
    asked = spark.createDataFrame([(x,) for x in ("Man Utd", "Real Betis", "REAL BETIS CF", "The Old Lady", "Somewhere Roverss", "Nobody", "NOBODY FC", "", "  ", "!!")], "name string")
    got = {r.name: (r.team_id, r.how) for r in names.resolve(asked, known, learned=learned, create=True).collect()}
    assert got == {"Man Utd": (1, "curated"), "Real Betis": (2, "exact"), "REAL BETIS CF": (2, "plain"), "The Old Lady": (9, "alias"), "Somewhere Roverss": (3, "close"), "Nobody": (10, "created"), "NOBODY FC": (10, "created")}
    again = names.learn(names.resolve(asked, known, learned=learned, create=True), learned)
    assert {(r.alias, r.team_id) for r in again.collect()} >= {("old lady", 9), ("man utd", 1), ("nobody", 10), ("somewhere roverss", 3)}
    assert names.resolve(asked.limit(0), known).count() == 0


# feeds
def test_feeds_as_data_sources(spark, tmp_path):
    feeds.register(spark)
    (tmp_path / "csv").mkdir()
    for n in ("a", "b"):
        (tmp_path / "csv" / f"{n}.csv").write_text("Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,HS,AS,B365H,Avg>2.5\n16/08/24,20:00,A,B,1,0,10,4,1.5,1.9\n17/08/24,,C,,1,0,1,1,1,1\n18/08/24,,C,D,,,,,1,1\n")
    read = lambda source, capability, path: spark.read.format("touchline").option("source", source).option("capability", capability).load(str(path))
    m = read("publisher_csv", "matches", tmp_path / "csv")
    assert m.rdd.getNumPartitions() == 2 and m.count() == 4 and m.where("status = 'played' and hour(kickoff_utc) = 20").count() == 2
    stats = read("mirror_csv", "team_stats", tmp_path / "csv" / "a.csv").where("home = 'A'").first()
    assert (stats.home_shots, stats.away_shots) == (10, 4)
    (tmp_path / "r.json").write_text('{"matches":[{"date":"2024-08-01","time":"19:30","team1":"A","team2":"B","score":{"ft":[2,1],"ht":[1,0]}},{"date":"2024-08-02","team1":"C","team2":"D","score":[1,2]}]}')
    assert [(r.ft_home_goals, r.status) for r in read("results_json", "matches", tmp_path / "r.json").orderBy("kickoff_date").collect()] == [(2, "played"), (None, "scheduled")]
    teams = '"teams":[{"id":1,"name":"T"},{"id":2,"name":"U"}]'
    (tmp_path / "f.json").write_text(f'{{{teams},"fixtures":[{{"id":5,"kickoff_time":"2024-08-01T18:30:00Z","team_h":1,"team_a":2,"finished":false,"team_h_score":3,"event":7}},{{"id":6,"kickoff_time":null,"team_h":1,"team_a":2}}]}}')
    f = read("fixtures_json", "fixtures", tmp_path / "f.json").collect()
    assert len(f) == 1 and f[0].ft_home_goals is None and f[0].round == "7" and f[0].home == "T"
    (tmp_path / "a.json").write_text(f'{{{teams},"elements":[{{"id":7,"first_name":"X","second_name":"Y","team":1,"status":"d","chance_of_playing_next_round":75,"news":"","news_added":"2024-08-01T10:00:00Z"}}]}}')
    p = read("availability_json", "availability", tmp_path / "a.json").first()
    assert (p.player, p.team_name, p.status, p.chance_of_playing) == ("X Y", "T", "doubtful", 0.75)
    (tmp_path / "gw1.csv").write_text("element,name,team,was_home,kickoff_time,minutes,goals_scored,expected_goals,starts\n7,X,T,True,2024-08-01T10:00:00Z,90,1,0.4,1\n")
    s = read("player_csv", "player_stats", tmp_path / "gw1.csv").first()
    assert (s.player_id, s.minutes, s.goals, s.xg, s.started, s.is_home) == (7, 90, 1, 0.4, True, True)
    (tmp_path / "w.json").write_text('{"hourly":{"time":["2024-08-01T10:00"],"temperature_2m":[20.5],"relative_humidity_2m":[50],"precipitation":[0],"wind_speed_10m":[3]}}')
    assert read("weather_json", "weather", tmp_path / "w.json").first().temperature == 20.5
    none = read("weather_json", "matches", tmp_path / "w.json")
    assert none.count() == 0 and "home" in none.columns
    got = {(r.source, r.capability): (r.status, r.note) for r in feeds.outcomes(spark, [("weather_json", "matches"), ("weather_json", "weather"), ("nobody", "matches")]).collect()}
    assert got["weather_json", "weather"] == ("ok", None) and got["weather_json", "matches"][0] == got["nobody", "matches"][0] == "unsupported"
    with pytest.raises(Exception, match="unknown capability"):
        read("weather_json", "tea", tmp_path / "w.json").count()


# experiments
def test_a_second_run_of_a_grid_fits_nothing(spark, tmp_path):
    ran = []

    def evaluate(config):
        ran.append(config)
        return spark.createDataFrame([("loss", config["k"] * 1.0 + config["ridge"])], "metric string, value double")

    configs = experiments.grid(k=(1, 2), ridge=(0.5, 0.1))
    first, n = experiments.run(spark, configs, evaluate, str(tmp_path / "cache"), "sf")
    assert n == 4 and first.count() == 4 and json.loads(experiments.best(first, "loss").first().config) == {"k": 1, "ridge": 0.1}
    again, n = experiments.run(spark, [*configs, {"ridge": 0.1, "k": 1}, {"k": 3, "ridge": 0.1}], evaluate, str(tmp_path / "cache"), "sf")
    assert n == 1 and len(ran) == 5 and again.count() == 5
    assert experiments.run(spark, configs, evaluate, str(tmp_path / "cache"), "other data")[1] == 4


def test_row_bootstrap_is_near_the_textbook(spark):
    r = np.random.default_rng(1)
    diffs = r.normal(0.1, 1, 2000)
    got = evaluation.bootstrap(spark.createDataFrame([(i, float(x)) for i, x in enumerate(diffs)], "id long, diff double"), 400).first()
    half = 1.96 * diffs.std() / np.sqrt(2000)
    assert got.low == pytest.approx(diffs.mean() - half, abs=0.012) and got.high == pytest.approx(diffs.mean() + half, abs=0.012)


def test_plans_of_features_at_every_kickoff_stay_small(spark):
    """The driver holds each step's plan: a step reads what the one before has written."""
    a = catalog.snapshot(spark, SF)
    assert len(timeline.kickoff_features(a.matches(), a.stats())._jdf.queryExecution().toString()) < 100_000


def test_counts_make_each_cell_once(spark):
    """A distribution of a hundred times as many cells takes about as many times as long, not ten thousand times; a dispersion of one or none is Poisson's."""
    d = spark.createDataFrame([(float(m), x) for m in range(1, 9) for x in (None, 1.0, 0.0, 1.5)], "mean double, dispersion double")
    plan = d.select(scalars.counts(F.col("mean"), F.col("dispersion"), 30).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1  # no second pass over the cells, which a lambda would make once a cell
    for m, x, p in d.select("*", scalars.counts(F.col("mean"), F.col("dispersion"), 30)).collect():
        q = [math.exp(-m) * m**k / math.factorial(k) if x != 1.5 else math.exp(math.lgamma(2 * m + k) - math.lgamma(2 * m) - math.lgamma(k + 1)) * (2 / 3) ** (2 * m) / 3**k for k in range(31)]
        assert p == pytest.approx([y / sum(q) for y in q], rel=1e-9)


def test_count_fits_multiply_no_side_by_its_checkpoints(spark):
    """The rates of the teams that are wanted are those of all teams, and sides stand once in the tables that fits read."""
    a = catalog.snapshot(spark, SF)
    played = a.matches().where("status = 'played'")
    days = backtest.checkpoints(played.where("kickoff_date between '1996-08-01' and '1998-08-02'"), RUN)
    seen = backtest.trained_by(count_runs.sides(played, a.stats(), "corners"), days, RUN).cache()
    wanted = played.select("competition_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team")).distinct().join(days, "competition_id").select("competition_id", "team", F.explode("checkpoints").alias("checkpoint"))
    once, each = count_runs.count_fits(seen, COUNTS, wanted), count_runs.count_fits(backtest.training_sets(count_runs.sides(played, a.stats(), "corners"), days, RUN), COUNTS)
    for x, y in zip(once, each, strict=True):
        rows = [sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.collect()], key=repr) for t in (x, y)]
        assert rows[0] == rows[1] != []
    sizes = []
    before = count_runs.written
    count_runs.written = lambda df, name: sizes.append((name, df.count())) or before(df, name)
    try:
        count_runs.walk_forward_counts(a.matches(), a.stats(), RUN, COUNTS)
    finally:
        count_runs.written = before
    assert all(n <= 2 * played.count() for name, n in sizes) and sum("sides" in name for name, _ in sizes) == 2


def test_md5_starts_are_md5s():
    for head, size in ((b"7:0", 0), (b"7:12", 3), (b"7:399", 9), (b"seed:3", 20), (b"x" * 20, 35)):
        tails = np.random.default_rng(size).integers(0, 256, (50, size), np.uint8)
        assert evaluation.md5_starts(head, tails).tolist() == [int(hashlib.md5(head + t.tobytes()).hexdigest()[:8], 16) for t in tails]


def test_row_bootstrap_draws_in_the_task_where_the_row_is(spark):
    """Rows aren't multiplied by replicates; draws are those of the definition, for long, missing and repeated ids too."""
    rows = [("1", 0.5), ("22", -0.25), ("x" * 70, 1.5), (None, 2.0), ("22", 0.125), ("ü", None)]
    df = spark.createDataFrame(rows, "id string, diff double")
    edges, means = evaluation.poisson_edges(), []
    for r in range(60):
        k = [sum(int(hashlib.md5(":".join(["7", str(r), *([i] if i is not None else [])]).encode()).hexdigest()[:8], 16) / 2**32 >= e for e in edges) for i, _ in rows]
        means += [sum(n * d for n, (_, d) in zip(k, rows, strict=True) if d is not None) / sum(k)] if sum(k) else []
    got = evaluation.bootstrap(df, 60)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert tuple(got.first()) == pytest.approx((0.775, *np.quantile(means, [0.025, 0.975])), abs=1e-6)


def test_a_batch_reads_the_order_lines_once(spark):
    """What is folded, and what the log counts, comes from tables: matches aren't derived again for each source, store and log."""
    folded, staged = catalog_ingest.batch(spark, SF)
    for rows in (folded, staged, ingest.run_log(folded, staged)):
        assert "lineitem" not in rows._jdf.queryExecution().optimizedPlan().toString() and not any("lineitem" in f for f in rows.inputFiles())
    assert ingest.run_log(folded, staged).agg(F.sum("records")).first()[0] == catalog_ingest.staged_records(spark, SF).count()


def _scattered(spark):
    """Results of a dozen teams that become known up to two months late, several at once, some never; statistics of most sides."""
    r, rows, stats = np.random.default_rng(4), [], []
    for n in range(420):
        home, away = (int(x) for x in r.choice(12, 2, replace=False))
        day = dt.date(2024, 3, 1) + dt.timedelta(days=int(r.integers(0, 260)))
        kick = dt.datetime.combine(day, dt.time(int(r.integers(12, 20)))) if r.random() < 0.5 else None
        known = None if r.random() < 0.03 else dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1 + int(r.choice([0, 0, 0, 7, 60])))
        rows.append((n, n % 2, home, away, int(r.integers(0, 5)), int(r.integers(0, 4)), day, kick, "played" if r.random() < 0.95 else "scheduled", known))
        stats += [(n, t, int(r.integers(0, 9))) for t in (home, away) if r.random() < 0.9]
    return spark.createDataFrame(rows, "id long, competition_id long, home_team_id long, away_team_id long, ft_home_goals int, ft_away_goals int, kickoff_date date, kickoff_utc timestamp, status string, known_at timestamp"), spark.createDataFrame(stats, "match_id long, team_id long, shots_on_target int")


def test_features_at_every_kickoff_of_late_results_equal_sql(spark):
    """Results that become known out of their order, against the SQL; and of some matches alone, those of all."""
    m, s = _scattered(spark)
    own = catalog_forward.FEATURES_SQL[catalog_forward.FEATURES_SQL.index("facts as (") :]
    want = sorted(duck_tables(m, s).sql(f"with matches as (select * replace (kickoff_date::date as kickoff_date) from m), stats as (select * from s), {own}").fetchall())
    got = sorted(tuple(r) for r in timeline.kickoff_features(m, s).collect())
    assert len(got) == len(want) == 420 and sum(r[19] != 1.0 for r in got) > 100
    for x, y in zip(got, want, strict=True):
        assert x == pytest.approx(y, abs=1.1e-3), x[0]  # indices are rounded to three digits
    some = m.where("id % 7 = 0").select("id")
    assert sorted(tuple(r) for r in timeline.kickoff_features(m, s, some).collect()) == [x for x in got if x[0] % 7 == 0]


def test_streams_of_a_team_hold_its_newest_results_alone(monkeypatch):
    """A team's rows give the same whether they are worked on two at a time or at once, and no list of its history is sent: a result has steps for its newest opponents' window."""
    n = 600
    col = {"team_id": [7] * n, "ts": [i // 2 * 10 for i in range(n)], "day": [i // 2 - i % 5 for i in range(n)], "id": list(range(n)), "is_home": [i % 2 for i in range(n)], "other": [8] * n, "asked": [1] * n}
    col |= {"gf": [float(i * 7 % 5) for i in range(n)], "ga": [float(i * 3 % 4) for i in range(n)], "sot": [None if i % 9 == 0 else 2.0 for i in range(n)], "sota": [1.0] * n}
    made = {}
    for size in (2, 2048):
        monkeypatch.setattr(timeline, "AT_ONCE", size)
        told = pa.Table.from_batches(list(timeline._told(30, 5)(pa.table(col).to_batches(max_chunksize=100)))).sort_by("id")
        assert told.num_rows == n and max(map(len, told["since"].to_pylist())) <= 45
        facts = [r | {"kind": 0} for r in told.to_pylist()]
        rows = sorted([*facts, *({k: None for k in facts[0]} | {"team_id": 8, "ts": 5 + 10 * i, "day": i, "id": i, "is_home": 0, "kind": 1} for i in range(300))], key=lambda r: (r["ts"], r["kind"]))
        made[size] = pa.Table.from_batches(list(timeline._answered(20, 5)(pa.Table.from_pylist(rows, pa.schema([*told.schema, pa.field("kind", pa.int64())])).to_batches(max_chunksize=64)))).sort_by("id").to_pylist()
    assert len(made[2]) == 300 and repr(made[2]) == repr(made[2048])


def test_places_are_those_of_a_sorted_list():
    r, held, plain = np.random.default_rng(2), timeline.Places(4), []
    for _ in range(2000):
        if plain and r.random() < 0.45:
            key = plain.pop(int(r.integers(len(plain))))
            held.drop(key)
        else:
            key = (int(r.integers(50)), int(r.integers(10**6)))
            held.add(key)
            bisect.insort(plain, key)
        if plain:
            key = plain[int(r.integers(len(plain)))]
            assert held.from_top(key) == len(plain) - bisect.bisect_left(plain, key)


def test_fits_read_only_what_their_model_needs(spark, monkeypatch):
    """The regression's matches are the newest of each training set, ties of a day and late results included; features are made of no others."""
    m, _ = _scattered(spark)
    played = m.where("status = 'played'")
    days = spark.createDataFrame([(c, [dt.date(2024, 7, 1), dt.date(2024, 9, 1), dt.date(2024, 12, 31)]) for c in (0, 1)], "competition_id long, checkpoints array<date>")
    sets = {}
    for r in backtest.training_sets(played, days, RUN).collect():
        sets.setdefault((r.competition_id, r.checkpoint), []).append((r.kickoff_date, r.id))
    for most in (1, 37, 10**6):
        got = {}
        for r in backtest.newest_trained(played, days, dataclasses.replace(RUN, most_rows=most)).collect():
            got.setdefault((r.competition_id, r.checkpoint), set()).add(r.id)
        assert got == {k: {i for _, i in sorted(v)[-most:]} for k, v in sets.items()}
    asked = []
    monkeypatch.setattr(analysis, "kickoff_features", lambda rows, stats, of: asked.append(of.count()) or timeline.kickoff_features(rows, stats, of))
    monkeypatch.setattr(analysis.backtest, "fits", lambda played, days, newest, featured, run: asked.append(featured.count()))
    a = catalog.snapshot(spark, SF)
    analysis.fitted_at(a, "1998-06-15", dataclasses.replace(RUN, most_rows=5))
    assert asked == [25, 25] and a.completed().count() > 100
