"""The catalogue continued: evaluation, judgement, merging, parsing, models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars
from touchline.operators import asof, evaluation, features, judgement, merge, names, scores
from touchline.session import spread, written
from touchline.sources import derived

from . import models
from .base_sql import AS_OF, SEASON_START, SINCE, over
from .catalog import ORACLE, _ADJUSTED, cut, query, snapshot

#: Two rule-based models' probabilities of every played match; the second declines some home sides.
_PREDS = """played as (select *, (home_team_id % 10 - away_team_id % 9) * 0.1::double as s, case when ft_home_goals > ft_away_goals then 'H' when ft_home_goals = ft_away_goals then 'D' else 'A' end as outcome from matches where status = 'played'),
preds as (
  select id, competition_id, kickoff_date, outcome, model, eh / (eh + 1 + ea) as home, 1 / (eh + 1 + ea) as draw, ea / (eh + 1 + ea) as away
  from (select *, 'steep' as model, exp(s + 0.3::double) as eh, exp(-s) as ea from played union all select *, 'flat', exp(0.5::double * s + 0.2::double), exp(-0.5::double * s) from played where home_team_id % 7 <> 0)
)"""


def predictions(spark, d) -> DataFrame:
    m = derived.matches(spark, d).where("status = 'played'")
    h, a = F.col("ft_home_goals"), F.col("ft_away_goals")
    m = m.withColumn("s", (F.col("home_team_id") % 10 - F.col("away_team_id") % 9) * 0.1).withColumn("outcome", F.when(h > a, "H").when(h == a, "D").otherwise("A"))
    both = F.array(F.struct(F.lit("steep").alias("model"), F.exp(F.col("s") + 0.3).alias("eh"), F.exp(-F.col("s")).alias("ea")), F.when(F.col("home_team_id") % 7 != 0, F.struct(F.lit("flat").alias("model"), F.exp(0.5 * F.col("s") + 0.2).alias("eh"), F.exp(-0.5 * F.col("s")).alias("ea"))))
    r = m.select("id", "competition_id", "kickoff_date", "outcome", F.explode(F.array_compact(both)).alias("p")).select("*", "p.*").drop("p")
    total = F.col("eh") + 1 + F.col("ea")
    return r.select("id", "competition_id", "kickoff_date", "outcome", "model", (F.col("eh") / total).alias("home"), (1 / total).alias("draw"), (F.col("ea") / total).alias("away"))


_TRUTH = "case outcome when 'H' then home when 'D' then draw else away end"
_LL = f"-ln(least(greatest({_TRUTH}, 1e-15), 1.0))"


@query(over("matches", f"select model, count(*) as n, round(avg({_LL}), 6) as log_loss, round(avg(pow(home - (outcome = 'H')::int, 2) + pow(draw - (outcome = 'D')::int, 2) + pow(away - (outcome = 'A')::int, 2)), 6) as brier, round(avg(((case when home >= draw and home >= away then 'H' when draw >= away then 'D' else 'A' end) = outcome)::int), 6) as accuracy from preds group by 1", _PREDS))
def outcome_scoring(spark, d):
    return evaluation.outcome_scores(predictions(spark, d))


@query(over("matches", "select model, count(*) as n, round(avg(-case when outcome = 'H' then ln(home) else ln(1 - home) end), 6) as log_loss, round(avg(pow(home - (outcome = 'H')::int, 2)), 6) as brier from preds group by 1", _PREDS))
def binary_scoring(spark, d):
    return evaluation.binary_scores(predictions(spark, d).select("model", F.col("home").alias("p"), (F.col("outcome") == "H").alias("truth")))


@query(over("matches", "select model, count(*) as n, round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse, round(avg(e), 6) as bias from (select model, 3 * home + draw - case outcome when 'H' then 3 when 'D' then 1 else 0 end as e from preds) group by 1", _PREDS))
def numeric_scoring(spark, d):
    p = predictions(spark, d)
    return evaluation.numeric_scores(p.select("model", (3 * F.col("home") + F.col("draw")).alias("x"), F.when(F.col("outcome") == "H", 3).when(F.col("outcome") == "D", 1).otherwise(0).alias("y")), "x", "y")


_EDGE = " ".join(f"when home < {e!r}::double then {i}" for i, e in enumerate(evaluation.EDGES[1:10]))


@query(over("matches", "select model, bin, n, round(m, 6) as mean_predicted, round(f, 6) as frequency, round(sum(n * abs(m - f)) over (partition by model) / sum(n) over (partition by model), 6) as ece from (select model, case " + _EDGE + " else 9 end as bin, count(*) as n, avg(home) as m, avg((outcome = 'H')::int) as f from preds group by 1, 2)", _PREDS))
def calibration_ece(spark, d):
    return evaluation.calibration(predictions(spark, d).select("model", F.col("home").alias("p"), (F.col("outcome") == "H").alias("truth")))


@query(over("matches", "select n, round(-(h * ln(h) + d * ln(d) + a * ln(a)), 6) as base_rate_log_loss, round(1 - h * h - d * d - a * a, 6) as base_rate_brier, round(greatest(h, d, a), 6) as base_rate_accuracy, round(h, 6) as always_home_accuracy from (select count(*) as n, avg((outcome = 'H')::int) as h, avg((outcome = 'D')::int) as d, avg((outcome = 'A')::int) as a from played)", _PREDS))
def baseline_scores(spark, d):
    return evaluation.baselines(predictions(spark, d).where("model = 'steep'"))


@query(over("matches", """select round(d, 6) as difference, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, round(avg((m < 0)::int), 6) as p_better from (
  select r, sum(s) / sum(n) as m from (select r, ('0x' || substr(md5('7:' || r || ':' || j), 1, 8))::bigint % b as k from (select k as j, b from numbered, (select count(*) as b from blocks)), (select unnest(range(0, 200)) as r)) join numbered using (k) group by 1), (select sum(s) / sum(n) as d from blocks) group by d""", _PREDS,
    f"blocks as (select a.competition_id, isoyear(a.kickoff_date) as y, week(a.kickoff_date) as w, sum(a.l - b.l) as s, count(*) as n from (select *, {_LL} as l from preds where model = 'steep') a join (select *, {_LL} as l from preds where model = 'flat') b using (id) group by 1, 2, 3)",
    "numbered as (select *, row_number() over (order by competition_id, y, w) - 1 as k from blocks)"))
def paired_bootstrap_md5(spark, d):
    """A sample of 200 replicates, as its SQL has it; paired_bootstrap_md5_4000 is the whole."""
    return _bootstrap(spark, d, 200)


@query(ORACLE["paired_bootstrap_md5"].replace("range(0, 200)", "range(0, 4000)"))
def paired_bootstrap_md5_4000(spark, d):
    return _bootstrap(spark, d, 4000)


def _bootstrap(spark, d, replicates: int) -> DataFrame:
    p = predictions(spark, d).withColumn("l", evaluation.log_loss())
    a, b = p.where("model = 'steep'"), p.where("model = 'flat'").select("id", F.col("l").alias("other"))
    return evaluation.paired_bootstrap(a.join(b, "id").select("competition_id", F.col("kickoff_date").alias("day"), (F.col("l") - F.col("other")).alias("diff")), replicates)


@query(over("matches", "select id from preds group by 1 having count(distinct model) = 2", _PREDS))
def complete_model_set(spark, d):
    return evaluation.complete_set(predictions(spark, d), 2)


@query(over("matches", "select id, competition_id from preds p where model = 'steep' and not exists (select 1 from preds q where q.id = p.id and model = 'flat')", _PREDS))
def coverage_anti_join(spark, d):
    p = predictions(spark, d)
    return p.where("model = 'steep'").join(p.where("model = 'flat'").select("id"), "id", "left_anti").select("id", "competition_id")


@query(over("matches", "select id, round(sum(home * w) / sum(w), 6) as home, round(sum(draw * w) / sum(w), 6) as draw, round(sum(away * w) / sum(w), 6) as away, count(*) as models from (select *, case model when 'steep' then 0.6::double else 0.4::double end as w from preds) group by 1", _PREDS))
def ensemble_combine(spark, d):
    return evaluation.combine(predictions(spark, d), {"steep": 0.6, "flat": 0.4})


@query(over("matches", "select competition_id, round(avg((outcome = 'H')::int), 6) as home, round(avg((outcome = 'D')::int), 6) as draw, round(avg((outcome = 'A')::int), 6) as away, count(*) as n from played where kickoff_date < date '1999-01-01' group by 1", _PREDS))
def outcome_base_rates(spark, d):
    p = predictions(spark, d).where("model = 'steep' and kickoff_date < date '1999-01-01'")
    share = lambda o: F.round(F.avg((F.col("outcome") == o).cast("double")), 6)
    return p.groupBy("competition_id").agg(share("H").alias("home"), share("D").alias("draw"), share("A").alias("away"), F.count("*").alias("n"))


@query(over("matches", "select model, round(max(v) filter (metric = 'log_loss'), 6) as log_loss, round(max(v) filter (metric = 'brier'), 6) as brier from (select model, 'log_loss' as metric, avg(" + _LL + ") as v from preds group by 1 union all select model, 'brier', avg(pow(home - (outcome = 'H')::int, 2) + pow(draw - (outcome = 'D')::int, 2) + pow(away - (outcome = 'A')::int, 2)) from preds group by 1) group by 1", _PREDS))
def backtest_metric_pivot(spark, d):
    r = evaluation.outcome_scores(predictions(spark, d)).select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("log_loss", "brier")])).alias("x")).select("model", "x.*")
    return r.groupBy("model").pivot("metric", ["log_loss", "brier"]).agg(F.max("v"))


@query(over("matches", """select id, created_at, version, superseded, concat_ws(';', case when abs(home - ph) >= 0.01 then 'home:' || printf('%.2f', home - ph) end, case when abs(draw - pd) >= 0.01 then 'draw:' || printf('%.2f', draw - pd) end, case when abs(away - pa) >= 0.01 then 'away:' || printf('%.2f', away - pa) end) as changes from (
  select *, row_number() over w as version, lead(created_at) over w is not null as superseded, lag(home) over w as ph, lag(draw) over w as pd, lag(away) over w as pa from (select id, case model when 'steep' then 1 else 2 end as created_at, home, draw, away from preds) window w as (partition by id order by created_at))""", _PREDS))
def prediction_versions(spark, d):
    rows = predictions(spark, d).withColumn("created_at", F.when(F.col("model") == "steep", 1).otherwise(2))
    return evaluation.versions(rows).withColumn("version", F.col("version").cast("long"))


@query(over("matches", """, steps(competition_id, checkpoint) as (
  select competition_id, min(kickoff_date) from done group by 1
  union all
  select s.competition_id, (select min(kickoff_date) from done m where m.competition_id = s.competition_id and m.kickoff_date >= s.checkpoint + 28) from steps s where exists (select 1 from done m where m.competition_id = s.competition_id and m.kickoff_date >= s.checkpoint + 28)
) select * from steps""", "done as (select distinct competition_id, kickoff_date from matches where status = 'played')").replace("with ", "with recursive ", 1).replace("\n, steps", ", steps"))
def refit_checkpoints(spark, d):
    return evaluation.refit_checkpoints(derived.matches(spark, d).where("status = 'played'").select("competition_id", F.col("kickoff_date").alias("day")))


@query(over("hist", "select id, team_id, stat, value::double as value from (select id, team_id, unnest(['goals_for', 'shots', 'shots_on_target', 'corners', 'fouls', 'yellows', 'reds']) as stat, unnest([goals_for * 4, shots * 3, shots_on_target, corners, fouls * 2, yellows, reds]) as value, unnest([12, 50, 30, 25, 40, 12, 5]) as hi from hist) where value > hi or value < 0"))
def suspicious_values(spark, d):
    rows = cut(spark, d).history()
    return judgement.suspicious(rows.withColumn("goals_for", F.col("goals_for") * 4).withColumn("shots", F.col("shots") * 3).withColumn("fouls", F.col("fouls") * 2))


_COVER = ", ".join(f"round(avg(({s} is not null)::int), 3) as {s}" for s in judgement.COVERED)


@query(over("hist", f"select team_id, count(*) as n, max(kickoff_date) as last_date, {_COVER} from hist80 group by 1"))
def stat_coverage(spark, d):
    return judgement.coverage(cut(spark, d).history(newest_rows=80))


_MISSING = " + ".join(f"coalesce(({p}.{s} = 0)::int, 0)" for p in "ha" for s in judgement.COVERED)
_SPARSE = " + ".join(f"coalesce(({p}.{s} > 0 and {p}.{s} < 0.5)::int, 0)" for p in "ha" for s in judgement.COVERED)


@query(over("hist", "select *, case when score <= 0 or least(home_matches, away_matches) = 0 then 'INSUFFICIENT' when score >= 0.8 and serious = 0 then 'HIGH' when score >= 0.55 then 'MEDIUM' else 'LOW' end as tier, round(0.35 + 0.65 * score, 6) as confidence from (select id, home_matches, away_matches, h2h_matches, serious, warnings, infos, freshness_days, round(least(greatest(case when least(home_matches, away_matches) = 0 then 0 when least(home_matches, away_matches) < 5 then 0.35 when least(home_matches, away_matches) < 10 then 0.6 when least(home_matches, away_matches) < 20 then 0.85 else 1 end::double * greatest(0.3::double, 1 - 0.15::double * serious) * greatest(0.5::double, 1 - 0.05::double * warnings) * (0.9::double * 0.95::double * 0.92::double) * case when freshness_days > 45 then 0.85::double else 1 end, 0), 1), 6) as score from q)",
    f"cover as (select team_id, count(*) as n, max(kickoff_date) as last_date, {_COVER} from hist80 group by 1)", "met as (select team_id, opponent_id, least(count(*), 12) as n from hist group by 1, 2)",
    f"""q as (select *, ((home_matches < 5)::int + (away_matches < 5)::int + coalesce((freshness_days > 45)::int, 0))::int as serious, ((home_matches between 5 and 9)::int + (away_matches between 5 and 9)::int + coalesce((freshness_days between 22 and 45)::int, 0) + 1 + miss)::int as warnings, ((h2h_matches < 3)::int + (lead_days > 10)::int + sparse)::int as infos from (
  select m.id, coalesce(h.n, 0)::bigint as home_matches, coalesce(a.n, 0)::bigint as away_matches, coalesce(met.n, 0)::bigint as h2h_matches, date_diff('day', greatest(h.last_date, a.last_date), date '{AS_OF[:10]}')::int as freshness_days, date_diff('day', date '{AS_OF[:10]}', m.kickoff_date) as lead_days, {_MISSING} as miss, {_SPARSE} as sparse
  from matches m left join cover h on h.team_id = home_team_id left join cover a on a.team_id = away_team_id left join met on met.team_id = home_team_id and met.opponent_id = away_team_id where status = 'scheduled'))"""))
def quality_tier(spark, d):
    a = snapshot(spark, d)
    fixtures = a.scheduled().select("id", "home_team_id", "away_team_id", "kickoff_date")
    meetings = a.head_to_head(12).groupBy("team_id", "opponent_id").agg(F.count("*").alias("matches"))
    return judgement.quality(fixtures, judgement.coverage(a.history(newest_rows=80)), meetings, AS_OF)


def explanation_rows(a: asof.AsOf) -> DataFrame:
    h = a.history(newest_rows=80)
    more = h.groupBy("team_id").agg(F.count(F.when(F.col("is_home"), 1)).alias("n_home"), F.count(F.when(~F.col("is_home"), 1)).alias("n_away")).join(features.form_points(h).select("team_id", "trend"), "team_id")
    teams = features.team_features(a, AS_OF).join(more, "team_id", "left")
    table = features.league_table(a.history(since=SEASON_START)).select("competition_id", "team_id", "position")
    met = features.head_to_head(a).select(F.col("team_id").alias("home_team_id"), F.col("opponent_id").alias("away_team_id"), F.col("matches").alias("meetings"), "wins", "losses")
    r = a.scheduled().select("id", "competition_id", "home_team_id", "away_team_id")
    for p in ("home", "away"):
        r = r.join(teams.select(*[F.col(c).alias(f"{p}_{c}") for c in teams.columns]), f"{p}_team_id", "left").join(table.select("competition_id", F.col("team_id").alias(f"{p}_team_id"), F.col("position").alias(f"{p}_position")), ["competition_id", f"{p}_team_id"], "left")
    return r.join(met, ["home_team_id", "away_team_id"], "left").join(features.league_baseline(a, SINCE).select("competition_id", "avg_home_goals"), "competition_id", "left")


def _rule(when, category, home, impact):
    return f"select id, '{category}' as category, case when {home} then 'home' else 'away' end as favours, round({impact}, 6) as impact from e where {when}"


_G = lambda a, b: f"(({a}) - ({b})) / nullif((abs({a}) + abs({b})) / 2, 0)"
_TEN = "h_n >= 6 and a_n >= 6"


@query(over("hist", " union all ".join([
    _rule(f"{_TEN} and abs(g1) >= 0.12", "attack", "g1 > 0", "least(abs(g1), 1) * 0.9"), _rule(f"{_TEN} and not coalesce(abs(g1) >= 0.12, false) and abs(g2) >= 0.12", "attack", "g2 > 0", "least(abs(g2), 1) * 0.6"),
    _rule(f"{_TEN} and abs(g3) >= 0.12", "defence", "g3 > 0", "least(abs(g3), 1) * 0.85"), _rule("h_n_home >= 6 and h_ppg <> 0 and abs(h_ppg_home - h_ppg) >= 0.25", "venue", "h_ppg_home > h_ppg", "least(abs(h_ppg_home - h_ppg) / 1.5, 1) * 0.8"),
    _rule("a_n_away >= 6 and a_ppg <> 0 and abs(a_ppg_away - a_ppg) >= 0.25", "venue", "a_ppg_away < a_ppg", "least(abs(a_ppg_away - a_ppg) / 1.5, 1) * 0.8"), _rule("a_n_away >= 6 and a_ga_away / ahg - 1 > 0.15", "defence", "true", "least(a_ga_away / ahg - 1, 1) * 0.7"),
    _rule(f"{_TEN} and abs(g4) >= 0.12", "chance_creation", "g4 > 0", "least(abs(g4), 1) * 0.65"), _rule("abs(h_trend) >= 0.4", "form", "h_trend > 0", "least(abs(h_trend) / 1.5, 1) * 0.6"), _rule("abs(a_trend) >= 0.4", "form", "a_trend < 0", "least(abs(a_trend) / 1.5, 1) * 0.6"),
    _rule("abs(ap - hp) >= 4", "standing", "ap > hp", "least(abs(ap - hp) / 15, 1) * 0.55"), _rule("abs(h_rest - a_rest) >= 2", "rest", "h_rest > a_rest", "least(abs(h_rest - a_rest) / 7, 1) * 0.45"), _rule("abs(h_busy - a_busy) >= 2", "congestion", "h_busy < a_busy", "least(abs(h_busy - a_busy) / 4, 1) * 0.4"),
    _rule("meetings >= 5 and abs(wins - losses) >= 2", "head_to_head", "wins > losses", "least(abs(wins - losses) / meetings, 1) * 0.4"), _rule("hs >= 8 and as_ >= 8 and abs(g5) >= 0.12", "strength_adjusted", "g5 > 0", "least(abs(g5), 1) * 0.75")]),
    _ADJUSTED,
    f"""tf as (select *, round(ppg5 - ppg, 3) as trend from (select team_id, avg(goals_for) filter (rn <= 10) as gf10, avg(goals_against) filter (rn <= 10) as ga10, avg(goals_for) as gf, avg(goals_against) filter (not is_home) as ga_away, avg(shots_on_target) filter (rn <= 10) as sot10, round(avg(points) filter (rn <= 5), 3) as ppg5, round(avg(points), 3) as ppg,
  avg(points) filter (is_home) as ppg_home, avg(points) filter (not is_home) as ppg_away, count(*) as n, count(*) filter (is_home) as n_home, count(*) filter (not is_home) as n_away, min(date_diff('day', kickoff_date, date '{AS_OF[:10]}')) as rest, count(*) filter (date_diff('day', kickoff_date, date '{AS_OF[:10]}') <= 14) as busy from hist80 group by 1))""",
    f"places as ({ORACLE['league_table'][ORACLE['league_table'].rindex('select competition_id, team_id, played'):]})",
    "met as (select team_id, opponent_id, count(*) as meetings, count(*) filter (points = 3) as wins, count(*) filter (points = 0) as losses from (select *, row_number() over (partition by team_id, opponent_id order by kickoff_date desc, id desc) as k from hist) where k <= 12 group by 1, 2)",
    f"home_goals as (select competition_id, round(avg(ft_home_goals), 3) as ahg from done where kickoff_date >= date '{SINCE}' group by 1)",
    f"""e as (select m.id, {", ".join(f"{p}.{c} as {p}_{c}" for p in "ha" for c in ("n", "n_home", "n_away", "ppg", "ppg_home", "ppg_away", "ga_away", "trend", "rest", "busy"))}, hp.position as hp, ap.position as ap, meetings, wins, losses, hj.attack_sample as hs, aj.attack_sample as as_, ahg,
  {_G("h.gf10", "a.gf10")} as g1, {_G("h.gf", "a.gf")} as g2, {_G("a.ga10", "h.ga10")} as g3, {_G("h.sot10", "a.sot10")} as g4, {_G("hj.attack_index", "aj.attack_index")} as g5
  from matches m left join tf h on h.team_id = home_team_id left join tf a on a.team_id = away_team_id left join adjusted hj on hj.team_id = home_team_id left join adjusted aj on aj.team_id = away_team_id left join places hp on hp.team_id = home_team_id and hp.competition_id = m.competition_id left join places ap on ap.team_id = away_team_id and ap.competition_id = m.competition_id
  left join met on met.team_id = home_team_id and met.opponent_id = away_team_id left join home_goals g on g.competition_id = m.competition_id where status = 'scheduled')"""))
def explanation_factors(spark, d):
    return judgement.explain(explanation_rows(snapshot(spark, d))).drop("statement")


def _two_sources(spark, d):
    m = derived.matches(spark, d)
    old = m.select("id", F.lit(0.85).alias("reliability"), "ft_home_goals", F.when(F.col("id") % 3 != 0, F.col("ft_away_goals")).alias("ft_away_goals"), F.when(F.col("id") % 5 != 0, F.col("referee")).alias("referee"))
    new = m.where("home_team_id <> 3").select("id", F.when(F.col("id") % 2 == 0, 0.90).otherwise(0.60).alias("reliability"), F.when(F.col("id") % 11 == 0, F.col("ft_home_goals") + 1).otherwise(F.col("ft_home_goals")).alias("ft_home_goals"), "ft_away_goals", F.when(F.col("id") % 7 != 0, F.concat("referee", F.lit("x"))).alias("referee"))
    return old, new


@query(over("matches", "select id, " + ", ".join(f"case when o.{c} is null or (coalesce(n.reliability >= o.reliability, false) and n.{c} is not null) then coalesce(n.{c}, o.{c}) else o.{c} end as {c}" for c in ("ft_home_goals", "ft_away_goals", "referee")) + ", case when n.reliability >= o.reliability then n.reliability else o.reliability end as reliability, concat_ws(',', " + ", ".join(f"case when o.{c} <> n.{c} then '{c}' end" for c in ("ft_home_goals", "ft_away_goals", "referee")) + ") as conflicts from o left join n using (id)",
    "o as (select id, 0.85::double as reliability, ft_home_goals, case when id % 3 <> 0 then ft_away_goals end as ft_away_goals, case when id % 5 <> 0 then referee end as referee from matches)", "n as (select id, case when id % 2 = 0 then 0.90::double else 0.60::double end as reliability, case when id % 11 = 0 then ft_home_goals + 1 else ft_home_goals end as ft_home_goals, ft_away_goals, case when id % 7 <> 0 then referee || 'x' end as referee from matches where home_team_id <> 3)"))
def merge_two_sources(spark, d):
    return merge.merge(*_two_sources(spark, d), "id", ["ft_home_goals", "ft_away_goals", "referee"])


@query(over("matches", "select row_id, match_id, day from (select r.*, m.id as match_id, row_number() over (partition by row_id order by abs(date_diff('day', day, m.kickoff_date)) nulls last, m.kickoff_date, m.id) as k from r left join matches m on m.competition_id = r.competition_id and m.home_team_id = r.home_team_id and m.away_team_id = r.away_team_id and abs(date_diff('day', day, m.kickoff_date)) <= 1) where k = 1", "r as (select id as row_id, competition_id, home_team_id, away_team_id, kickoff_date + (id % 4)::int - 1 as day from matches)"))
def nearby_match_join(spark, d):
    m = derived.matches(spark, d)
    rows = m.select(F.col("id").alias("row_id"), "competition_id", "home_team_id", "away_team_id", F.date_add("kickoff_date", (F.col("id") % 4).cast("int") - 1).alias("day"))
    return merge.near_date(rows, m).select("row_id", "match_id", "day")


@query("""select o_orderkey, case when o_orderkey % 9 = 0 then null else trunc(o_totalprice)::int end as whole, case when o_orderkey % 9 = 0 then null else o_totalprice end as number, o_orderdate::date as day
from orders""")
def parse_csv_fields(spark, d):
    o = derived.table(spark, d, "orders")
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 9 == 0, F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("n/a")).otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
    written = F.when(k == 0, F.date_format(day, "dd/MM/yyyy")).when(k == 1, F.date_format(day, "d/M/yy")).when(k == 2, F.date_format(day, "yyyy-MM-dd")).when(k == 3, F.date_format(day, "dd-MM-yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    return o.select("o_orderkey", scalars.to_whole(text).alias("whole"), scalars.to_number(text).alias("number"), scalars.to_day(written).alias("day"))


@query("""select event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) as k, count(*) as n from events where json_extract_string(props, '$.k') is not null group by 1""")
def weights_lookup_variant(spark, d):
    e = derived.table(spark, d, "events").withColumn("k", F.expr("try_variant_get(try_parse_json(props), '$.k', 'string')")).where("k is not null")
    newest = F.struct("ts", "event_id")
    return e.groupBy("event_type").agg(F.max_by("event_id", newest).alias("event_id"), F.max_by("k", newest).alias("k"), F.count("*").alias("n"))


@query("select s_suppkey as team_id, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) as plain from supplier")
def plain_names(spark, d):
    s = derived.table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("team_id"), scalars.plain_name(F.col("s_name")).alias("plain"))


@query()
def team_name_resolution(spark, d):
    s = derived.table(spark, d, "supplier")
    known = s.select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("canonical"))
    spelled = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).when(F.col("s_suppkey") % 3 == 1, F.upper(F.concat(F.col("s_name"), F.lit(" FC")))).otherwise(F.concat(F.col("s_name"), F.lit("x")))
    return names.resolve(s.select(spelled.alias("name")), known)


def _played(spark, d):
    return cut(spark, d).completed()


def fold_sql(source: str, keys: str = "competition_id", least: int = 0) -> str:
    """The fold as a recursion over the matches of each group of source (a relation with the keys) in order, the ratings held as a map: tables elo, last_ratings
    and curve (the draw's line by group); least: the fewest matches of a group."""
    match = " and ".join(f"s.{k} = f.{k}" for k in keys.split(", "))
    return f"""scored as (
  select *, row_number() over (partition by {keys} order by kickoff_date, id) as n, year(kickoff_date) - case when month(kickoff_date) < 7 then 1 else 0 end as season,
    case when ft_home_goals > ft_away_goals then 1.0::double when ft_home_goals < ft_away_goals then 0.0::double else 0.5::double end as score, ln(abs(ft_home_goals - ft_away_goals) + 1.0::double) * 2.2::double as margin
  from {source} where ft_home_goals is not null and ft_away_goals is not null
), fold as (
  select distinct {keys}, 0::bigint as n, null::bigint as season, map([]::bigint[], []::double[]) as r, null::bigint as id, null::double as home_before, null::double as away_before, null::double as gap, false as drawn from scored
  union all
  select {keys}, n, season, map_concat(r, map([h, a], [hb + move, ab - move])), id, hb, ab, gap, score = 0.5 from (
    select *, 20 * margin / (0.001::double * abs(gap) + 2.2::double) * (score - 1 / (1 + pow(10::double, -gap / 400))) as move from (
      select *, hb + 60 - ab as gap from (
        select *, coalesce(r[h], 1500::double) as hb, coalesce(r[a], 1500::double) as ab from (
          select {', '.join('s.' + k for k in keys.split(', '))}, s.n, s.season, s.score, s.margin, s.id, s.home_team_id::bigint as h, s.away_team_id::bigint as a,
            case when f.season <> s.season then map_from_entries(list_transform(map_entries(f.r), lambda e: {{'k': e.key, 'v': e.value + 0.1::double * (1500 - e.value)}})) else f.r end as r
          from fold f join scored s on {match} and s.n = f.n + 1))))
), elo as (select id, {keys}, home_before, away_before, gap, drawn from fold where n > 0
), last_ratings as (select {keys}, n, r from fold where n > 0 qualify n = max(n) over (partition by {keys})
), g as (select {keys}, abs(gap) as g, drawn::int::double as y from elo
), edges as (select {keys}, [quantile_cont(g, 0.0), quantile_cont(g, 0.2), quantile_cont(g, 0.4), quantile_cont(g, 0.6), quantile_cont(g, 0.8), quantile_cont(g, 1.0)] as e from g group by {keys}
), fifths as (
  select {keys}, i, avg(g) as x, ln(least(greatest(avg(y), 1e-3), 0.999::double)) as lp from g join edges using ({keys}), range(1, 6) as t(i) where g >= e[i] and g <= e[i + 1] group by {keys}, i having count(*) >= 30
), line as (select {keys}, count(*) as k, exp(regr_intercept(lp, x)) as b, -regr_slope(lp, x) as d from fifths group by {keys}
), curve as (
  select {keys}, n, round(case when ok then b else share end, 6) as base, round(case when ok then d else 0 end, 6) as decay
  from (select {keys}, count(*) as n, avg(y) as share from g group by {keys}) left join (select *, coalesce(k >= 3 and b between 0.05 and 0.6 and d between 0 and 0.02, false) as ok from line) using ({keys}) where n >= {least}
)"""


def _elo_sql(select: str) -> str:
    return over("hist", select, fold_sql("done")).replace("with ", "with recursive ", 1)


@query(_elo_sql("select id, competition_id, round(home_before, 6) as home_before, round(away_before, 6) as away_before, round(gap, 6) as gap, drawn from elo"))
def elo_ratings(spark, d):
    r = models.elo(_played(spark, d))
    return r.select("id", "competition_id", *[F.round(c, 6).alias(c) for c in ("home_before", "away_before", "gap")], "drawn")


@query(_elo_sql("select * from curve"))
def elo_draw_curve(spark, d):
    return models.draw_curve(written(models.elo(_played(spark, d)), "ratings"))


@query(_elo_sql("""select id, round((1 - tie) * win, 6) as home, round(tie, 6) as draw, round((1 - tie) * (1 - win), 6) as away from (
  select id, least(greatest(base * exp(-decay * abs(gap)), 0.05::double), 0.4::double) as tie, 1 / (1 + pow(10::double, -gap / 400)) as win from elo join curve using (competition_id))"""))
def elo_predictions(spark, d):
    r = written(models.elo(_played(spark, d)), "ratings")
    p = models.elo_predict(r, models.draw_curve(r))
    return p.select("id", *[F.round(c, 6).alias(c) for c in ("home", "draw", "away")])


@query()
def dixon_coles_ratings(spark, d):
    a = snapshot(spark, d)
    return models.scoring_strengths(a.completed(), AS_OF, a.stats())


@query()
def dixon_coles_markets(spark, d):
    a = snapshot(spark, d)
    strengths = models.scoring_strengths(a.completed(), AS_OF, a.stats())
    return scores.goal_markets_of(scores.score_columns(spread(models.expected_goals(a.scheduled(), strengths), "id")))


@query()
def ensemble_weights(spark, d):
    p = predictions(spark, d).withColumn("p", evaluation._of_truth())
    return models.ensemble_weights(p.select("competition_id", "id", "model", "p"), ["steep", "flat"])
