"""The catalogue continued: features at every kickoff, walk-forward runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import evaluation, timeline

from . import backtest, count_runs, models
from .base_sql import over
from .catalog import _F, query, snapshot
from .catalog_more import fold_sql

_AT_KICKOFF = """facts as (
  select s.*, case when goals_for > goals_against then 3 when goals_for = goals_against then 1 else 0 end as points, o.shots_on_target, p.shots_on_target as sot_against,
    case when month(kickoff_date) < 7 then year(kickoff_date) - 1 else year(kickoff_date) end as season
  from (select id, competition_id, kickoff_date, known_at, home_team_id as team_id, away_team_id as opponent_id, true as is_home, ft_home_goals as goals_for, ft_away_goals as goals_against from matches where status = 'played'
    union all select id, competition_id, kickoff_date, known_at, away_team_id, home_team_id, false, ft_away_goals, ft_home_goals from matches where status = 'played') s
  left join stats o on o.match_id = s.id and o.team_id = s.team_id left join stats p on p.match_id = s.id and p.team_id = s.opponent_id
), probes as (
  select id as pid, competition_id, unnest([home_team_id, away_team_id]) as pteam, coalesce(kickoff_utc, kickoff_date::timestamp) as moment from matches
), known as (
  select pid, pteam, moment, f.*, row_number() over (partition by pid, pteam order by kickoff_date desc, id desc) as rn from probes join facts f on f.team_id = pteam and f.known_at <= moment
), tf as (
  select pid, pteam, avg(goals_for) filter (rn <= 10) as gf10, avg(goals_against) filter (rn <= 10) as ga10, avg(goals_for) as gf, avg(goals_against) as ga, avg(goals_for) filter (is_home) as gf_home, avg(goals_against) filter (is_home) as ga_home,
    avg(goals_for) filter (not is_home) as gf_away, avg(goals_against) filter (not is_home) as ga_away, avg(shots_on_target) filter (rn <= 10) as sot10, avg(sot_against) filter (rn <= 10) as sota10, round(avg(points) filter (rn <= 5), 3) as ppg5, round(avg(points), 3) as ppg,
    count(*) as n, min(date_diff('day', kickoff_date, moment::date)) as rest, count(*) filter (date_diff('day', kickoff_date, moment::date) <= 14) as busy from known where rn <= 80 group by 1, 2
), theirs as (
  select r.pid, r.pteam, r.id, r.goals_for as gf, r.goals_against as ga, o.goals_for as og, o.goals_against as oa, o.kickoff_date < r.kickoff_date as before, row_number() over (partition by r.pid, r.pteam, r.id order by o.kickoff_date desc, o.id desc) as k
  from known r join facts o on o.team_id = r.opponent_id and o.known_at <= r.moment where r.rn <= 20
), each as (
  select pid, pteam, id, any_value(gf) as gf, any_value(ga) as ga, count(*) as k, avg(oa) as conceded, avg(og) as scored from theirs where k <= 30 and before group by 1, 2, 3
), adj as (
  select pid, pteam, round(avg(case when k >= 5 and conceded > 0.05 then gf / conceded end), 3) as attack_index, round(avg(case when k >= 5 and scored > 0.05 then ga / scored end), 3) as defence_index from each group by 1, 2
), standing as (
  select p.pid, p.moment, f.team_id, sum(points) as pts, sum(goals_for - goals_against) as gd, sum(goals_for) as gf, max((f.kickoff_date, f.id, f.is_home)) as last
  from (select distinct pid, competition_id, moment from probes) p join facts f on f.competition_id = p.competition_id and f.known_at <= p.moment
    and f.season = case when month(p.moment) < 7 then year(p.moment) - 1 else year(p.moment) end group by 1, 2, 3
), places as (select pid, team_id as pteam, row_number() over (partition by pid order by pts desc, gd desc, gf desc, last desc) as place from standing
), side as (select * from tf left join adj using (pid, pteam))"""

FEATURES_SQL = over("stats", "select m.id, coalesce(h.n, 0)::bigint as home_n, coalesce(a.n, 0)::bigint as away_n, " + ", ".join([
    _F("home_gf_10", "h.gf10, 1.3"), _F("home_ga_10", "h.ga10, 1.3"), _F("away_gf_10", "a.gf10, 1.3"), _F("away_ga_10", "a.ga10, 1.3"), _F("home_gf_home", "h.gf_home, h.gf, 1.3"), _F("home_ga_home", "h.ga_home, h.ga, 1.3"),
    _F("away_gf_away", "a.gf_away, a.gf, 1.3"), _F("away_ga_away", "a.ga_away, a.ga, 1.3"), _F("home_sot_10", "h.sot10, 4.5"), _F("away_sot_10", "a.sot10, 4.5"), _F("home_sot_against_10", "h.sota10, 4.5"), _F("away_sot_against_10", "a.sota10, 4.5"),
    _F("home_ppg_5", "h.ppg5, 1.4"), _F("away_ppg_5", "a.ppg5, 1.4"), _F("home_ppg_all", "h.ppg, 1.4"), _F("away_ppg_all", "a.ppg, 1.4"), _F("home_attack_index", "h.attack_index, 1.0"), _F("away_attack_index", "a.attack_index, 1.0"),
    _F("home_defence_index", "h.defence_index, 1.0"), _F("away_defence_index", "a.defence_index, 1.0"), _F("home_rest_advantage_days", "(h.rest - a.rest)::double, 0.0"), "round((coalesce(h.busy, 0) - coalesce(a.busy, 0))::double, 6) as congestion_difference", _F("position_difference", "(ap.place - hp.place)::double, 0.0")])
    + " from matches m left join side h on h.pid = m.id and h.pteam = home_team_id left join side a on a.pid = m.id and a.pteam = away_team_id left join places hp on hp.pid = m.id and hp.pteam = home_team_id left join places ap on ap.pid = m.id and ap.pteam = away_team_id", _AT_KICKOFF)


@query(FEATURES_SQL)
def features_23_at_each_kickoff(spark, d):
    a = snapshot(spark, d)
    return timeline.kickoff_features(a.recorded(), None)


#: The last two years of the tables, refitted every 30 days.
RUN = backtest.Run("1996-08-01", "1998-08-02")


def counts_sql(select: str, run: backtest.Run = RUN, b: count_runs.CountRun = count_runs.CountRun()) -> str:  # noqa: B008
    """The count models' walk-forward run in SQL: the table `scored` (id, market, checkpoint, expected, line, p_over, actual)."""
    ctes = [f"""played as (select * from matches where status = 'played' and ft_home_goals is not null and ft_away_goals is not null
), test as (select * from played where kickoff_date between date '{run.start}' and date '{run.end}'
), steps as (
  select competition_id, min(kickoff_date) as checkpoint from test group by 1
  union all
  select s.competition_id, (select min(kickoff_date) from test m where m.competition_id = s.competition_id and m.kickoff_date >= s.checkpoint + {run.refit_days}) from steps s
  where exists (select 1 from test m where m.competition_id = s.competition_id and m.kickoff_date >= s.checkpoint + {run.refit_days})
), recorded as (
  select match_id, team_id, 'corners' as market, corners::double as v, corners is not null as whole from stats where corners is not null
  union all select match_id, team_id, 'cards', (coalesce(yellows, 0) + 2 * coalesce(reds, 0))::double, yellows is not null from stats where yellows is not null or reds is not null
), sides as (
  select p.*, x.market, x.v, x.whole, x.team_id, x.team_id = home_team_id as is_home, case when x.team_id = home_team_id then away_team_id else home_team_id end as opponent_id from played p join recorded x on x.match_id = p.id
), train as (
  select s.*, checkpoint, pow(0.5, greatest(date_diff('day', kickoff_date, checkpoint), 0) / {b.half_life_days}::double) as w from steps c join sides s using (competition_id)
  where known_at <= checkpoint::timestamp and kickoff_date >= make_date(year(checkpoint) - {b.seasons_back}, 7, 1)
), league as (
  select market, competition_id, checkpoint, avg(v) filter (is_home) as mh, avg(v) filter (not is_home) as ma from train group by 1, 2, 3
  having count(*) >= {2 * b.least_matches} and avg(v) filter (is_home) > 0 and avg(v) filter (not is_home) > 0
), spread as (
  select market, competition_id, checkpoint, case when count(*) >= {b.least_totals} then var_samp(t) / avg(t) end as disp from (select market, competition_id, checkpoint, id, sum(v) as t from train group by 1, 2, 3, 4 having count(*) = 2) group by 1, 2, 3
), own as (
  select market, competition_id, checkpoint, team_id, sum(v * w) filter (is_home) as hs, sum(w) filter (is_home) as hw, sum(v * w) filter (not is_home) as vs, sum(w) filter (not is_home) as vw, count(*) as n from train group by 1, 2, 3, 4
), met as (
  select market, competition_id, checkpoint, opponent_id as team_id, sum(v * w) filter (is_home) as hs, sum(w) filter (is_home) as hw, sum(v * w) filter (not is_home) as vs, sum(w) filter (not is_home) as vw from train group by 1, 2, 3, 4
), refs as (
  select market, competition_id, checkpoint, trim(referee) as referee, least(greatest(avg(v) / any_value(o), 0.7), 1.4) as f
  from (select *, avg(v) over (partition by market, competition_id, checkpoint) as o from train where trim(coalesce(referee, '')) <> '') where o > 0 group by 1, 2, 3, 4 having count(*) >= {b.least_referee}
), placed as (select t.*, (select max(checkpoint) from steps s where s.competition_id = t.competition_id and s.checkpoint <= t.kickoff_date) as checkpoint from test t
), mu as (
  select p.id, l.market, l.checkpoint, s.disp,
    coalesce(f, 1) * (l.mh * coalesce((ho.hs + {b.shrinkage} * l.mh) / (ho.hw + {b.shrinkage}) / l.mh, 1) * coalesce((am.hs + {b.shrinkage} * l.mh) / (am.hw + {b.shrinkage}) / l.mh, 1)
      + l.ma * coalesce((ao.vs + {b.shrinkage} * l.ma) / (ao.vw + {b.shrinkage}) / l.ma, 1) * coalesce((hm.vs + {b.shrinkage} * l.ma) / (hm.vw + {b.shrinkage}) / l.ma, 1)) as expected
  from placed p join league l on l.competition_id = p.competition_id and l.checkpoint = p.checkpoint left join spread s on (s.market, s.competition_id, s.checkpoint) = (l.market, l.competition_id, l.checkpoint)
  join own ho on (ho.market, ho.competition_id, ho.checkpoint, ho.team_id) = (l.market, l.competition_id, l.checkpoint, p.home_team_id) and ho.n >= {b.least_team}
  join own ao on (ao.market, ao.competition_id, ao.checkpoint, ao.team_id) = (l.market, l.competition_id, l.checkpoint, p.away_team_id) and ao.n >= {b.least_team}
  left join met hm on (hm.market, hm.competition_id, hm.checkpoint, hm.team_id) = (l.market, l.competition_id, l.checkpoint, p.home_team_id)
  left join met am on (am.market, am.competition_id, am.checkpoint, am.team_id) = (l.market, l.competition_id, l.checkpoint, p.away_team_id)
  left join refs r on (r.market, r.competition_id, r.checkpoint, r.referee) = (l.market, l.competition_id, l.checkpoint, trim(p.referee))
), pmf as (
  select id, market, k, w / sum(w) over (partition by id, market) as p from (select id, market, k, case when disp > 1.1
    then exp(lgamma(m / (disp - 1) + k) - lgamma(m / (disp - 1)) - lgamma(k + 1)) * pow(1 / disp, m / (disp - 1)) * pow(1 - 1 / disp, k) else exp(-m) * pow(m, k) / gamma(k + 1) end as w
    from (select *, greatest(expected, 0.05) as m from mu), (select unnest(range(0, {b.most + 1}))::int as k))
), actuals as (select id, market, sum(v) as actual from sides where whole group by 1, 2 having count(*) = 2
), bars as (select * from (values {", ".join(f"('{m}', {x}::double)" for m, some in b.lines for x in some)}) as v(market, line)
), scored as (
  select mu.id, mu.market, checkpoint, expected, line, (select coalesce(sum(p), 0) from pmf where pmf.id = mu.id and pmf.market = mu.market and k > line) as p_over, actual from mu join bars using (market) left join actuals using (id, market)
)"""]
    return over("stats", select, *ctes).replace("with ", "with recursive ", 1)


@query(counts_sql("select id, market, checkpoint, round(expected, 6) as expected, line, round(p_over, 6) as p_over, actual from scored"))
def walk_forward_counts(spark, d):
    """Corners and card points of every match of the run that the counts up to its checkpoint can predict, and what was recorded."""
    a = snapshot(spark, d)
    rows = count_runs.walk_forward_counts(a.matches(), a.stats(), RUN)
    return rows.select("id", "market", "checkpoint", F.round("expected", 6).alias("expected"), "line", F.round("p_over", 6).alias("p_over"), "actual")


_LOSS = "-ln(case when actual > line then q else 1 - q end)"


@query(counts_sql(f"""select model, market, metric, n, value from (
  select market as model, market || '_over_under_' || line as market, unnest(['log_loss', 'brier']) as metric, n, unnest([ll, br]) as value from (
    select market, line, count(*) as n, round(avg({_LOSS}), 6) as ll, round(avg(pow(p_over - (actual > line)::int, 2)), 6) as br from (select *, least(greatest(p_over, {evaluation.EPS}), 1 - {evaluation.EPS}) as q from scored where actual is not null) group by 1, 2)
  union all
  select market, 'expected_' || market, unnest(['mae', 'rmse', 'bias']), n, unnest([mae, rmse, bias]) from (
    select market, count(*) as n, round(avg(abs(expected - actual)), 6) as mae, round(sqrt(avg(pow(expected - actual, 2))), 6) as rmse, round(avg(expected - actual), 6) as bias from (select distinct id, market, expected, actual from scored where actual is not null) group by 1))"""))
def walk_forward_count_scores(spark, d):
    """Log loss and Brier score of each line, and errors of the expected counts, over the run."""
    a = snapshot(spark, d)
    return count_runs.count_report(count_runs.walk_forward_counts(a.matches(), a.stats(), RUN))


def _forward(spark, d):
    a = snapshot(spark, d)
    return backtest.walk_forward(a.recorded(), None, RUN)


@query()
def walk_forward(spark, d):
    """Three models and their ensemble, refitted at every checkpoint of every competition, scored on what followed; the counts on the same matches."""
    a = snapshot(spark, d)
    test, _, made = backtest.walk_forward(a.recorded(), None, RUN)
    rows = backtest.scored(test, made)
    counted = count_runs.walk_forward_counts(a.matches(), a.stats(), RUN).join(rows.select("id").distinct(), "id", "left_semi")
    return backtest.report(rows, RUN).unionByName(count_runs.count_report(counted))


@query()
def walk_forward_predictions(spark, d):
    return _forward(spark, d)[2]


@query()
def walk_forward_skips(spark, d):
    test, _, made = _forward(spark, d)
    return backtest.skipped(test, made)


@query()
def logistic_coefficients(spark, d):
    """The six features that weigh most in each outcome, at each checkpoint."""
    return backtest.coefficients(_forward(spark, d)[1])


@query()
def walk_forward_validation(spark, d):
    """Weights that earlier predictions give, on later ones: against equal weights and each model alone."""
    test, _, made = _forward(spark, d)
    rows = backtest.scored(test, made).where("model <> 'ensemble'").withColumn("p", evaluation._of_truth())
    return models.forward_validation(rows.select("competition_id", "id", "kickoff_date", "model", "p"), list(backtest.MODELS)).drop("losses")


#: Ratings alone, refitted every four weeks.
LIGHT = backtest.Run("1996-08-01", "1998-08-02", refit_days=28)


def light_sql(select: str, run: backtest.Run = LIGHT) -> str:
    """The ratings' light run in SQL: a fold of each (competition, checkpoint)'s training set; the table `seen` (id, checkpoint, home, draw, away, outcome)."""
    ctes = [f"""played as (select * from matches where status = 'played' and ft_home_goals is not null and ft_away_goals is not null
), test as (select * from played where kickoff_date between date '{run.start}' and date '{run.end}'
), steps as (
  select competition_id, min(kickoff_date) as checkpoint from test group by 1
  union all
  select s.competition_id, (select min(kickoff_date) from test m where m.competition_id = s.competition_id and m.kickoff_date >= s.checkpoint + {run.refit_days}) from steps s
  where exists (select 1 from test m where m.competition_id = s.competition_id and m.kickoff_date >= s.checkpoint + {run.refit_days})
), train as (
  select p.*, checkpoint from steps join played p using (competition_id) where known_at <= checkpoint::timestamp and kickoff_date >= make_date(year(checkpoint) - {run.seasons_back}, 7, 1)
)""", fold_sql("train", "competition_id, checkpoint", run.least_matches), f"""teams as (
  select competition_id, checkpoint, team, count(*) as k from (select competition_id, checkpoint, unnest([home_team_id, away_team_id]) as team from train) group by 1, 2, 3
), placed as (select t.*, (select max(checkpoint) from steps s where s.competition_id = t.competition_id and s.checkpoint <= t.kickoff_date) as checkpoint from test t
), gaps as (
  select p.id, p.checkpoint, c.base, c.decay, r[home_team_id::bigint] + 60 - r[away_team_id::bigint] as gap, case when ft_home_goals > ft_away_goals then 'H' when ft_home_goals = ft_away_goals then 'D' else 'A' end as outcome
  from placed p join curve c on c.competition_id = p.competition_id and c.checkpoint = p.checkpoint join last_ratings l on l.competition_id = p.competition_id and l.checkpoint = p.checkpoint
  join teams h on (h.competition_id, h.checkpoint, h.team) = (p.competition_id, p.checkpoint, p.home_team_id) and h.k >= {run.least_team} join teams a on (a.competition_id, a.checkpoint, a.team) = (p.competition_id, p.checkpoint, p.away_team_id) and a.k >= {run.least_team}
), seen as (
  select id, checkpoint, (1 - tie) * win as home, tie as draw, (1 - tie) * (1 - win) as away, outcome from (select *, least(greatest(base * exp(-decay * abs(gap)), 0.05::double), 0.4::double) as tie, 1 / (1 + pow(10::double, -gap / 400)) as win from gaps)
)"""]
    return over("matches", select, *ctes).replace("with ", "with recursive ", 1)


@query(light_sql("select id, checkpoint, round(home, 6) as home, round(draw, 6) as draw, round(away, 6) as away, outcome from seen"))
def light_run_predictions(spark, d):
    a = snapshot(spark, d)
    rows, _ = backtest.light_run(a.matches(), a.stats(), LIGHT, "elo")
    return rows.select("id", "checkpoint", *[F.round(c, 6).alias(c) for c in ("home", "draw", "away")], "outcome")


@query(light_sql(f"""select 'elo' as model, count(*) as n, round(avg(-ln(greatest(p, {evaluation.EPS}))), 6) as log_loss, round(avg(pow(home - (outcome = 'H')::int, 2) + pow(draw - (outcome = 'D')::int, 2) + pow(away - (outcome = 'A')::int, 2)), 6) as brier,
  (select count(*) from steps) as fits, (select count(*) from test) - count(*) as declined from (select *, case outcome when 'H' then home when 'D' then draw else away end as p from seen) having count(*) > 0"""))
def light_run_summary(spark, d):
    """How the ratings do when they are fitted anew every four weeks."""
    a = snapshot(spark, d)
    return backtest.light_run(a.matches(), a.stats(), LIGHT, "elo")[1].select("model", "n", "log_loss", "brier", "fits", "declined")
