"""The catalogue continued: one analysis of every fixture, counts by side, players in one match, flags, factors, draw correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import asof, evaluation, judgement, scores
from touchline.session import written
from touchline.sources import derived

from . import analysis, catalog_entities  # noqa: F401  its SQL is used below
from .base_sql import AS_OF, SEASON_START, SINCE, over
from .catalog import _LATE, _LATEST, ORACLE, cut, query, rates, snapshot
from .catalog_more import _PREDS, explanation_rows, predictions

_DAY = AS_OF[:10]


def _analysis(spark, d):
    return analysis.analyze(snapshot(spark, d), AS_OF, SEASON_START, SINCE, explanation_rows)


@query()
def analyze_fixtures(spark, d):
    """Every fixture that isn't played: outcomes, markets, counts, quality and factors as one table."""
    return analysis.as_rows(_analysis(spark, d))


@query()
def logistic_1x2(spark, d):
    """The regression on 23 features, fitted on at most 1,200 newest matches of a competition with five matches of both sides, for every fixture."""
    return _analysis(spark, d)["predictions"].where("model = 'logistic'").select("id", "home", "draw", "away")


_COUNT_BASE = (
    f"r as (select *, corners as v, pow(0.5, greatest(date_diff('day', kickoff_date, date '{_DAY}'), 0) / 365.0::double) as w from hist where corners is not null and kickoff_date >= date '{SINCE}')",
    "league as (select avg(v) filter (is_home) as mh, avg(v) filter (not is_home) as ma from r)", "two as (select team_id as t, true as own, is_home, v, w from r union all select opponent_id, false, is_home, v, w from r)",
    "rt as (" + ORACLE["count_rates"][ORACLE["count_rates"].rindex("select t as team_id"):] + ")",
    f"refs as ({ORACLE['referee_multipliers'][ORACLE['referee_multipliers'].rindex('select referee, n, round'):]})",
    """mu as (select m.id, least(coalesce(h.n, 0), coalesce(a.n, 0)) >= 8 as known, round(mh * coalesce(h.for_home, 1) * coalesce(a.against_away, 1) * coalesce(f.multiplier, 1), 6) as h, round(ma * coalesce(a.for_away, 1) * coalesce(h.against_home, 1) * coalesce(f.multiplier, 1), 6) as a
  from matches m cross join league left join rt h on h.team_id = m.home_team_id left join rt a on a.team_id = m.away_team_id left join refs f on f.referee = m.referee where status = 'scheduled')""",
    "pmf as (select id, k, p / sum(p) over (partition by id) as p from (select id, k, exp(-greatest(h + a, 0.05)) * pow(greatest(h + a, 0.05), k) / gamma(k + 1) as p from mu, (select unnest(range(0, 31))::int as k) where known))",
    "cdf as (select *, sum(p) over (partition by id order by k) as c from pmf)",
    "cover as (select id, count(*) filter (round(c, 9) < 0.1) as low, count(*) filter (round(c, 9) < 0.9) as high, " + ", ".join(f"coalesce(sum(p) filter (k > {x}), 0) as o{i}" for i, x in enumerate(analysis.CORNERS)) + " from cdf group by 1)",
)


@query(over("hist", "select id, 'expected_corners' as market, 'total' as selection, round(h + a, 6) as value, low::int as low, high::int as high, true as sufficient_data from mu join cover using (id) union all select id, 'expected_corners', 'home', h, null, null, true from mu where known union all select id, 'expected_corners', 'away', a, null, null, true from mu where known"
    + "".join(f" union all select id, 'corners_over_under_{x}', 'over', round(o{i}, 6), null, null, true from cover union all select id, 'corners_over_under_{x}', 'under', round(1 - o{i}, 6), null, null, true from cover" for i, x in enumerate(analysis.CORNERS))
    + " union all select id, 'corners', '', null, null, null, false from mu where not known", *_COUNT_BASE))
def corner_targets(spark, d):
    """Corners of both sides and in all, with the referee's multiplier of cards for the sake of one: what models multiply, checked by SQL."""
    a = snapshot(spark, d)
    history = a.history(since=SINCE)
    referees = scores.referee_multipliers(history.withColumn("cards", F.col("yellows") + 2 * F.col("reds")), "cards")
    return scores.count_targets(scores.count_expectations(a.scheduled(), history, "corners", AS_OF, referees), "corners", analysis.CORNERS)


@query(over("players", f"""select p.player_id, p.team_id, f.id, round(s, 3) as scale, round(g + 1e-10, 3) as expected_goals, round(x + 1e-10, 3) as expected_assists, round(1 - exp(-greatest(g, 1e-6)), 4) as prob_scores, round(1 - exp(-greatest(g, 1e-6)) * (1 + greatest(g, 1e-6)), 4) as prob_two_plus,
  round(1 - exp(-greatest(x, 1e-6)), 4) as prob_assists, round(1 - exp(-greatest(g + x, 1e-6)), 4) as prob_involvement
from sq q join proj p0 using (player_id) join fx f on f.team_id = q.team_id left join recent r on r.team_id = q.team_id,
  lateral (select q.player_id, q.team_id) p, lateral (select round(case when r.rate > 0.1 and f.goals > 0 then least(greatest(f.goals / r.rate, 0.5), 2.0) else 1.0::double end, 9) as s), lateral (select round(p0.expected_goals * s, 9) as g, round(p0.expected_assists * s, 9) as x) where p0.sufficient_data""",
    f"sq as ({ORACLE['squads'][ORACLE['squads'].rindex('select player_id, team_id from ('):]})",
    f"proj as ({ORACLE['player_projection']})",
    f"fx as (select m.id, t.team_id, t.goals from ({over('matches', 'select * from matches').replace('with ', 'with ', 1)}) m, lateral (select unnest([home_team_id, away_team_id]) as team_id, unnest([0.6::double + (home_team_id % 10) * 0.15::double, 0.5::double + (away_team_id % 9) * 0.12::double]) as goals) t where m.status = 'scheduled' and m.kickoff_date >= date '{_DAY}')",
    f"recent as ({ORACLE['recent_goal_rates']})"))
def players_in_matches(spark, d):
    """Every squad player's chances in each of the team's coming matches, by the goals expected of the team there."""
    from touchline.operators import entities

    from .catalog import player_projection

    a = cut(spark, d)
    m = a.upcoming().select("id", "home_team_id", "away_team_id").join(rates(spark, d), "id")
    goals = m.select("id", F.inline(F.array(F.struct(F.col("home_team_id").alias("team_id"), F.col("lam").alias("goals")), F.struct(F.col("away_team_id").alias("team_id"), F.col("mu").alias("goals")))))
    recent = a.history(newest_rows=15).groupBy("team_id").agg(F.avg("goals_for").alias("rate"))
    squad = entities.squads(derived.players(spark, d), AS_OF)
    projected = player_projection(spark, d).where("sufficient_data").select("player_id", "expected_goals", "expected_assists")
    return scores.player_factor(projected.join(squad, "player_id"), goals, recent)


_OUT = f"squad as (select player_id, team_id from (select *, row_number() over (partition by player_id order by match_date desc, team_id) as k from players where match_date < date '{_DAY}') where k = 1), gone as (select s.team_id, 'player ' || l.player_id as player, l.status from latest l join squad s using (player_id))"
_FIXTURES = f"fixtures as (select id, home_team_id, away_team_id, kickoff_date, kickoff_utc from ({over('matches', 'select * from matches')}) where status = 'scheduled')"


def _gone(spark, d):
    from touchline.operators import entities

    news = asof.latest_observation(derived.availability(spark, d), _LATE, "player_id")
    return news.join(entities.squads(derived.players(spark, d), AS_OF), "player_id").select("team_id", F.concat(F.lit("player "), F.col("player_id").cast("string")).alias("player"), "status")


@query(over("players", """select id, 'availability' as category, case when side = 'home' then 'away' else 'home' end as favours, round(least(n / 6.0::double, 1) * 0.7::double, 6) as impact, 'without ' || n || ': ' || array_to_string(names[1:4], ', ') || case when n > 4 then ' and ' || (n - 4) || ' more' else '' end as statement
from (select id, unnest(['home', 'away']) as side, unnest([home_team_id, away_team_id]) as team_id from fixtures) join (select team_id, count(*) as n, list_sort(list(player)) as names from gone where status in ('injured', 'suspended', 'unavailable') group by 1) using (team_id)""", _LATEST, _OUT, _FIXTURES))
def availability_factors(spark, d):
    m = derived.matches(spark, d).where("status = 'scheduled'")
    return judgement.availability_factors(m, _gone(spark, d))


@query(over("players", f"""select id, lineups, team_news, weather, array_to_string(list_filter([case when lineups = 'predicted' then 'lineups_predicted:warning' end, case when lineups = 'unavailable' and soon then 'lineups_missing_late:serious' end, case when lineups = 'unavailable' and not soon then 'lineups_missing:warning' end,
  case when not team_news then 'no_team_news:warning' end, case when not stats then 'no_player_data:info' end, case when id % 9 = 0 then 'source_conflict:warning' end, case when id % 18 = 0 then 'source_conflict:warning' end], lambda x: x is not null), ',') as issues
from (select f.id, case when id % 5 = 0 then 'confirmed' when id % 5 = 1 then 'predicted' else 'unavailable' end as lineups, id % 4 = 0 as weather,
  exists (select 1 from gone g where g.team_id in (f.home_team_id, f.away_team_id)) as team_news, exists (select 1 from players p where p.team_id = f.home_team_id and p.match_date >= date '1998-07-01') as stats,
  coalesce(epoch(coalesce(kickoff_utc, kickoff_date::timestamp + interval 15 hours)) - epoch(timestamp '{AS_OF}') <= 7200, false) as soon from fixtures f)""", _LATEST, _OUT, _FIXTURES))
def quality_flags(spark, d):
    """Lineups of two fixtures in five, conflicts of one in nine (two of one in 18), conditions of one in four, by rule; news and players' rows as they are."""
    m = derived.matches(spark, d).where("status = 'scheduled'")
    fixtures = m.select("id", "home_team_id", "away_team_id", F.coalesce("kickoff_utc", F.col("kickoff_date").cast("timestamp") + F.expr("interval 15 hours")).alias("kickoff"))
    lineups = m.where("id % 5 = 0").select("id", F.explode(F.array(F.lit("predicted"), F.lit("confirmed"))).alias("kind")).unionByName(m.where("id % 5 = 1").select("id", F.lit("predicted").alias("kind")))
    conflicts = m.where("id % 9 = 0").select("id").unionByName(m.where("id % 18 = 0").select("id"))
    rows = derived.players(spark, d).where("match_date >= date '1998-07-01'")
    r = judgement.flags(fixtures, AS_OF, lineups, conflicts, _gone(spark, d), rows, m.where("id % 4 = 0").select("id"))
    return r.select("id", "lineups", "team_news", "weather", F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x.code, x.severity)), ",").alias("issues"))


_GRID = [0.85 + (1.25 - 0.85) * i / 80 for i in range(81)]


@query(over("matches", """select round(k, 6) as multiplier, n_fitted, count(*) as n_scored, round(avg(l1), 6) as before, round(avg(lk), 6) as after, round(avg(lk) - avg(l1), 6) as difference from best, lateral (
  select -ln(least(greatest(t, 1e-12), 1)) as l1, -ln(least(greatest(case when outcome = 'D' then draw * k else t end / (1 + draw * (k - 1)), 1e-12), 1)) as lk from late) group by k, n_fitted""", _PREDS,
    "steep as (select *, case outcome when 'H' then home when 'D' then draw else away end as t from preds where model = 'steep')", "early as (select * from steep where kickoff_date < date '1997-01-01')", "late as (select * from steep where kickoff_date >= date '1997-01-01')",
    f"grid as (select unnest([{', '.join(repr(k) + '::double' for k in _GRID)}]) as k)",
    "losses as (select k, count(*) as n, avg(-ln(least(greatest(case when outcome = 'D' then draw * k else t end / (1 + draw * (k - 1)), 1e-12), 1))) as l from early, grid group by 1)", "best as (select k, n as n_fitted from losses order by round(l, 9), k limit 1)"))
def draw_multiplier(spark, d):
    p = predictions(spark, d).where("model = 'steep'")
    return evaluation.draw_multiplier(p.where("kickoff_date < date '1997-01-01'"), p.where("kickoff_date >= date '1997-01-01'"))


_TIMES = " ".join(f"when u < {e!r} then {k}" for k, e in enumerate(evaluation.poisson_edges()))


@query(over("matches", f"""select round(d, 6) as difference, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from (
  select r, sum(diff * k) / nullif(sum(k), 0) as m from (select r, diff, case {_TIMES} else 8 end as k from (select r, diff, ('0x' || substr(md5('7:' || r || ':' || id), 1, 8))::bigint / 4294967296.0::double as u from diffs, (select unnest(range(0, 400)) as r))) group by 1), (select avg(diff) as d from diffs) group by d""", _PREDS,
    "diffs as (select a.id, a.l - b.l as diff from (select *, -ln(case outcome when 'H' then home when 'D' then draw else away end) as l from preds where model = 'steep') a join (select *, -ln(case outcome when 'H' then home when 'D' then draw else away end) as l from preds where model = 'flat') b using (id))"))
def bootstrap_rows(spark, d):
    """An interval over matches as if each were drawn alone, 400 replicates."""
    p = predictions(spark, d).withColumn("l", evaluation.log_loss())
    of = lambda model: F.max(F.when(F.col("model") == model, F.col("l")))
    both = p.groupBy("id").agg(of("steep").alias("l"), of("flat").alias("other")).where("l is not null and other is not null")
    return evaluation.bootstrap(written(both.select("id", (F.col("l") - F.col("other")).alias("diff")), "differences"), 400)


@query(over("matches", """select id, 2 as version, case when abs(round(n.home - o.home, 9)) < 0.01 and abs(round(n.draw - o.draw, 9)) < 0.01 and abs(round(n.away - o.away, 9)) < 0.01 then 'no material change in match-result probabilities' || tier
  else 'changes: ' || concat_ws(', ', case when abs(round(n.home - o.home, 9)) >= 0.01 then 'home ' || printf('%+.1f', 100 * (n.home - o.home)) || '%' end, case when abs(round(n.draw - o.draw, 9)) >= 0.01 then 'draw ' || printf('%+.1f', 100 * (n.draw - o.draw)) || '%' end, case when abs(round(n.away - o.away, 9)) >= 0.01 then 'away ' || printf('%+.1f', 100 * (n.away - o.away)) || '%' end) || tier end as summary
from (select * from preds where model = 'steep') o join (select * from preds where model = 'flat') n using (id), lateral (select case when id % 3 = 0 then '; data quality LOW -> HIGH' else '' end as tier)""", _PREDS))
def analysis_changes(spark, d):
    """The second of two models' predictions as the newer version of the first's."""
    p = predictions(spark, d)
    old = p.where("model = 'steep'").select("id", F.lit(1).alias("version"), "home", "draw", "away", F.lit("LOW").alias("tier"))
    new = p.where("model = 'flat'").select("id", "home", "draw", "away", F.when(F.col("id") % 3 == 0, "HIGH").otherwise("LOW").alias("tier"), F.lit(2).alias("created_at"))
    return analysis.change_summary(old, new).drop("created_at")
