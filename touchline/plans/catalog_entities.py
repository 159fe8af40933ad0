"""The catalogue continued: entities, upserts, registered weights, player markets, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import entities, evaluation
from touchline.sources import derived

from . import models
from .base_sql import AS_OF, over
from .catalog import ORACLE, QUERIES, cut, query
from .catalog_more import _PREDS, predictions

_DAY = AS_OF[:10]


@query(over("hist", "select team_id, avg(goals_for)::double as rate, count(*) as n from hist where rn <= 15 group by 1"))
def recent_goal_rates(spark, d):
    return cut(spark, d).history(newest_rows=15).groupBy("team_id").agg(F.avg("goals_for").alias("rate"), F.count("*").alias("n"))


@query(over("hist", "select competition_id, least(count(*), 10000) as n from done group by 1"))
def competition_match_counts(spark, d):
    return cut(spark, d).completed().groupBy("competition_id").agg(F.least(F.count("*"), F.lit(10000)).alias("n"))


@query(over("stats", "select source_id, count(distinct match_id) as matches, count(*) as n from candidates group by 1"))
def source_totals(spark, d):
    return derived.stat_candidates(spark, d).groupBy("source_id").agg(F.countDistinct("match_id").alias("matches"), F.count("*").alias("n"))


@query(over("hist", f"select distinct m.id, c.source_id from matches m join hist80 h on h.team_id in (m.home_team_id, m.away_team_id) join candidates c on c.match_id = h.id and c.team_id = h.team_id where m.status = 'scheduled' and m.kickoff_date >= date '{_DAY}'"))
def evidence_sources(spark, d):
    a = cut(spark, d)
    return entities.sources_behind(a.upcoming(), a.history(newest_rows=80), derived.stat_candidates(spark, d))


@query(over("players", f"select player_id, team_id from (select *, row_number() over (partition by player_id order by match_date desc, team_id) as k from players where match_date < date '{_DAY}') where k = 1"))
def squads(spark, d):
    return entities.squads(derived.players(spark, d), AS_OF)


@query(over("players", "select team_id, player_id, rank, xgi, minutes from (select *, row_number() over (partition by team_id order by xgi desc, minutes desc nulls last, player_id) as rank from (select team_id, player_id, round(coalesce(sum(xg), 0) + coalesce(sum(xa), 0), 6) as xgi, sum(minutes)::bigint as minutes from players group by 1, 2)) where rank <= 14"))
def top_players(spark, d):
    return entities.top_players(derived.players(spark, d))


@query(over("matches", """select player_id, team_id, match_date, match_id from (
  select p.*, m.id as match_id, row_number() over (partition by player_id, team_id, match_date order by abs(date_diff('day', match_date, kickoff_date)), kickoff_date, m.id) as k
  from p join matches m on team_id in (home_team_id, away_team_id) and abs(date_diff('day', match_date, kickoff_date)) <= 1) where k = 1""", "p as (select distinct l_partkey as player_id, l_suppkey as team_id, l_shipdate::date as match_date from lineitem)"))
def player_rows_to_matches(spark, d):
    return entities.rows_to_matches(derived.players(spark, d).select("player_id", "team_id", "match_date").distinct(), derived.matches(spark, d))


def _player_markets_sql(base: str) -> str:
    shown = " union all ".join(f"select player_id, '{m}' as market, {c}::double as value, case when sufficient_data then 0.8::double end as confidence, sufficient_data from w" for m, c in entities.PLAYER_MARKETS.items())
    withheld = " union all ".join(f"select player_id, '{m}', null::double, null::double, false from w" for m in entities.WITHHELD)
    return f"with w as ({base}) {shown} union all {withheld}"


@query(_player_markets_sql(ORACLE["player_projection"]))
def player_market_rows(spark, d):
    return entities.player_markets(QUERIES["player_projection"](spark, d))


@query(over("matches", "select id, case when better then nk else kickoff_utc end as kickoff_utc, kickoff_is_exact or better as kickoff_is_exact, case when ns = 'played' then 'played' else status end as status from (select m.*, nk, ns, coalesce(ne, false) and not kickoff_is_exact as better from matches m left join n using (id))",
    "n as (select id, (kickoff_date + 1)::timestamp as nk, id % 3 = 0 as ne, case when id % 2 = 0 then 'played' else 'scheduled' end as ns from matches where id % 5 <> 0)"))
def kickoff_upgrades(spark, d):
    m = derived.matches(spark, d)
    new = m.where("id % 5 <> 0").select("id", F.date_add("kickoff_date", 1).cast("timestamp").alias("kickoff_utc"), (F.col("id") % 3 == 0).alias("kickoff_is_exact"), F.when(F.col("id") % 2 == 0, "played").otherwise("scheduled").alias("status"))
    return entities.upgrade_kickoffs(m.select("id", "kickoff_utc", "kickoff_is_exact", "status"), new)


@query("""with o as (select user_id as player_id, max(value) as chance, max(event_type) as status from events where event_id % 2 = 0 group by 1),
n as (select user_id as player_id, min(value) as chance, case when user_id % 3 <> 0 then min(event_type) end as status from events where event_id % 2 = 1 group by 1)
select coalesce(o.player_id, n.player_id) as player_id, coalesce(n.chance, o.chance) as chance, coalesce(n.status, o.status) as status from o full join n on o.player_id = n.player_id""")
def availability_upsert(spark, d):
    e = derived.table(spark, d, "events")
    old = e.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("player_id")).agg(F.max("value").alias("chance"), F.max("event_type").alias("status"))
    new = e.where("event_id % 2 = 1").groupBy(F.col("user_id").alias("player_id")).agg(F.min("value").alias("chance"), F.min("event_type").alias("status"))
    return entities.upsert(old, new.withColumn("status", F.when(F.col("player_id") % 3 != 0, F.col("status"))), ["player_id"], ["chance", "status"])


@query("""with known as (select s_suppkey as team_id, s_name as name from supplier where s_suppkey % 4 <> 0), fresh as (select distinct s_name as name from supplier where s_name not in (select name from known))
select team_id, name from known union all select (select max(team_id) from known) + row_number() over (order by name), name from fresh""")
def teams_get_or_create(spark, d):
    s = derived.table(spark, d, "supplier")
    return entities.get_or_create(s.select(F.col("s_name").alias("name")), s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("name")), "team_id", "name")


@query("""with s as (select user_id % 50 as competition_id, 'v' || (event_id % 3) as model_version, event_id % 4 as k, ts, event_id, value from events where value is not null),
newest as (select * from (select *, row_number() over (partition by competition_id order by ts desc, event_id desc) as r from s where model_version = 'v2' and k >= 2) where r = 1),
c as (select i as competition_id from range(60) as t(i))
select c.competition_id, case when n.k is null then 'default' else 'stored' end as source, m.model, case when n.k is null then m.d else n.value / m.i end as weight
from c left join newest n using (competition_id) cross join (values ('dixon_coles', 0.3893::double, 1), ('elo', 0.3961::double, 2), ('logistic', 0.2147::double, 3)) as m(model, d, i) where n.k is null or m.i <= n.k""")
def registered_weights(spark, d):
    e = derived.table(spark, d, "events").where("value is not null")
    names = list(entities.DEFAULT_WEIGHTS)
    entry = lambda i: F.create_map(*[x for j in range(i) for x in (F.lit(names[j]), F.col("value") / (j + 1))])
    weights = F.when(F.col("event_id") % 4 == 3, entry(3)).when(F.col("event_id") % 4 == 2, entry(2)).when(F.col("event_id") % 4 == 1, entry(1))
    stored = e.select((F.col("user_id") % 50).alias("competition_id"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("model_version"), weights.alias("weights"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return entities.stored_weights(stored, spark.range(60).select(F.col("id").alias("competition_id")), "v2")


@query(over("matches", "select model, floor(round(home / 0.1::double, 9))::int as band, count(*) as n, round(avg(home), 6) as predicted, round(avg((outcome = 'H')::int), 6) as observed from preds group by 1, 2 having count(*) >= 40", _PREDS))
def reliability_bands(spark, d):
    return entities.reliability_bands(predictions(spark, d).select("model", F.col("home").alias("p"), (F.col("outcome") == "H").alias("truth")))


_EVIDENCE = """n_all as (select competition_id, count(*) as n from done group by 1), n_team as (select competition_id, team_id, count(*) as n from sides group by 1, 2),
gate as (select m.id, coalesce(a.n, 0) as n, least(coalesce(h.n, 0), coalesce(w.n, 0)) as few from matches m left join n_all a using (competition_id)
  left join n_team h on h.competition_id = m.competition_id and h.team_id = home_team_id left join n_team w on w.competition_id = m.competition_id and w.team_id = away_team_id where status = 'scheduled'),
noted as (select id, case when n < 60 then n || ' of 60 matches in the competition' when few < 4 then few || ' of 4 matches of a team' end as note from gate)"""


@query(over("hist", "select id, note is null as sufficient_data, note from noted", _EVIDENCE))
def elo_evidence(spark, d):
    return models.elo_evidence(cut(spark, d).completed(), derived.matches(spark, d).where("status = 'scheduled'"))


@query(over("hist", "select coalesce(note, 'rated') as reason, count(*) as n from noted group by 1", _EVIDENCE))
def skip_counters(spark, d):
    return elo_evidence(spark, d).groupBy(F.coalesce("note", F.lit("rated")).alias("reason")).agg(F.count("*").alias("n"))


@query("select o_orderkey as id, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) as digest from orders")
def content_digests(spark, d):
    o = derived.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256).alias("digest"))


@query()
def forward_validation(spark, d):
    """All competitions as one, as a single run has them."""
    p = predictions(spark, d).withColumn("p", evaluation._of_truth()).withColumn("competition_id", F.lit(0).cast("long"))
    return models.forward_validation(p.select("competition_id", "id", "kickoff_date", "model", "p"), ["steep", "flat"]).drop("losses")
