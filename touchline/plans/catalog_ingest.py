"""The catalogue continued: batches of staged records folded into the store, players' identity, names to teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import ingest, merge
from touchline.session import written
from touchline.sources import derived

from .base_sql import over
from .catalog import cut, query

#: Three sources' records of the matches by rule, and a store that misses a quarter of them. The same rules in SQL below.
_SOURCES = {"results": 0.60, "mirror": 0.85, "publisher": 0.90}


def stored_matches(spark, d, of=None):
    """of: the matches, where they are written already; so below."""
    m = (derived.matches(spark, d) if of is None else of).where("id % 4 <> 0")
    score = F.col("id") % 6 != 0
    return m.select(
        "id", "competition_id", "home_team_id", "away_team_id", F.when(score, F.col("ft_home_goals")).alias("ft_home_goals"), F.when(score, F.col("ft_away_goals")).alias("ft_away_goals"), F.lit(None).cast("int").alias("ht_home_goals"), F.lit(None).cast("int").alias("ht_away_goals"),
        F.when(F.col("id") % 3 != 0, F.col("referee")).otherwise("").alias("referee"), F.lit(None).cast("int").alias("matchday"), "kickoff_date", F.lit(None).cast("timestamp").alias("kickoff_utc"), F.lit(False).alias("kickoff_is_exact"),
        F.when(score, "played").otherwise("scheduled").alias("status"), F.create_map(F.lit("seed"), F.col("id").cast("string")).alias("external_ids"), F.lit("seed").alias("source"), F.lit(0.7).alias("reliability"))


def staged_records(spark, d, of=None):
    """Up to three records a match; one in 23 has no away side, one in 29 the same side twice."""
    m = derived.matches(spark, d) if of is None else of
    c = F.col
    away = F.when(c("id") % 23 == 0, F.lit(None).cast("long")).when(c("id") % 29 == 0, c("home_team_id")).otherwise(c("away_team_id")).alias("away_team_id")
    none = lambda t: F.lit(None).cast(t)

    def of(source, k, where, home, away_goals, half, referee, matchday, shift, utc, exact):
        return m.where(where).select(
            (c("id") * 3 + k).alias("record_id"), F.lit(k).alias("arrival"), "competition_id", "home_team_id", away, home.alias("ft_home_goals"), away_goals.alias("ft_away_goals"), half.alias("ht_home_goals"), c("ht_away_goals").alias("ht_away_goals"),
            referee.alias("referee"), matchday.alias("matchday"), F.date_add("kickoff_date", shift).alias("kickoff_date"), utc.alias("kickoff_utc"), exact.alias("kickoff_is_exact"), c("status").alias("status"),
            F.create_map(F.lit(source), (c("id") % 1000).cast("string")).alias("external_ids"), F.lit(source).alias("source"), F.lit(_SOURCES[source]).alias("reliability"))

    h, a = c("ft_home_goals"), c("ft_away_goals")
    return (
        of("results", 0, "id % 3 <> 0", h, F.when(c("id") % 17 == 0, a + 1).otherwise(a), none("int"), none("string"), (c("id") % 38).cast("int"), F.lit(0), none("timestamp"), F.lit(False))
        .unionByName(of("mirror", 1, "id % 5 <> 0", h, a, none("int"), F.when(c("id") % 3 != 0, c("referee")), none("int"), F.lit(0), none("timestamp"), F.lit(False)))
        .unionByName(of("publisher", 2, "id % 2 = 0", F.when(c("id") % 11 == 0, h + 1).otherwise(h), a, c("ht_home_goals"), F.when(c("id") % 7 == 0, F.concat("referee", F.lit("x"))).otherwise(c("referee")), none("int"), F.when(c("id") % 13 == 0, 1).otherwise(0), c("kickoff_utc"), c("kickoff_is_exact")))
    )


def batch(spark, d):
    """(folded, staged): the order lines are read once for the matches, and staged records are written once, whatever reads them afterwards."""
    m = written(derived.matches(spark, d), "derived")
    staged = written(staged_records(spark, d, m), "staged")
    return ingest.fold(stored_matches(spark, d, m), staged), staged


_STORE = """store as (
  select id, competition_id, home_team_id, away_team_id, case when id % 6 <> 0 then ft_home_goals end as fh, case when id % 6 <> 0 then ft_away_goals end as fa, null::int as hh, null::int as ha, case when id % 3 <> 0 then referee else '' end as referee, null::int as matchday,
    kickoff_date, null::timestamp as kickoff_utc, false as exact, case when id % 6 <> 0 then 'played' else 'scheduled' end as status, 'seed' as source, 0.7::double as rel, map {'seed': id::varchar} as ids from matches where id % 4 <> 0
)"""
_STAGED = """base as (select *, case when id % 23 = 0 then null when id % 29 = 0 then home_team_id else away_team_id end as away2 from matches),
staged as (
  select id * 3 as record_id, competition_id, home_team_id, away2 as away_team_id, ft_home_goals as fh, case when id % 17 = 0 then ft_away_goals + 1 else ft_away_goals end as fa, null::int as hh, ht_away_goals as ha, null::varchar as referee, (id % 38)::int as matchday, kickoff_date, null::timestamp as kickoff_utc, false as exact, status, 'results' as source, 0.60::double as rel, map {'results': (id % 1000)::varchar} as ids from base where id % 3 <> 0
  union all select id * 3 + 1, competition_id, home_team_id, away2, ft_home_goals, ft_away_goals, null, ht_away_goals, case when id % 3 <> 0 then referee end, null, kickoff_date, null, false, status, 'mirror', 0.85, map {'mirror': (id % 1000)::varchar} from base where id % 5 <> 0
  union all select id * 3 + 2, competition_id, home_team_id, away2, case when id % 11 = 0 then ft_home_goals + 1 else ft_home_goals end, ft_away_goals, ht_home_goals, ht_away_goals, case when id % 7 = 0 then referee || 'x' else referee end, null, case when id % 13 = 0 then kickoff_date + 1 else kickoff_date end, kickoff_utc, kickoff_is_exact, status, 'publisher', 0.90, map {'publisher': (id % 1000)::varchar} from base where id % 2 = 0
), usable as (select *, case when month(kickoff_date) < 7 then year(kickoff_date) - 1 else year(kickoff_date) end as season from staged where home_team_id <> away_team_id),
stored as (select *, case when month(kickoff_date) < 7 then year(kickoff_date) - 1 else year(kickoff_date) end as season from store),
hit as (select record_id, arg_min(s.id, (abs(date_diff('day', s.kickoff_date, u.kickoff_date)), s.kickoff_date, s.id)) as match_id from usable u join stored s using (competition_id, season, home_team_id, away_team_id) where abs(date_diff('day', s.kickoff_date, u.kickoff_date)) <= 1 group by 1),
fresh as (select *, sum(gap) over (partition by competition_id, season, home_team_id, away_team_id order by kickoff_date, record_id) as run from (select *, coalesce((kickoff_date - lag(kickoff_date) over (partition by competition_id, season, home_team_id, away_team_id order by kickoff_date, record_id) > 1)::int, 1) as gap from usable anti join hit using (record_id))),
records as (
  select id::varchar as match, 0 as new, u.* exclude (id), 0 as record_id, true as stored from store u
  union all by name select match_id::varchar as match, 1 as new, u.* exclude (season), false as stored from usable u join hit using (record_id)
  union all by name select 'new:' || competition_id || ':' || season || ':' || home_team_id || ':' || away_team_id || ':' || run as match, 1 as new, f.* exclude (season, gap, run), false as stored from fresh f
), ordered as (select *, row_number() over (partition by match order by new, rel, record_id % 3, record_id) as k from records)"""
_STEP = """select s.match, r.k, s.competition_id, s.home_team_id, s.away_team_id,
    {fields},
    case when denied or not r.exact or s.exact or r.kickoff_utc is null then s.kickoff_date else r.kickoff_date end as kickoff_date, case when denied or not r.exact or s.exact or r.kickoff_utc is null then s.kickoff_utc else r.kickoff_utc end as kickoff_utc,
    s.exact or (not denied and r.exact and r.kickoff_utc is not null) as exact, case when not denied and r.status = 'played' then 'played' else s.status end as status,
    case when changed and not denied and r.rel >= s.rel then r.source else s.source end as source, case when changed and not denied and r.rel >= s.rel then r.rel else s.rel end as rel,
    case when denied then s.ids else map_concat(s.ids, r.ids) end as ids, s.clashes + clash::int as clashes, s.written, s.updated + (changed and not denied)::int as updated, s.refused + denied::int as refused,
    s.log || case when clash then [concat_ws(' ', s.source, coalesce(s.fh::varchar, '?') || '-' || coalesce(s.fa::varchar, '?'), r.source, coalesce(r.fh::varchar, '?') || '-' || coalesce(r.fa::varchar, '?'), case when denied then 'stored' else 'new' end)] else [] end as log
  from folded s join lateral (select *, coalesce(s.fh is not null and o.fh is not null and (s.fh, s.fa) is distinct from (o.fh, o.fa), false) as clash from ordered o where o.match = s.match and o.k = s.k + 1) r on true,
  lateral (select r.clash and r.rel <= s.rel as denied), lateral (select {change} or (r.exact and not s.exact and r.kickoff_utc is not null) or (r.status = 'played' and s.status <> 'played') or coalesce(s.ids[map_keys(r.ids)[1]] is distinct from map_values(r.ids)[1], false) as changed)"""


def _fold_sql() -> str:
    numbers, text = ("fh", "fa", "hh", "ha", "matchday"), "referee"
    given = lambda f: f"r.{f} is not null" + (f" and r.{f} <> ''" if f == text else "")
    empty = lambda f: f"(s.{f} is null" + (f" or s.{f} = ''" if f == text else "") + ")"
    moves = {f: f"coalesce({given(f)} and ({empty(f)} or (r.rel >= s.rel and s.{f} <> r.{f})), false)" for f in (*numbers, text)}
    fields = ", ".join(f"case when not denied and {m} then r.{f} else s.{f} end as {f}" for f, m in moves.items())
    first = "select match, k, competition_id, home_team_id, away_team_id, fh, fa, hh, ha, matchday, referee, kickoff_date, kickoff_utc, exact, status, source, rel, ids, 0 as clashes, (not stored)::int as written, 0 as updated, 0 as refused, []::varchar[] as log from ordered where k = 1"
    return f", folded as ({first} union all {_STEP.format(fields=fields, change=' or '.join(moves.values()))})"


_FOLD = over("matches", "SELECT", _STORE, _STAGED).replace("with ", "with recursive ", 1).replace("\nSELECT", _fold_sql() + ", done as (select * from (select *, row_number() over (partition by match order by k desc) as newest from folded) where newest = 1)\n")


@query(_FOLD + """select match, competition_id, home_team_id, away_team_id, fh as ft_home_goals, fa as ft_away_goals, hh as ht_home_goals, ha as ht_away_goals, referee, matchday, kickoff_date, kickoff_utc, exact as kickoff_is_exact, status, source, rel as reliability,
  array_to_string(list_sort(list_transform(map_entries(ids), lambda e: e.key || '=' || e.value)), ',') as external_ids, clashes::int as n_conflicts from done""")
def ingest_batch(spark, d):
    r, _ = batch(spark, d)
    ids = F.array_join(F.array_sort(F.transform(F.map_entries("external_ids"), lambda e: F.concat_ws("=", e.key, e.value))), ",")
    return r.select("match", "competition_id", "home_team_id", "away_team_id", *ingest.FIELDS, "kickoff_date", "kickoff_utc", "kickoff_is_exact", "status", "source", "reliability", ids.alias("external_ids"), F.size("conflicts").alias("n_conflicts"))


@query(_FOLD + "select match, unnest(log) as conflict from done")
def ingest_conflicts(spark, d):
    r = ingest.conflicts(batch(spark, d)[0])
    return r.select("match", F.concat_ws(" ", "stored_source", "stored", "new_source", "new", "kept").alias("conflict"))


@query(_FOLD + """select source, count(*) as records, count(*) filter (usable) as used from (select s.source, coalesce(home_team_id <> away_team_id, false) as usable from staged s) group by 1""")
def ingest_records(spark, d):
    """How many records of each source the batch holds, and how many of them have two teams."""
    folded, staged = batch(spark, d)
    log = ingest.run_log(written(folded.select("events", "conflicts"), "folded"), staged)
    return log.select("source", "records", (F.col("records") - F.col("skipped")).alias("used"))


@query(_FOLD + "select sum(written)::bigint as written, sum(updated)::bigint as updated, sum(refused)::bigint as refused, sum(clashes)::bigint as conflicts from done")
def ingest_totals(spark, d):
    folded, staged = batch(spark, d)
    log = ingest.run_log(written(folded.select("events", "conflicts"), "folded"), staged)
    return log.agg(*[F.sum(c).alias(c) for c in ("written", "updated", "refused", "conflicts")])


_SEEN = """seen as (select trim(p_name) as name, p_partkey % 7 as team_id, p_partkey as moment from part where p_partkey % 3 <> 0),
stored as (select p_partkey as player_id, case when p_partkey % 4 = 0 then p_name || ' II' else p_name end as name, case when p_partkey % 5 = 0 then 99 else p_partkey % 7 end as team_id from part where p_partkey % 2 = 0)"""


@query(f"""with {_SEEN}, named as (select name, arg_max(team_id, (moment, team_id)) as team_id from seen where name <> '' group by 1),
r as (select n.*, (select min(player_id) from stored s where s.name = n.name and s.team_id = n.team_id) as exact_id, (select min(player_id) from stored s where s.name = n.name) as name_id from named n)
select s.player_id, s.name, coalesce(r.team_id, s.team_id) as team_id, case when r.name is null then 'unseen' when r.exact_id is not null then 'same' else 'moved' end as how from stored s left join r on coalesce(r.exact_id, r.name_id) = s.player_id
union all select (select max(player_id) from stored) + row_number() over (order by name), name, team_id, 'new' from r where name_id is null""")
def player_identities(spark, d):
    p = derived.table(spark, d, "part")
    key = F.col("p_partkey")
    seen = p.where("p_partkey % 3 <> 0").select(F.col("p_name").alias("name"), (key % 7).alias("team_id"), key.alias("at"))
    stored = p.where("p_partkey % 2 = 0").select(key.alias("player_id"), F.when(key % 4 == 0, F.concat("p_name", F.lit(" II"))).otherwise(F.col("p_name")).alias("name"), F.when(key % 5 == 0, F.lit(99).cast("long")).otherwise(key % 7).alias("team_id"))
    return ingest.players(stored, seen)


_REQUESTS = "asked as (select id as row_id, competition_id, home_team_id, away_team_id, kickoff_date + (id % 7)::int - 3 as day from matches)"
_NEAR = "hit as (select row_id, r.competition_id, r.home_team_id, r.away_team_id, day, arg_min(m.id, (abs(date_diff('day', day, m.kickoff_date)), m.kickoff_date, m.id)) filter (m.id is not null) as match_id from asked r left join matches m on m.competition_id = r.competition_id and m.home_team_id = r.home_team_id and m.away_team_id = r.away_team_id and abs(date_diff('day', day, m.kickoff_date)) <= 2 group by 1, 2, 3, 4, 5)"
_MADE = "made as (select *, (select max(id) from matches) + row_number() over (order by competition_id, home_team_id, away_team_id, day) as new_id from (select distinct competition_id, home_team_id, away_team_id, day from hit where match_id is null))"


def _requests(spark, d):
    m = derived.matches(spark, d)
    asked = m.select(F.col("id").alias("row_id"), "competition_id", "home_team_id", "away_team_id", F.date_add("kickoff_date", (F.col("id") % 7).cast("int") - 3).alias("day"))
    return merge.requested_fixtures(asked, m)


@query(over("matches", "select row_id, coalesce(match_id, new_id) as match_id, match_id is null as placeholder from hit left join made using (competition_id, home_team_id, away_team_id, day)", _REQUESTS, _NEAR, _MADE))
def requested_fixtures(spark, d):
    """Requests up to three days off their match."""
    return _requests(spark, d)[0]


@query(over("matches", "select new_id as id, competition_id, home_team_id, away_team_id, day as kickoff_date, day::timestamp + interval 15 hours as kickoff_utc, false as kickoff_is_exact, 'scheduled' as status from made", _REQUESTS, _NEAR, _MADE))
def placeholder_fixtures(spark, d):
    return _requests(spark, d)[1]


@query(over("hist", "select team_id, id, kickoff_date, opponent_id from hist where rn = 1"))
def last_matches(spark, d):
    return cut(spark, d).last_match()


@query("""select player_id, match_date, source, minutes, goals from (select *, row_number() over (partition by player_id, match_date, source order by arrival desc, minutes desc, goals desc, team_id desc) as k from (
  select l_partkey as player_id, l_shipdate::date as match_date, l_linenumber % 3 as source, least(l_quantity::int * 2, 90) as minutes, (l_partkey % 3)::int as goals, l_orderkey as arrival, l_suppkey as team_id from lineitem)) where k = 1""")
def player_rows_upsert(spark, d):
    """Statistics of a player, day and source that arrive several times: the last one counts."""
    rows = derived.players(spark, d).withColumn("source", F.col("l_linenumber") % 3).withColumnRenamed("l_orderkey", "arrival")
    return ingest.newest_rows(rows, ["player_id", "match_date", "source"], ["arrival", "minutes", "goals", "team_id"]).select("player_id", "match_date", "source", "minutes", "goals")


@query("""select match_id, kind, player_id, position from (select *, row_number() over (partition by match_id, kind, player_id order by event_id desc) as k from (
  select event_id % 500 as match_id, case when event_id % 2 = 0 then 'predicted' else 'confirmed' end as kind, user_id as player_id, event_type as position, event_id from events)) where k = 1""")
def lineups_upsert(spark, d):
    """Lineups by rule from events: of each match, kind and player the newest entry."""
    e = derived.table(spark, d, "events")
    rows = e.select((F.col("event_id") % 500).alias("match_id"), F.when(F.col("event_id") % 2 == 0, "predicted").otherwise("confirmed").alias("kind"), F.col("user_id").alias("player_id"), F.col("event_type").alias("position"), "event_id")
    return ingest.newest_rows(rows, ["match_id", "kind", "player_id"], ["event_id"]).select("match_id", "kind", "player_id", "position")
