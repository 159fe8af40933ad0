"""SQL of the derived tables, as common table expressions for the oracle queries."""

from __future__ import annotations

AS_OF = "1999-06-15 14:30:00"
SEASON_START = "1998-07-01"
SINCE = "1996-07-01"

_LINES = """lines as (
  select *, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_shipdate) as rn from lineitem
)"""
_MATCHES = """matches0 as (
  select h.l_orderkey as id, o.o_orderkey % 5 as competition_id, h.l_suppkey as home_team_id, a.l_suppkey as away_team_id,
    h.l_quantity::int % 5 as ft_home_goals, a.l_quantity::int % 4 as ft_away_goals,
    case when o_custkey % 7 <> 0 then (h.l_quantity::int % 5) // 2 end as ht_home_goals, case when o_custkey % 7 <> 0 then (a.l_quantity::int % 4) // 2 end as ht_away_goals,
    o_orderdate::date as kickoff_date, o_orderpriority in ('1-URGENT', '2-HIGH') as kickoff_is_exact,
    case when o_orderpriority in ('1-URGENT', '2-HIGH') then (o_orderdate::date)::timestamp + to_hours(12 + (o_custkey % 10)::int) end as kickoff_utc,
    case when o_orderstatus = 'P' then 'scheduled' else 'played' end as status, 'ref_' || (o_custkey % 40) as referee
  from lines h join lines a on h.l_orderkey = a.l_orderkey and h.rn = 1 and a.rn = 2 and h.l_suppkey <> a.l_suppkey join orders o on o.o_orderkey = h.l_orderkey
), matches as (
  select *, case when kickoff_is_exact then kickoff_utc + interval 150 minutes else (kickoff_date + 1)::timestamp end as known_at from matches0
)"""
_STATS = """candidates as (
  select m.id as match_id, t.team_id, l_linenumber % 3 as source_id, case l_linenumber % 3 when 0 then 0.90 when 1 then 0.85 else 0.60 end as reliability,
    (l_partkey % 20)::int as shots, (l_partkey % 8)::int as shots_on_target, case when l_returnflag <> 'R' then (l_partkey % 12)::int end as corners,
    case when l_linestatus <> 'F' then (l_suppkey % 30)::int end as fouls, (l_linenumber % 4)::int as yellows, case when l_discount = 0 then 1 else 0 end as reds, case when l_linestatus <> 'O' then round(l_discount * 20, 2) end as xg, l_shipdate as retrieved_at,
    row_number() over (partition by m.id, t.team_id order by case l_linenumber % 3 when 0 then 0.90 when 1 then 0.85 else 0.60 end desc, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) as best
  from matches m cross join lateral (select unnest([m.home_team_id, m.away_team_id]) as team_id) t join lineitem on l_orderkey = m.id and l_suppkey = t.team_id
), stats as (select * from candidates where best = 1)"""
_VIEW = f"""done as (select * from matches where status = 'played' and known_at <= timestamp '{AS_OF}'),
sides as (
  select id, competition_id, kickoff_date, known_at, referee, home_team_id as team_id, away_team_id as opponent_id, true as is_home, ft_home_goals as goals_for, ft_away_goals as goals_against, ht_home_goals as ht_goals_for from done
  union all
  select id, competition_id, kickoff_date, known_at, referee, away_team_id, home_team_id, false, ft_away_goals, ft_home_goals, ht_away_goals from done
), hist as (
  select s.*, case when goals_for > goals_against then 3 when goals_for = goals_against then 1 else 0 end as points,
    o.shots, o.shots_on_target, o.corners, o.fouls, o.yellows, o.reds, o.xg, p.shots as shots_against, p.shots_on_target as sot_against, p.corners as corners_against, p.yellows as yellows_against, p.xg as xga,
    row_number() over (partition by s.team_id order by kickoff_date desc, id desc) as rn
  from sides s left join stats o on o.match_id = s.id and o.team_id = s.team_id left join stats p on p.match_id = s.id and p.team_id = s.opponent_id
), hist80 as (select * from hist where rn <= 80)"""
_RATES = """rates as (
  select id, 0.6 + (home_team_id % 10) * 0.15::double as lam, 0.5 + (away_team_id % 9) * 0.12::double as mu, -0.05::double as rho from matches where status = 'scheduled'
)"""
_MATRIX = """raw as (
  select id, h, a, lam, mu, greatest(exp(-lam) * pow(lam, h) / factorial(h)::double * exp(-mu) * pow(mu, a) / factorial(a)::double
    * case when h = 0 and a = 0 then 1 - lam * mu * rho when h = 0 and a = 1 then 1 + lam * rho when h = 1 and a = 0 then 1 + mu * rho when h = 1 and a = 1 then 1 - rho else 1 end, 0) as w
  from rates, (select unnest(range(0, 11))::int as h), (select unnest(range(0, 11))::int as a)
), matrix as (select id, h, a, w / sum(w) over (partition by id) as p from raw)"""
_PLAYERS = """players as (
  select l_partkey as player_id, l_suppkey as team_id, l_shipdate::date as match_date, least(l_quantity::int * 2, 90) as minutes, (l_partkey % 3)::int as goals, (l_orderkey % 2)::int as assists,
    case when l_linestatus <> 'O' then l_discount * 5 end as xg, case when l_linestatus <> 'O' then l_tax * 5 end as xa, case when l_returnflag <> 'R' then l_quantity > 25 end as started, l_orderkey, l_linenumber, l_extendedprice
  from lineitem
), availability as (
  select event_id, user_id as player_id, ts as observed_at, ts + to_minutes(event_id % 60) as retrieved_at,
    case event_type when 'signup' then 'available' when 'view' then 'unknown' when 'click' then 'doubtful' when 'error' then 'injured' when 'purchase' then 'suspended' end as status, value / 500 as chance_of_playing, props as raw
  from events
)"""
_PARTS = {"matches": [_LINES, _MATCHES], "stats": [_LINES, _MATCHES, _STATS], "hist": [_LINES, _MATCHES, _STATS, _VIEW], "rates": [_LINES, _MATCHES, _RATES], "matrix": [_LINES, _MATCHES, _RATES, _MATRIX], "players": [_PLAYERS]}


def over(base: str, select: str, *ctes: str) -> str:
    """A query over one of the bases, with further expressions before it."""
    return "with " + ",\n".join([*_PARTS[base], *ctes]) + "\n" + select
