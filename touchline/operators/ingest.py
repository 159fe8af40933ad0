"""Ingestion of a batch: many staged records a match, from several sources, folded into the store with a log of conflicts and of the run.

Records find their match by equal keys and a day at most apart, first among stored
matches, else among themselves. All records of one match are one array, in order of
reliability and arrival; the fold over it is an expression, so no record leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import season_year

from .merge import near_date

#: What identifies a fixture besides its day, and what a record may fill in.
KEYS = ("competition_id", "season", "home_team_id", "away_team_id")
FIELDS = {"ft_home_goals": "int", "ft_away_goals": "int", "ht_home_goals": "int", "ht_away_goals": "int", "referee": "string", "matchday": "int"}
_REST = {"kickoff_date": "date", "kickoff_utc": "timestamp", "kickoff_is_exact": "boolean", "status": "string", "external_ids": "map<string,string>", "source": "string", "reliability": "double"}
RECORD = FIELDS | _REST
_CONFLICT = "array<struct<stored_source:string,stored:string,new_source:string,new:string,kept:string>>"
_STATE = "struct<" + ",".join(f"{c}:{t}" for c, t in RECORD.items()) + f",conflicts:{_CONFLICT},events:array<struct<source:string,action:string>>>"


def staged_matches(staged: DataFrame, stored: DataFrame, days: int = 1) -> DataFrame:
    """staged records with match: a stored match's id as text, or a name that records of one new match share; null where a side is
    unknown or both sides are one team. New records of a fixture belong together while no more than `days` lie between one and the next."""
    known = staged.where("home_team_id is not null and away_team_id is not null and home_team_id <> away_team_id").withColumn("season", season_year(F.col("kickoff_date")))
    candidates = stored.withColumn("season", season_year(F.col("kickoff_date"))).select("id", "kickoff_date", *KEYS)
    asks = known.select(F.col("record_id").alias("row_id"), *KEYS, F.col("kickoff_date").alias("day"))
    found = near_date(asks, candidates, days, KEYS).select(F.col("row_id").alias("record_id"), "match_id")
    rows = known.join(found, "record_id", "left")
    by = Window.partitionBy(*KEYS).orderBy("kickoff_date", "record_id")
    new = rows.where("match_id is null").withColumn("_gap", F.coalesce(F.datediff("kickoff_date", F.lag("kickoff_date").over(by)) > days, F.lit(True)).cast("int"))
    new = new.withColumn("_run", F.sum("_gap").over(by)).withColumn("match", F.concat_ws(":", F.lit("new"), *[F.col(k).cast("string") for k in KEYS], F.col("_run").cast("string"))).drop("_gap", "_run")
    return rows.where("match_id is not null").withColumn("match", F.col("match_id").cast("string")).unionByName(new).drop("match_id", "season").unionByName(
        staged.join(known.select("record_id"), "record_id", "left_anti").withColumn("match", F.lit(None).cast("string"))
    )


def _state(values: dict[str, Column], conflicts: Column, events: Column) -> Column:
    return F.struct(*[values[c].cast(t).alias(c) for c, t in RECORD.items()], conflicts.cast(_CONFLICT).alias("conflicts"), events.cast("array<struct<source:string,action:string>>").alias("events")).cast(_STATE)


def _folded(state: Column, new: Column) -> Column:
    """The state after one more record."""
    event = lambda action: F.array(F.struct(new.source.alias("source"), action.alias("action")))
    first = _state({c: new[c] for c in RECORD}, F.array(), F.when(new.stored, F.array()).otherwise(event(F.lit("written"))))
    score = lambda x: F.concat_ws("-", F.coalesce(x.ft_home_goals.cast("string"), F.lit("?")), F.coalesce(x.ft_away_goals.cast("string"), F.lit("?")))
    clash = state.ft_home_goals.isNotNull() & new.ft_home_goals.isNotNull() & ~(state.ft_home_goals.eqNullSafe(new.ft_home_goals) & state.ft_away_goals.eqNullSafe(new.ft_away_goals))
    refused = clash & (new.reliability <= state.reliability)
    may = new.reliability >= state.reliability
    values, moved = {}, []
    for c, t in FIELDS.items():
        given, empty = new[c].isNotNull(), state[c].isNull()
        if t == "string":
            given, empty = given & (new[c] != ""), empty | (state[c] == "")
        change = given & (empty | (may & (state[c] != new[c])))
        values[c] = F.when(change, new[c]).otherwise(state[c])
        moved.append(change)
    exact = new.kickoff_is_exact & ~state.kickoff_is_exact & new.kickoff_utc.isNotNull()
    for c in ("kickoff_utc", "kickoff_date"):
        values[c] = F.when(exact, new[c]).otherwise(state[c])
    played = (new.status == "played") & (state.status != "played")
    ids = F.when(new.external_ids.isNull(), state.external_ids).when(state.external_ids.isNull(), new.external_ids).otherwise(F.map_zip_with(state.external_ids, new.external_ids, lambda _, old, other: F.coalesce(other, old)))
    more = ~F.array_sort(F.map_entries(ids)).eqNullSafe(F.array_sort(F.map_entries(state.external_ids)))
    values |= {"kickoff_is_exact": state.kickoff_is_exact | exact, "status": F.when(played, "played").otherwise(state.status), "external_ids": ids}
    changed = exact | played | more
    for m in moved:
        changed = changed | m
    changed = F.coalesce(changed, F.lit(False))
    values |= {c: F.when(changed & may, new[c]).otherwise(state[c]) for c in ("source", "reliability")}
    note = F.struct(state.source.alias("stored_source"), score(state).alias("stored"), new.source.alias("new_source"), score(new).alias("new"), F.when(refused, "stored").otherwise("new").alias("kept"))
    conflicts = F.when(clash, F.array_append(state.conflicts, note)).otherwise(state.conflicts)
    kept = _state({c: state[c] for c in RECORD}, conflicts, F.concat(state.events, event(F.lit("kept"))))
    after = _state(values, conflicts, F.concat(state.events, event(F.when(changed, "updated").otherwise("unchanged"))))
    return F.when(state.isNull(), first).when(refused, kept).otherwise(after)


def fold(stored: DataFrame, staged: DataFrame, days: int = 1) -> DataFrame:
    """One row a match of the store, and of each new one: match, id (null where new), KEYS without the season, RECORD's columns, conflicts, events.

    stored: (id, KEYS without season, RECORD's columns). staged: (record_id, arrival, the same columns without id). Records are taken in
    order of reliability, then arrival, then record_id; a stored match comes before all. Scores that differ are a conflict; the record
    is refused unless its source is more reliable. Else gaps are filled, and values replaced by a source as reliable or more; an exact kickoff
    replaces a mere day, a status only moves to played, external ids are merged. Records without two teams change nothing.
    A null reliability counts as 0. Empty inputs are fine on either side.
    """
    of = lambda df, stored: df.withColumn("rel", F.coalesce("reliability", F.lit(0.0)))
    pair = [k for k in KEYS if k != "season"]
    flat = lambda df, old: df.select("match", "id", *pair, F.struct(
        F.lit(not old).alias("_new"), F.col("rel").alias("_rel"), F.col("arrival").cast("long").alias("_arrival"), F.col("record_id").cast("long").alias("_record"), F.lit(old).alias("stored"),
        *[F.coalesce(F.col(c), F.lit(False)).alias(c) if c == "kickoff_is_exact" else F.col("rel").alias(c) if c == "reliability" else F.col(c).cast(t).alias(c) for c, t in RECORD.items()]).alias("r"))
    old = flat(of(stored, True).withColumn("match", F.col("id").cast("string")).withColumn("arrival", F.lit(0)).withColumn("record_id", F.lit(0)), True)
    new = flat(of(staged_matches(staged, stored, days).where("match is not null"), False).withColumn("id", F.lit(None).cast(stored.schema["id"].dataType)), False)
    # maps can't be ordered: records are sorted by their first fields, told apart by record
    order = lambda a, b: F.when(a._new != b._new, F.when(b._new, -1).otherwise(1)).when(a._rel != b._rel, F.when(a._rel < b._rel, -1).otherwise(1)).when(a._arrival != b._arrival, F.when(a._arrival < b._arrival, -1).otherwise(1)).when(a._record < b._record, -1).when(a._record > b._record, 1).otherwise(0)
    each = old.unionByName(new).groupBy("match").agg(F.max("id").alias("id"), *[F.first(k).alias(k) for k in pair], F.array_sort(F.collect_list("r"), order).alias("records"))
    state = F.aggregate("records", F.lit(None).cast(_STATE), _folded)
    return each.withColumn("s", state).select("match", "id", *pair, "s.*")


def conflicts(folded: DataFrame) -> DataFrame:
    """A row for each conflict of scores: match, id, what stood, what came, what was kept."""
    return folded.select("match", "id", F.inline("conflicts"))


def run_log(folded: DataFrame, staged: DataFrame) -> DataFrame:
    """(source, records, written, updated, unchanged, conflicts, skipped) of a batch; skipped records have no two teams."""
    of = lambda a: F.count(F.when(F.col("action") == a, 1)).alias({"kept": "refused"}.get(a, a))
    done = folded.select(F.inline("events")).groupBy("source").agg(*[of(a) for a in ("written", "updated", "unchanged", "kept")])
    clashes = folded.select(F.inline("conflicts")).groupBy(F.col("new_source").alias("source")).agg(F.count("*").alias("conflicts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    r = staged.groupBy("source").agg(F.count("*").alias("records")).join(done, "source", "left").join(clashes, "source", "left")
    r = r.select("source", "records", *[zero(c) for c in ("written", "updated", "unchanged", "refused", "conflicts")])
    return r.withColumn("skipped", F.col("records") - F.col("written") - F.col("updated") - F.col("unchanged") - F.col("refused"))


def players(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(player_id, name, team_id, how) of every stored and seen player: a row seen under a stored (name, team) is that player; else under a
    stored name alone (the smallest id) it is that player, moved to the team; else it is a new one, numbered after all others.

    stored (player_id, name, team_id), seen (name, team_id, at): of a name seen several times the newest team counts. Blank names are skipped.
    """
    from .entities import numbered

    named = seen.withColumn("name", F.trim("name")).where("name <> ''").groupBy("name").agg(F.max_by("team_id", F.struct("at", "team_id")).alias("team_id"))
    exact = stored.groupBy("name", "team_id").agg(F.min("player_id").alias("exact_id"))
    alone = stored.groupBy("name").agg(F.min("player_id").alias("name_id"))
    r = named.join(exact, ["name", "team_id"], "left").join(alone, "name", "left")
    fresh = numbered(r.where("exact_id is null and name_id is null").select("name", "team_id"), stored.agg(F.max("player_id").alias("_last")), "player_id", ["name"])
    hit = r.where("name_id is not null").select(F.coalesce("exact_id", "name_id").alias("player_id"), F.col("team_id").alias("to_team"), F.when(F.col("exact_id").isNotNull(), "same").otherwise("moved").alias("how"))
    kept = stored.join(hit, "player_id", "left").select("player_id", "name", F.coalesce("to_team", "team_id").alias("team_id"), F.coalesce("how", F.lit("unseen")).alias("how"))
    return kept.unionByName(fresh.select("player_id", "name", "team_id", F.lit("new").alias("how")))


def newest_rows(rows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """An upsert by keys: of each key the row that arrived last. For player statistics (player, day, source), availability (player, time, source),
    lineups (match, team, player, kind) and conditions (match, source)."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(a) for a in arrival])
    return rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
