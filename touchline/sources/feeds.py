"""The feeds as data sources of Spark: spark.read.format("touchline").option("source", ...).option("capability", ...).load(folder).

One partition a file; the schema follows from the capability. A source that doesn't
provide a capability gives an empty frame with that schema, and outcomes() says so. Files
are opened through Arrow's file systems, so a folder may be a URI of any that it knows.
Rows that a feed must drop (without a day, a side, a kickoff) are dropped here as in sources.files.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import MATCH_STATS, REGISTRY, STATUS, is_odds

_SIDE = ", ".join(f"{a} int" for a in MATCH_STATS.values())
_GOALS = "ft_home_goals int, ft_away_goals int, ht_home_goals int, ht_away_goals int"
#: The rows of each capability, whatever the source.
SCHEMAS = {
    "matches": f"kickoff_date date, kickoff_utc timestamp, home string, away string, {_GOALS}, round string, referee string, status string",
    "team_stats": f"kickoff_date date, home string, away string, {_SIDE}",
    "fixtures": "kickoff_date date, kickoff_utc timestamp, home string, away string, ft_home_goals int, ft_away_goals int, round string, external_id string",
    "availability": "player_id long, player string, team_name string, status string, chance_of_playing double, news string, observed_at timestamp",
    "player_stats": "player_id long, player string, position string, team_name string, kickoff_utc timestamp, is_home boolean, minutes int, goals int, assists int, yellows int, reds int, xg double, xa double, started boolean, round int",
    "weather": "ts timestamp, temperature double, humidity double, precipitation double, wind double",
}
_DAYS = ("%d/%m/%Y", "%d/%m/%y", "%Y-%m-%d", "%d-%m-%Y", "%d.%m.%Y")


def _real(text) -> float | None:
    try:
        value = float(str(text).strip())
    except ValueError:
        return None
    return value if abs(value) < 1e300 else None


def _whole(text) -> int | None:
    value = _real(text)
    return None if value is None or abs(value) >= 2e9 else int(value)


def _day(text) -> dt.date | None:
    for shape in _DAYS:
        try:
            return dt.datetime.strptime((text or "").strip(), shape).date()
        except ValueError:
            continue
    return None


def _time(text) -> dt.datetime | None:
    try:
        found = dt.datetime.fromisoformat((text or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return found.astimezone(dt.timezone.utc).replace(tzinfo=None) if found.tzinfo else found


def _table(text: str) -> list[dict]:
    """Rows of a CSV file by column, without prices."""
    rows = csv.DictReader(io.StringIO(text.lstrip("﻿")))
    return [{k.strip(): (v or "").strip() for k, v in r.items() if k and not is_odds(k)} for r in rows]


def _results(text: str, capability: str) -> Iterator[tuple]:
    for r in _table(text):
        day, home, away = _day(r.get("Date")), r.get("HomeTeam", ""), r.get("AwayTeam", "")
        if day is None or not home or not away:
            continue
        if capability == "team_stats":
            yield (day, home, away, *[_whole(r.get(c, "")) for c in MATCH_STATS])
            continue
        clock = re.fullmatch(r"(\d{1,2}):(\d{2})", r.get("Time", ""))
        at = dt.datetime.combine(day, dt.time(int(clock[1]), int(clock[2]))) if clock and int(clock[1]) < 24 and int(clock[2]) < 60 else None
        goals = [_whole(r.get(c, "")) for c in ("FTHG", "FTAG", "HTHG", "HTAG")]
        yield (day, at, home, away, *goals, None, r.get("Referee") or None, "played" if None not in goals[:2] else "scheduled")


def _results_json(text: str, capability: str) -> Iterator[tuple]:
    for m in json.loads(text).get("matches", []):
        day = _day(m.get("date"))
        if day is None or not m.get("team1") or not m.get("team2"):
            continue
        score = m.get("score") if isinstance(m.get("score"), dict) else {}
        goals = [score[part][i] if isinstance(score.get(part), list) and len(score[part]) == 2 else None for part in ("ft", "ht") for i in (0, 1)]
        clock = re.match(r"(\d{1,2}):(\d{2})", m.get("time") or "")
        at = dt.datetime.combine(day, dt.time(int(clock[1]), int(clock[2]))) if clock else None
        yield (day, at, m["team1"], m["team2"], *goals, m.get("round"), None, "played" if None not in goals[:2] else "scheduled")


def _fixtures(text: str, capability: str) -> Iterator[tuple]:
    data = json.loads(text)
    names = {t["id"]: t["name"] for t in data.get("teams", [])}
    for f in data.get("fixtures", []):
        at, home, away = _time(f.get("kickoff_time")), names.get(f.get("team_h")), names.get(f.get("team_a"))
        if at is not None and home and away:
            done = bool(f.get("finished"))
            yield (at.date(), at, home, away, f.get("team_h_score") if done else None, f.get("team_a_score") if done else None, None if f.get("event") is None else str(f["event"]), None if f.get("id") is None else str(f["id"]))


def _availability(text: str, capability: str) -> Iterator[tuple]:
    data = json.loads(text)
    names = {t["id"]: t["name"] for t in data.get("teams", [])}
    for e in data.get("elements", []):
        chance = _real(e.get("chance_of_playing_next_round"))
        yield (e.get("id"), f"{e.get('first_name') or ''} {e.get('second_name') or ''}".strip(), names.get(e.get("team")), STATUS.get(e.get("status"), "unknown"), None if chance is None else chance / 100, e.get("news"), _time(e.get("news_added")))


def _players(text: str, capability: str) -> Iterator[tuple]:
    for r in _table(text):
        started = _whole(r.get("starts", ""))
        yield (_whole(r.get("element", "")), r.get("name"), r.get("position", ""), r.get("team"), _time(r.get("kickoff_time")), r.get("was_home", "").lower() == "true", *[_whole(r.get(c, "")) for c in ("minutes", "goals_scored", "assists", "yellow_cards", "red_cards")],
               _real(r.get("expected_goals", "")), _real(r.get("expected_assists", "")), None if started is None else started > 0, _whole(r.get("round", r.get("GW", ""))))


def _weather(text: str, capability: str) -> Iterator[tuple]:
    hourly = json.loads(text).get("hourly", {})
    columns = [hourly.get(c, []) for c in ("time", "temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m")]
    for ts, *values in zip(*columns, strict=False):
        yield (_time(ts), *[_real(v) for v in values])


_PARSERS = {"publisher_csv": _results, "mirror_csv": _results, "results_json": _results_json, "fixtures_json": _fixtures, "availability_json": _availability, "player_csv": _players, "weather_json": _weather}


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, source: str, capability: str, path: str):
        self.source, self.capability, self.path = source, capability, path

    def partitions(self) -> list[File]:
        from pyarrow import fs

        if self.capability not in REGISTRY[self.source].capabilities:
            return []
        system, path = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [File(self.path)]
        base = self.path.rstrip("/")
        return [File(f"{base}/{f.path[len(path.rstrip('/')) + 1 :]}") for f in sorted(system.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda f: f.path) if f.type == fs.FileType.File]

    def read(self, partition) -> Iterator[tuple]:
        from pyarrow import fs

        if not isinstance(partition, File):
            return
        system, path = fs.FileSystem.from_uri(partition.path if "://" in partition.path else f"file://{partition.path}")
        with system.open_input_stream(path) as f:
            yield from _PARSERS[self.source](f.read().decode("utf-8", "replace"), self.capability)


class Feed(DataSource):
    """Options: source, a key of the registry; capability, which must be one that some source could provide."""

    @classmethod
    def name(cls) -> str:
        return "touchline"

    def schema(self) -> str:
        if self.options.get("source") not in REGISTRY:
            raise ValueError(f"unknown source {self.options.get('source')}")
        if self.options.get("capability") not in SCHEMAS:
            raise ValueError(f"unknown capability {self.options.get('capability')}")
        return SCHEMAS[self.options["capability"]]

    def reader(self, schema) -> Reader:
        return Reader(self.options["source"], self.options["capability"], self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Feed)


def outcomes(spark: SparkSession, asked: list[tuple[str, str]]) -> DataFrame:
    """(source, capability, status, note) of what is asked of sources: ok, or unsupported with a reason."""
    rows = []
    for source, capability in asked:
        ok = source in REGISTRY and capability in REGISTRY[source].capabilities
        rows.append((source, capability, "ok" if ok else "unsupported", None if ok else f"{source} does not provide {capability}" if source in REGISTRY else f"{source} is not registered"))
    return spark.createDataFrame(rows, "source string, capability string, status string, note string")
