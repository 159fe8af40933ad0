"""Fits that Spark's expressions can't hold: ratings, scoring strengths, outcome models.

Each fit is one group's work (a competition, its matches since a date); groups run side
by side. Everything around the fits is joins.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalars import season_year


class Ratings:
    """The rating fold: what stands of a competition after the matches so far is a number a team, and how many matches it had."""

    def __init__(self, k: float = 20.0, start: float = 1500.0, home_bonus: float = 60.0, scale: float = 400.0, regress: float = 0.1):
        self.k, self.start, self.home_bonus, self.scale, self.regress = k, start, home_bonus, scale, regress
        self.rating: dict = {}
        self.seen: dict = {}
        self.season = None

    def add(self, season: int, home, away, home_goals, away_goals) -> tuple[float, float, float, bool]:
        """One match, after all before it: (home's rating before, away's, gap, drawn)."""
        if self.season is not None and season != self.season:
            self.rating = {t: x + self.regress * (self.start - x) for t, x in self.rating.items()}
        self.season = season
        h, a = self.rating.get(home, self.start), self.rating.get(away, self.start)
        gap = h + self.home_bonus - a
        score = 1.0 if home_goals > away_goals else 0.0 if home_goals < away_goals else 0.5
        weight = math.log(abs(home_goals - away_goals) + 1.0) * 2.2 / (0.001 * abs(gap) + 2.2)
        move = self.k * weight * (score - 1 / (1 + 10 ** (-gap / self.scale)))
        self.rating[home], self.rating[away] = h + move, a - move
        for t in (home, away):
            self.seen[t] = self.seen.get(t, 0) + 1
        return h, a, gap, score == 0.5


def fold_ratings(rows: pd.DataFrame, k: float = 20.0, start: float = 1500.0, home_bonus: float = 60.0, scale: float = 400.0, regress: float = 0.1) -> tuple[dict, dict, list[tuple]]:
    """Ratings and numbers of matches of all teams after these matches, in their order, and what stood before each: (id, competition_id, home, away, gap, drawn)."""
    held = Ratings(k, start, home_bonus, scale, regress)
    out = [(r.id, r.competition_id, *held.add(r.kickoff_date.year - (r.kickoff_date.month < 7), r.home_team_id, r.away_team_id, r.ft_home_goals, r.ft_away_goals)) for r in rows.itertuples()]
    return held.rating, held.seen, out


#: What the fold reads of a match, after the columns that name its group.
FOLDED = ("season", "home_team_id", "away_team_id", "ft_home_goals", "ft_away_goals")


def in_order(matches: DataFrame, *keys: str) -> DataFrame:
    """(keys, id, FOLDED) of matches: a group's matches stand in one partition in their order, so that a fold reads them as a stream and holds none."""
    rows = matches.select(*keys, "id", "kickoff_date", season_year(F.col("kickoff_date")).alias("season"), *FOLDED[1:])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "kickoff_date", "id").drop("kickoff_date")


def draw_line(gaps, drawn, least: int = 30) -> tuple[float, float]:
    """draw_curve's base and decay of one competition, from the fold's gaps and whether each match was drawn."""
    g, y = np.abs(np.asarray(gaps, float)), np.asarray(drawn, bool)
    edges = np.quantile(g, np.arange(6) / 5)
    fifths = [(g[i].mean(), y[i].mean()) for lo, hi in zip(edges, edges[1:], strict=False) if (i := (g >= lo) & (g <= hi)).sum() >= least]
    if len(fifths) >= 3 and len({x for x, _ in fifths}) > 1:
        slope, level = np.polyfit([x for x, _ in fifths], np.log(np.clip([p for _, p in fifths], 1e-3, 0.999)), 1)
        base, decay = float(np.exp(level)), float(-slope)
        if 0.05 <= base <= 0.6 and 0.0 <= decay <= 0.02:
            return round(base, 6), round(decay, 6)
    return round(float(y.mean()), 6), 0.0


def elo(matches: DataFrame, k: float = 20.0, start: float = 1500.0, home_bonus: float = 60.0, scale: float = 400.0, regress: float = 0.1) -> DataFrame:
    """(id, competition_id, home_before, away_before, gap, drawn): ratings before every match, by a fold over each competition's matches.

    The matches pass as a stream of batches; a task holds its teams' ratings and one batch.
    """

    def fold(batches):
        last, held = None, None
        for b in batches:
            ids, competitions = b.column("id"), b.column("competition_id")
            out = []
            for c, *match in zip(*(b.column(n).to_pylist() for n in ("competition_id", *FOLDED)), strict=True):
                if held is None or c != last:
                    last, held = c, Ratings(k, start, home_bonus, scale, regress)
                out.append(held.add(*match))
            if out:
                yield pa.RecordBatch.from_arrays([ids, competitions, *[pa.array(x, pa.float64()) for x in list(zip(*out, strict=True))[:3]], pa.array([x[3] for x in out], pa.bool_())], ["id", "competition_id", "home_before", "away_before", "gap", "drawn"])

    scored = matches.where(F.col("ft_home_goals").isNotNull() & F.col("ft_away_goals").isNotNull())
    rows = in_order(scored.select(F.col("id").cast("long").alias("id"), F.col("competition_id").cast("long").alias("competition_id"), "home_team_id", "away_team_id", "ft_home_goals", "ft_away_goals", "kickoff_date"), "competition_id")
    return rows.mapInArrow(fold, "id long, competition_id long, home_before double, away_before double, gap double, drawn boolean")


def draw_curve(gaps: DataFrame, least: int = 30) -> DataFrame:
    """By competition: draw share over the fifths of the gap's size (edges belong to both), and the line through their logarithms."""
    g = gaps.select("competition_id", F.abs("gap").alias("g"), F.col("drawn").cast("double").alias("y"))
    edges = g.groupBy("competition_id").agg(F.percentile("g", F.array(*[F.lit(x / 5) for x in range(6)])).alias("e"))
    spread = edges.select("competition_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(i.alias("fifth"), F.get("e", i).alias("lo"), F.get("e", i + 1).alias("hi")))).alias("b")).select("competition_id", "b.*")
    per = g.join(F.broadcast(spread), "competition_id").where("g >= lo and g <= hi").groupBy("competition_id", "fifth").agg(F.count("*").alias("n"), F.avg("g").alias("x"), F.avg("y").alias("p")).where(F.col("n") >= least)  # spread: five rows a competition
    line = per.withColumn("lp", F.ln(F.least(F.greatest("p", F.lit(1e-3)), F.lit(0.999)))).groupBy("competition_id").agg(F.count("*").alias("fifths"), F.exp(F.regr_intercept("lp", "x")).alias("base"), (-F.regr_slope("lp", "x")).alias("decay"))
    ok = (F.col("fifths") >= 3) & F.col("base").between(0.05, 0.6) & F.col("decay").between(0.0, 0.02)
    overall = g.groupBy("competition_id").agg(F.avg("y").alias("share"), F.count("*").alias("n"))
    return overall.join(line, "competition_id", "left").select("competition_id", "n", F.round(F.when(ok, F.col("base")).otherwise(F.col("share")), 6).alias("base"), F.round(F.when(ok, F.col("decay")).otherwise(0.0), 6).alias("decay"))


def elo_evidence(matches: DataFrame, fixtures: DataFrame, least: int = 60, each: int = 4) -> DataFrame:
    """(id, sufficient_data, note): whether a fixture's competition has least scored matches and both its teams each of them."""
    scored = matches.where(F.col("ft_home_goals").isNotNull() & F.col("ft_away_goals").isNotNull())
    teams = scored.select("competition_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).groupBy("competition_id", "team_id").agg(F.count("*").alias("n"))
    r = fixtures.select("id", "competition_id", "home_team_id", "away_team_id").join(scored.groupBy("competition_id").agg(F.count("*").alias("_all")), "competition_id", "left")
    for p in ("home", "away"):
        r = r.join(teams.select("competition_id", F.col("team_id").alias(f"{p}_team_id"), F.col("n").alias(f"_{p}")), ["competition_id", f"{p}_team_id"], "left")
    n, fewest = F.coalesce("_all", F.lit(0)), F.least(F.coalesce("_home", F.lit(0)), F.coalesce("_away", F.lit(0)))
    note = F.when(n < least, F.concat(n.cast("string"), F.lit(f" of {least} matches in the competition"))).when(fewest < each, F.concat(fewest.cast("string"), F.lit(f" of {each} matches of a team")))
    return r.select("id", note.isNull().alias("sufficient_data"), note.alias("note"))


def elo_predict(ratings: DataFrame, curve: DataFrame, scale: float = 400.0) -> DataFrame:
    """(id, home, draw, away) from gaps: the draw's probability by the curve, the rest split by expectancy."""
    r = ratings.join(F.broadcast(curve.select("competition_id", "base", "decay")), "competition_id")  # one row a competition
    draw = F.least(F.greatest(F.col("base") * F.exp(-F.col("decay") * F.abs("gap")), F.lit(0.05)), F.lit(0.4))
    win = 1 / (1 + F.pow(F.lit(10.0), -F.col("gap") / scale))
    return r.select("id", ((1 - draw) * win).alias("home"), draw.alias("draw"), ((1 - draw) * (1 - win)).alias("away"))


def minimise(value_and_slope, x: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200, memory: int = 8) -> np.ndarray:
    """Quasi-Newton descent within bounds: limited memory, steps cut back to the bounds and halved until they pay."""
    value, slope = value_and_slope(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        free = ~(((x <= low) & (slope > 0)) | ((x >= high) & (slope < 0)))
        d, used = -slope * free, []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            d, used = d - a * y, [*used, a]
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(used), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        d *= free
        if d @ slope >= 0:
            d, steps = -slope * free, []
        size = 1.0 if steps else min(1.0, 1.0 / max(1e-12, np.abs(d).max()))
        while True:
            nx = np.clip(x + size * d, low, high)
            nv, ns = value_and_slope(nx)
            if nv <= value + 1e-4 * (slope @ (nx - x)) or size < 1e-10:
                break
            size /= 2
        if nv >= value or value - nv < 1e-10 * max(1.0, abs(value)):
            return nx if nv < value else x
        if (nx - x) @ (ns - slope) > 1e-12:
            steps = [*steps, (nx - x, ns - slope)][-memory:]
        x, value, slope = nx, nv, ns
    return x


#: So many matches are evaluated at once: most of a fit's temporary arrays are of this length, however many matches a competition has.
AT_ONCE = 2**17


def goals_objective(h, a, yh, ya, real_h, real_a, w, teams: int, ridge: float, prior: np.ndarray):
    """Negative log likelihood and slope of attack and defence (each summing to zero), intercept, home bonus and low-score term."""
    t = teams
    low = (real_h == real_h.astype(bool)) & (real_a == real_a.astype(bool))  # both are 0 or 1
    score = np.where(low, 2 * real_h + real_a, 4).astype(np.int8)
    del low, real_h, real_a

    def unpack(x):
        return np.append(x[: t - 1], -x[: t - 1].sum()), np.append(x[t - 1 : 2 * t - 2], -x[t - 1 : 2 * t - 2].sum()), *x[2 * t - 2 :]

    def part(x, h, a, yh, ya, score, w):
        att, dfn, c, home, rho = x
        el, em = c + att[h] - dfn[a] + home, c + att[a] - dfn[h]
        lam, mu = np.exp(np.clip(el, -5, 3)), np.exp(np.clip(em, -5, 3))
        cells = [score == i for i in range(4)]
        raw = np.select(cells, [1 - lam * mu * rho, 1 + lam * rho, 1 + mu * rho, np.full(len(lam), 1 - rho)], 1.0)
        tau, sloping = np.maximum(raw, 1e-9), raw > 1e-9  # where tau is floored, nothing moves it
        dl, dm = np.select(cells[:3], [-mu * rho, np.full(len(lam), rho), np.zeros(len(lam))], 0.0) / tau, np.select(cells[:3], [-lam * rho, np.zeros(len(lam)), np.full(len(lam), rho)], 0.0) / tau
        dr = np.select(cells, [-lam * mu, lam, mu, np.full(len(lam), -1.0)], 0.0) / tau * sloping
        gl, gm = -w * (yh - lam + dl * lam * sloping) * (np.abs(el + 1) < 4), -w * (ya - mu + dm * mu * sloping) * (np.abs(em + 1) < 4)  # -5 to 3
        return w * (np.log(tau) + yh * np.log(lam) - lam + ya * np.log(mu) - mu), gl, gm, w * dr

    made = [np.empty(len(h)) for _ in range(4)]

    def value_and_slope(x):
        held = unpack(x)
        for i in range(0, len(h), AT_ONCE):
            here = slice(i, i + AT_ONCE)
            for column, found in zip(made, part(held, *(column[here] for column in (h, a, yh, ya, score, w))), strict=True):
                column[here] = found
        # summed as a whole, so that no sum depends on AT_ONCE
        (gain, gl, gm, wr), (att, dfn) = made, held[:2]
        value = -gain.sum() + 0.5 * ridge * (((att - prior) ** 2).sum() + ((dfn - prior) ** 2).sum())
        ga = np.bincount(h, gl, t) + np.bincount(a, gm, t) + ridge * (att - prior)
        gd = -np.bincount(a, gl, t) - np.bincount(h, gm, t) + ridge * (dfn - prior)
        return value, np.concatenate([ga[:-1] - ga[-1], gd[:-1] - gd[-1], [(gl + gm).sum(), gl.sum(), -wr.sum()]])

    return value_and_slope, unpack


def last_full_season(days: pd.Series, on) -> np.ndarray:
    """Which days are of the last season, from July to June, that was over on a day."""
    end = on.year if on.month >= 7 else on.year - 1
    year = np.array([d.year - (d.month < 7) for d in days])
    return year == end - 1


def blended_targets(rows: pd.DataFrame, on_target: float = 0.35, shots: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """scoring_targets of one competition's matches with home_sot, away_sot, home_shots, away_shots."""
    goals = {p: rows[f"ft_{p}_goals"].to_numpy(float) for p in ("home", "away")}
    out = {p: (1 - on_target - shots) * g for p, g in goals.items()}
    for name, share in (("sot", on_target), ("shots", shots)):
        made = {p: rows[f"{p}_{name}"].to_numpy(float) for p in ("home", "away")}
        both = ~np.isnan(made["home"]) & ~np.isnan(made["away"])
        total = (made["home"] + made["away"])[both].sum()
        for p in ("home", "away"):
            value = made[p] * ((goals["home"] + goals["away"])[both].sum() / total) if total > 0 else goals[p]
            out[p] = out[p] + share * np.where(both, value, goals[p])
    return out["home"], out["away"]


def fit_goals(rows: pd.DataFrame, age: np.ndarray, last_season: np.ndarray, days: float = 270.0, ridge: float = 1.0, absent: float = -0.3) -> dict:
    """The bivariate Poisson fit of one competition's matches: teams, attack, defence, intercept, home, rho. Targets are columns yh and ya, or blended_targets."""
    teams = sorted({*rows.home_team_id, *rows.away_team_id})
    at = {t: i for i, t in enumerate(teams)}
    h, a = rows.home_team_id.map(at).to_numpy(), rows.away_team_id.map(at).to_numpy()
    real_h, real_a = rows.ft_home_goals.to_numpy(float), rows.ft_away_goals.to_numpy(float)
    yh, ya = (rows.yh.to_numpy(float), rows.ya.to_numpy(float)) if "yh" in rows else blended_targets(rows)
    return {"teams": teams, **fit_strengths(len(teams), h, a, real_h, real_a, yh, ya, age, last_season, days, ridge, absent)}


def fit_strengths(teams: int, h, a, real_h, real_a, yh, ya, age, last_season, days: float, ridge: float, absent: float) -> dict:
    """fit_goals of matches as arrays, teams by their number: attack, defence, intercept, home, rho."""
    n, last = teams, np.zeros(teams, bool)
    last[h[last_season]] = last[a[last_season]] = True
    prior = np.where(last.any() & ~last, absent, 0.0)
    w = 0.5 ** (np.maximum(age, 0) / days)
    f, unpack = goals_objective(h, a, yh, ya, real_h, real_a, w, n, ridge, prior)
    low, high = np.r_[np.full(2 * n - 2, -3.0), -3.0, -1.0, -0.4], np.r_[np.full(2 * n - 2, 3.0), 3.0, 1.5, 0.4]
    start = np.r_[np.zeros(2 * n - 2), np.log(max(1e-3, (yh.mean() + ya.mean()) / 2)), 0.0, 0.0]
    attack, defence, c, home, rho = unpack(minimise(f, start, low, high))
    return {"attack": attack, "defence": defence, "intercept": float(c), "home": float(home), "rho": float(rho)}


def scoring_targets(matches: DataFrame, stats: DataFrame | None, on_target: float = 0.35, shots: float = 0.15) -> DataFrame:
    """Matches with yh, ya: goals blended with shots on target and shots at the competition's goals per shot.

    A statistic counts where both sides have it; otherwise, and in a competition without
    any such shot, the goals stand in for it. stats has one row a match and team.
    """
    if stats is None:
        return matches.select("*", F.col("ft_home_goals").cast("double").alias("yh"), F.col("ft_away_goals").cast("double").alias("ya"))
    rows = matches
    for p in ("home", "away"):
        rows = rows.join(stats.select(F.col("match_id").alias("id"), F.col("team_id").alias(f"{p}_team_id"), F.col("shots_on_target").alias(f"_{p}_sot"), F.col("shots").alias(f"_{p}_sh")), ["id", f"{p}_team_id"], "left")
    both = {s: F.col(f"_home_{s}").isNotNull() & F.col(f"_away_{s}").isNotNull() for s in ("sot", "sh")}
    goals = F.col("ft_home_goals") + F.col("ft_away_goals")
    rate = lambda s: (F.sum(F.when(both[s], goals)) / F.nullif(F.sum(F.when(both[s], F.col(f"_home_{s}") + F.col(f"_away_{s}"))), F.lit(0))).alias(f"_c_{s}")
    rows = rows.join(F.broadcast(rows.groupBy("competition_id").agg(rate("sot"), rate("sh"))), "competition_id")  # one row a competition
    part = lambda p, s: F.coalesce(F.when(both[s], F.col(f"_{p}_{s}") * F.col(f"_c_{s}")), F.col(f"ft_{p}_goals"))
    blend = lambda p: (1 - on_target - shots) * F.col(f"ft_{p}_goals") + on_target * part(p, "sot") + shots * part(p, "sh")
    return rows.select(*matches.columns, blend("home").alias("yh"), blend("away").alias("ya"))


def scoring_strengths(matches: DataFrame, as_of, stats: DataFrame | None = None, days: float = 270.0, ridge: float = 1.0, least: int = 60, absent: float = -0.3) -> DataFrame:
    """(competition_id, team_id, attack, defence, intercept, home, rho) by a bivariate Poisson fit; nothing below least matches.

    Strengths are drawn towards 0, or towards absent for teams without a match in the last
    full season (from July) before as_of, if their competition had any then.

    A competition's matches pass as a stream of batches; a task keeps 65 bytes of each (targets, weight, teams, what they add to the sums) and evaluates AT_ONCE of them at a time.
    """

    whole = {"home_team_id": None, "away_team_id": None, "ft_home_goals": np.int32, "ft_away_goals": np.int32, "yh": float, "ya": float, "age": np.int32, "last_season": bool}

    def found(competition, parts: dict[str, list]):
        size = sum(map(len, parts["yh"]))
        if size < least:
            return
        sides = (parts.pop("home_team_id"), parts.pop("away_team_id"))
        teams = np.unique(np.concatenate([np.unique(p) for side in sides for p in side]))
        h, a = (np.concatenate([np.searchsorted(teams, p).astype(np.int32) for p in side]) for side in sides)
        del sides
        got = fit_strengths(len(teams), h, a, *(np.concatenate(parts.pop(c)) for c in list(whole)[2:]), days, ridge, absent)
        same = lambda x, kind: pa.array([x], kind).take(pa.array(np.zeros(len(teams), np.int32)))
        yield pa.RecordBatch.from_arrays([same(competition, pa.int64()), pa.array(teams, from_pandas=True).cast(pa.int64()), pa.array(got["attack"]), pa.array(got["defence"]), *[same(got[k], pa.float64()) for k in ("intercept", "home", "rho")], same(size, pa.int64())],
                                         ["competition_id", "team_id", "attack", "defence", "intercept", "home", "rho", "matches"])

    def fit(batches):
        last, parts = None, None
        for b in batches:
            key = b.column("competition_id").to_pylist()
            edges = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if parts is None or key[i] != last:
                    if parts is not None:
                        yield from found(last, parts)
                    last, parts = key[i], {c: [] for c in whole}
                for c, kind in whole.items():
                    x = b.column(c).slice(i, j - i).to_numpy(zero_copy_only=False)
                    parts[c].append(x.copy() if kind is None else x.astype(kind))
        if parts is not None:
            yield from found(last, parts)

    on = F.to_date(F.lit(as_of).cast("timestamp"))
    start = F.add_months(F.make_date(F.year(on), F.lit(7), F.lit(1)), F.when(F.month(on) < 7, -12).otherwise(0))
    known = scoring_targets(matches.where(F.col("ft_home_goals").isNotNull() & F.col("ft_away_goals").isNotNull()), stats)
    last = (F.col("kickoff_date") < start) & (F.col("kickoff_date") >= F.add_months(start, -12))
    rows = known.select("id", F.col("competition_id").cast("long").alias("competition_id"), "home_team_id", "away_team_id", "ft_home_goals", "ft_away_goals", "yh", "ya", last.alias("last_season"), F.datediff(on, "kickoff_date").alias("age"))
    rows = rows.repartition("competition_id").sortWithinPartitions("competition_id", "id").drop("id")
    return rows.mapInArrow(fit, "competition_id long, team_id long, attack double, defence double, intercept double, home double, rho double, matches long")


def expected_goals(fixtures: DataFrame, strengths: DataFrame, unrated: float = -0.3) -> DataFrame:
    """(id, lam, mu, rho) of fixtures; a team without a rating has attack and defence unrated; rates stay within 0.05 and 8."""
    common = strengths.groupBy("competition_id").agg(F.first("intercept").alias("c"), F.first("home").alias("bonus"), F.first("rho").alias("rho"))
    r = fixtures.join(F.broadcast(common), "competition_id")  # one row a competition
    for p in ("home", "away"):
        r = r.join(strengths.select("competition_id", F.col("team_id").alias(f"{p}_team_id"), F.col("attack").alias(f"{p}_att"), F.col("defence").alias(f"{p}_def")), ["competition_id", f"{p}_team_id"], "left")
    v = lambda c: F.coalesce(c, F.lit(unrated))
    rate = lambda x: F.least(F.greatest(F.exp(x), F.lit(0.05)), F.lit(8.0))
    return r.select("id", rate(F.col("c") + v("home_att") - v("away_def") + F.col("bonus")).alias("lam"), rate(F.col("c") + v("away_att") - v("home_def")).alias("mu"), "rho")


def outcome_regression(rows: DataFrame, features: list[str], weight: str | None = None, c: float = 0.35) -> DataFrame:
    """(id, home, draw, away) by a multinomial logistic model on standardised features, fitted on rows with a label (0, 1, 2)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = rows.where(F.col("label").isNotNull())
    stats = known.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features], F.sum(F.col(weight) if weight else F.lit(1.0)).alias("w")).first()
    scaled = rows.select("*", *[((F.col(f) - (stats[f"m_{f}"] or 0.0)) / (stats[f"s_{f}"] or 1.0)).alias(f"_z_{f}") for f in features])
    table = VectorAssembler(inputCols=[f"_z_{f}" for f in features], outputCol="x").transform(scaled)
    fit = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", elasticNetParam=0.0, standardization=False, regParam=1.0 / (c * max(stats["w"] or 1.0, 1.0)), maxIter=100, **({"weightCol": weight} if weight else {}))
    p = vector_to_array("probability")
    return fit.fit(table.where(F.col("label").isNotNull())).transform(table).select("id", p[0].alias("home"), p[1].alias("draw"), p[2].alias("away"))


def ensemble_weights(predictions: DataFrame, models: list[str], rounds: int = 500, spread: float = 0.01, least: int = 30) -> DataFrame:
    """(competition_id, model, weight): weights on the simplex that minimise the mean log loss plus spread x their squares.

    Rows (competition_id, p, outcome's probability by each model) are summed inside the
    group's fit; below least rows all weights are equal.
    """
    wide = predictions.groupBy("competition_id", "id").pivot("model", models).agg(F.first("p")).dropna(subset=models)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        p, w = np.clip(rows[models].to_numpy(float), 1e-15, 1), np.full(len(models), 1 / len(models))
        if len(rows) >= least:
            z = np.zeros(len(models))
            for _ in range(rounds):
                w = np.exp(z - z.max())
                w /= w.sum()
                g = -(p / (p @ w)[:, None]).mean(0) + 2 * spread * w
                z -= 0.5 * w * (g - w @ g)
        return pd.DataFrame({"competition_id": rows.competition_id.iloc[0], "model": models, "weight": np.round(w, 4), "n": len(rows)})

    return wide.groupBy("competition_id").applyInPandas(fit, "competition_id long, model string, weight double, n long")


def forward_validation(predictions: DataFrame, models: list[str], share: float = 0.6, least: int = 60) -> DataFrame:
    """(competition_id, n_fitted, n_scored, weighted, equal, best_single, best_loss, beat_equal, beat_best_single, losses): mean log loss of later matches by
    weights that earlier ones gave, by equal weights, and of each model alone (losses, a map).

    Rows (competition_id, id, kickoff_date, model, p) up to each competition's share quantile of days fit, later ones score; competitions with
    fewer than least matches on either side go. Models are compared on matches that all predict.
    """
    day = F.unix_date("kickoff_date")
    cuts = predictions.groupBy("competition_id").agg(F.percentile(day, share).alias("_cut"))
    rows = predictions.join(cuts, "competition_id").withColumn("_early", day <= F.col("_cut"))
    weights = ensemble_weights(rows.where("_early"), models).withColumnRenamed("n", "n_fitted")
    alone = [F.max(F.when(F.col("model") == m, F.col("p"))).alias(f"p_{i}") for i, m in enumerate(models)]
    mixed = rows.where("not _early").join(weights, ["competition_id", "model"]).groupBy("competition_id", "n_fitted", "id").agg(F.sum(F.col("weight") * F.col("p")).alias("w"), F.avg("p").alias("e"), F.count("*").alias("k"), *alone).where(F.col("k") == len(models))
    loss = lambda c: F.round(F.avg(-F.ln(F.greatest(c, F.lit(1e-15)))), 6)
    scored = mixed.groupBy("competition_id", "n_fitted").agg(F.count("*").alias("n_scored"), loss(F.col("w")).alias("weighted"), loss(F.col("e")).alias("equal"), *[loss(F.col(f"p_{i}")).alias(f"l_{i}") for i in range(len(models))])
    singles = F.array(*[F.struct(F.col(f"l_{i}").alias("loss"), F.lit(m).alias("model")) for i, m in enumerate(models)])
    scored = scored.where((F.col("n_fitted") >= least) & (F.col("n_scored") >= least)).withColumn("b", F.array_min(singles))
    return scored.select("competition_id", "n_fitted", "n_scored", "weighted", "equal", F.col("b.model").alias("best_single"), F.col("b.loss").alias("best_loss"), (F.col("weighted") < F.col("equal")).alias("beat_equal"), (F.col("weighted") < F.col("b.loss")).alias("beat_best_single"),
                         F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.col(f"l_{i}"))]).alias("losses"))


def strengths_by_sums(rows: DataFrame, days: float = 270.0, ridge: float = 1.0, absent: float = -0.3, broadcast_teams: int = 100_000) -> DataFrame:
    """(team_id, attack, defence, intercept, home, rho) of one competition by sums over Spark: for one whose matches don't fit a task.

    rows (home_team_id, away_team_id, ft_home_goals, ft_away_goals, yh, ya, age, last_season). Matches are first summed by pair of teams and low
    score, all that the likelihood needs; each evaluation of it is then one aggregation by team over that table. The driver
    holds a few numbers a team and takes the steps. Teams' numbers are broadcast up to broadcast_teams of them, joined beyond.
    """
    from touchline.session import written

    spark = rows.sparkSession
    h, a = F.col("ft_home_goals"), F.col("ft_away_goals")
    cell = F.when((h < 2) & (a < 2), 2 * h + a).otherwise(-1)
    w = F.pow(F.lit(0.5), F.greatest(F.col("age"), F.lit(0)) / days)
    pairs = written(rows.groupBy("home_team_id", "away_team_id", cell.alias("cell")).agg(F.sum(w).alias("w"), F.sum(w * F.col("yh")).alias("wh"), F.sum(w * F.col("ya")).alias("wa")), "pairs")
    seen = rows.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), "last_season").groupBy("team_id").agg(F.max(F.col("last_season").cast("int")).alias("last")).collect()
    seen = sorted((r["team_id"], bool(r["last"])) for r in seen)
    teams, n = [t for t, _ in seen], len(seen)
    prior = np.array([absent if any(x for _, x in seen) and not last else 0.0 for _, last in seen])
    at = {t: i for i, t in enumerate(teams)}
    low, high = np.r_[np.full(2 * n - 2, -3.0), -3.0, -1.0, -0.4], np.r_[np.full(2 * n - 2, 3.0), 3.0, 1.5, 0.4]
    mean = rows.agg((F.avg("yh") + F.avg("ya")).alias("m")).first()["m"] / 2

    def unpack(x):
        return np.append(x[: n - 1], -x[: n - 1].sum()), np.append(x[n - 1 : 2 * n - 2], -x[n - 1 : 2 * n - 2].sum()), *x[2 * n - 2 :]

    def value_and_slope(x):
        att, dfn, c, home, rho = unpack(x)
        known = spark.createDataFrame(pd.DataFrame({"t": teams, "att": att, "dfn": dfn}), "t long, att double, dfn double")
        side = lambda p: (F.broadcast if n <= broadcast_teams else lambda d: d)(known.select(F.col("t").alias(f"{p}_team_id"), F.col("att").alias(f"{p}_att"), F.col("dfn").alias(f"{p}_dfn")))
        r = pairs.join(side("home"), "home_team_id").join(side("away"), "away_team_id")
        el, em = c + F.col("home_att") - F.col("away_dfn") + home, c + F.col("away_att") - F.col("home_dfn")
        bound = lambda e: F.least(F.greatest(e, F.lit(-5.0)), F.lit(3.0))
        r = r.withColumns({"el": el, "em": em}).withColumns({"lam": F.exp(bound(F.col("el"))), "mu": F.exp(bound(F.col("em")))})
        lam, mu, k = F.col("lam"), F.col("mu"), F.col("cell")
        pick = lambda c00, c01, c10, c11, other: F.when(k == 0, c00).when(k == 1, c01).when(k == 2, c10).when(k == 3, c11).otherwise(F.lit(other))
        raw = pick(1 - lam * mu * rho, 1 + lam * rho, 1 + mu * rho, F.lit(1 - rho), 1.0)
        r = r.withColumn("raw", raw).withColumn("tau", F.greatest("raw", F.lit(1e-9)))
        sloping = F.when(F.col("raw") > 1e-9, 1.0).otherwise(0.0) / F.col("tau")
        dl, dm = pick(-mu * rho, F.lit(rho), F.lit(0.0), F.lit(0.0), 0.0) * sloping, pick(-lam * rho, F.lit(0.0), F.lit(rho), F.lit(0.0), 0.0) * sloping
        dr = pick(-lam * mu, lam, mu, F.lit(-1.0), 0.0) * sloping
        inside = lambda e: F.when((F.col(e) > -5) & (F.col(e) < 3), 1.0).otherwise(0.0)
        w = F.col("w")
        gl, gm = -(F.col("wh") - w * lam + w * dl * lam) * inside("el"), -(F.col("wa") - w * mu + w * dm * mu) * inside("em")
        loss = -(w * F.ln("tau") + F.col("wh") * F.ln(lam) - w * lam + F.col("wa") * F.ln(mu) - w * mu)
        part = lambda team, *values: F.struct(team.alias("t"), *[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])
        zero, none = F.lit(0.0), F.lit(None).cast("long")
        r = r.withColumns({"gl": gl, "gm": gm}).select(F.inline(F.array(
            part(F.col("home_team_id"), F.col("gl"), -F.col("gm"), zero, zero), part(F.col("away_team_id"), F.col("gm"), -F.col("gl"), zero, zero), part(none, F.col("gl") + F.col("gm"), F.col("gl"), -(w * dr), loss))))
        sums = r.groupBy("t").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(4)]).collect()  # a row a team
        ga, gd = ridge * (att - prior), ridge * (dfn - prior)
        value, rest = 0.5 * ridge * (((att - prior) ** 2).sum() + ((dfn - prior) ** 2).sum()), [0.0, 0.0, 0.0]
        for s in sums:
            if s["t"] is None:
                value, rest = value + s["v3"], [s["v0"], s["v1"], s["v2"]]
            else:
                ga[at[s["t"]]] += s["v0"]
                gd[at[s["t"]]] += s["v1"]
        return value, np.concatenate([ga[:-1] - ga[-1], gd[:-1] - gd[-1], rest])

    att, dfn, c, home, rho = unpack(minimise(value_and_slope, np.r_[np.zeros(2 * n - 2), np.log(max(1e-3, mean)), 0.0, 0.0], low, high))
    return spark.createDataFrame(pd.DataFrame({"team_id": teams, "attack": att, "defence": dfn, "intercept": float(c), "home": float(home), "rho": float(rho)}))
