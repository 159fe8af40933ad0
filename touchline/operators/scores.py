"""Score matrices and the markets that follow from them; counts of corners and cards; players."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import half_life, poisson, poisson_upto
from touchline.session import spread, written

MOST = 10


def _cells(most: int = MOST) -> list[tuple[int, int]]:
    return [(h, a) for h in range(most + 1) for a in range(most + 1)]


def _total(terms: list) -> Column:
    out = F.lit(0.0)
    for x in terms:
        out = out + x
    return out


def score_columns(rates: DataFrame, most: int = MOST) -> DataFrame:
    """rows (id, lam, mu, rho) with columns p_<h>_<a>: probabilities of all scores by two Poissons with the four low ones corrected, normalised.

    Columns, not an array: what follows from a row's scores is compiled and needs neither shuffles nor a function call a cell.
    """
    lam, mu, rho = (F.col(c) for c in ("lam", "mu", "rho"))
    tau = {(0, 0): 1 - lam * mu * rho, (0, 1): 1 + lam * rho, (1, 0): 1 + mu * rho, (1, 1): 1 - rho}
    r = rates.select("*", *[poisson(F.lit(k), rate).alias(f"_{n}{k}") for n, rate in (("h", lam), ("a", mu)) for k in range(most + 1)])
    weight = lambda h, a: F.greatest(F.col(f"_h{h}") * F.col(f"_a{a}") * tau.get((h, a), F.lit(1.0)), F.lit(0.0))
    r = r.select(*rates.columns, *[weight(h, a).alias(f"p_{h}_{a}") for h, a in _cells(most)])
    r = r.select("*", _total([F.col(f"p_{h}_{a}") for h, a in _cells(most)]).alias("_t"))
    return r.select(*rates.columns, *[F.try_divide(f"p_{h}_{a}", "_t").alias(f"p_{h}_{a}") for h, a in _cells(most)])


def cells(most: int = MOST) -> Column:
    """The columns of score_columns as one array of (h, a, p)."""
    return F.array(*[F.struct(F.lit(h).alias("h"), F.lit(a).alias("a"), F.col(f"p_{h}_{a}").alias("p")) for h, a in _cells(most)])


def score_cells(rates: DataFrame, most: int = MOST) -> DataFrame:
    """rows (id, lam, mu, rho) with cells: all (h, a, p), see score_columns, as one array a row."""
    return score_columns(rates, most).select(*rates.columns, cells(most).alias("cells"))


def score_rows(columns: DataFrame, most: int = MOST) -> DataFrame:
    """(id, h, a, p) from rows with score_columns."""
    return columns.select("id", F.inline(cells(most)))


def score_matrix(rates: DataFrame, most: int = MOST) -> DataFrame:
    """(id, h, a, p) from rows (id, lam, mu, rho): 121 rows a match, made and summed where the match's row stands; no shuffle."""
    return score_rows(score_columns(rates, most), most)


def _mass(condition):
    return F.sum(F.when(condition, F.col("p")).otherwise(0.0))


def _outcome_columns(r: DataFrame) -> DataFrame:
    six = lambda c: F.round(c, 6)
    return r.select("id", six(F.col("home")).alias("home"), six(F.col("draw")).alias("draw"), six(F.col("away")).alias("away"), six(1 - F.col("away")).alias("home_or_draw"), six(1 - F.col("home")).alias("draw_or_away"), six(1 - F.col("draw")).alias("home_or_away"))


def outcomes(matrix: DataFrame) -> DataFrame:
    h, a = F.col("h"), F.col("a")
    return _outcome_columns(matrix.groupBy("id").agg(_mass(h > a).alias("home"), _mass(h == a).alias("draw"), _mass(h < a).alias("away")))


def _mass_of(condition, most: int = MOST) -> Column:
    """The mass of the scores (h, a) that fulfil a condition, from a row's score_columns."""
    return F.coalesce(_total([F.col(f"p_{h}_{a}") for h, a in _cells(most) if condition(h, a)]), F.lit(0.0))


def outcomes_of(columns: DataFrame) -> DataFrame:
    """outcomes() from score_columns: added up where the row is, so an id sends one row."""
    each = columns.select("id", _mass_of(lambda h, a: h > a).alias("home"), _mass_of(lambda h, a: h == a).alias("draw"), _mass_of(lambda h, a: h < a).alias("away"))
    return _outcome_columns(each.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("home", "draw", "away")]))


def _market_parts(mean, mass, lines, team_lines) -> tuple[dict, dict]:
    """Markets as sums over scores, and those that are one less another's: ((market, selection) -> sum), (... -> the other)."""
    made = {("expected_goals", "total"): mean(lambda h, a: h + a), ("expected_goals", "home"): mean(lambda h, a: h), ("expected_goals", "away"): mean(lambda h, a: a)}
    rest = {}
    for line in lines:
        made[f"over_under_{line}", "over"] = mass(lambda h, a, line=line: h + a > line)
        rest[f"over_under_{line}", "under"] = (f"over_under_{line}", "over")
    made |= {("btts", "yes"): mass(lambda h, a: (h > 0) & (a > 0)), ("clean_sheet", "home"): mass(lambda h, a: a == 0), ("clean_sheet", "away"): mass(lambda h, a: h == 0)}
    rest["btts", "no"] = ("btts", "yes")
    for line in team_lines:
        made |= {(f"home_goals_{line}", "over"): mass(lambda h, a, line=line: h > line), (f"away_goals_{line}", "over"): mass(lambda h, a, line=line: a > line)}
    for m in (1, 2, 3):
        made |= {("winning_margin", f"home_by_{m}"): mass(lambda h, a, m=m: h - a == m), ("winning_margin", f"away_by_{m}"): mass(lambda h, a, m=m: a - h == m)}
    return made, rest


def _market_rows(each: DataFrame, made: dict, rest: dict) -> DataFrame:
    """(id, market, selection, value) from rows (id, s0, s1, ...) that hold parts of the sums."""
    at = {k: i for i, k in enumerate(made)}
    wide = each.groupBy("id").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in at.values()])
    value = {k: F.col(f"s{i}") for k, i in at.items()} | {k: 1 - F.col(f"s{at[other]}") for k, other in rest.items()}
    return wide.select("id", F.inline(F.array(*[F.struct(F.lit(m).alias("market"), F.lit(s).alias("selection"), F.round(v, 6).alias("value")) for (m, s), v in value.items()])))


LINES, TEAM_LINES = (0.5, 1.5, 2.5, 3.5, 4.5), (0.5, 1.5, 2.5)


def goal_markets(matrix: DataFrame, lines=LINES, team_lines=TEAM_LINES) -> DataFrame:
    """(id, market, selection, value): expectations and probabilities by one aggregation."""
    h, a, p = F.col("h"), F.col("a"), F.col("p")
    made, rest = _market_parts(lambda f: f(h, a) * p, lambda f: F.when(f(h, a), p).otherwise(0.0), lines, team_lines)
    return _market_rows(matrix.select("id", *[v.alias(f"s{i}") for i, v in enumerate(made.values())]), made, rest)


def goal_markets_of(columns: DataFrame, lines=LINES, team_lines=TEAM_LINES, most: int = MOST) -> DataFrame:
    """goal_markets() from score_columns: added up where the row is, so an id sends one row."""
    mean = lambda f: _total([F.col(f"p_{h}_{a}") * float(f(h, a)) for h, a in _cells(most)])
    made, rest = _market_parts(mean, lambda f: _mass_of(f, most), lines, team_lines)
    return _market_rows(columns.select("id", *[v.alias(f"s{i}") for i, v in enumerate(made.values())]), made, rest)


def top_scores(matrix: DataFrame, n: int = 6) -> DataFrame:
    """The n likeliest scores and the likeliest of each outcome; equal probabilities by more home, then more away goals."""
    out = F.when(F.col("h") > F.col("a"), "home").when(F.col("h") == F.col("a"), "draw").otherwise("away")
    order = (F.desc(F.round("p", 9)), F.desc("h"), F.desc("a"))
    ranked = matrix.withColumn("outcome", out).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).withColumn("in_outcome", F.row_number().over(Window.partitionBy("id", "outcome").orderBy(*order)))
    return ranked.where((F.col("rank") <= n) | (F.col("in_outcome") == 1)).select("id", F.concat_ws("-", F.col("h").cast("string"), F.col("a").cast("string")).alias("score"), "outcome", "rank", "in_outcome", F.round("p", 6).alias("p"))


def top_scores_of(columns: DataFrame, n: int = 6, most: int = MOST) -> DataFrame:
    """top_scores() from score_columns, one row an id: sorted where the row is, without a shuffle."""
    name = {1: "home", 0: "draw", -1: "away"}
    sign = lambda h, a: (h > a) - (h < a)
    cell = lambda h, a: F.struct((-F.round(f"p_{h}_{a}", 9)).alias("less"), F.lit(-h).alias("h"), F.lit(-a).alias("a"), F.lit(name[sign(h, a)]).alias("outcome"), F.col(f"p_{h}_{a}").alias("p"))
    r = columns.select("id", F.sort_array(F.array(*[cell(h, a) for h, a in _cells(most)])).alias("all"), *[F.array_min(F.array(*[cell(h, a) for h, a in _cells(most) if sign(h, a) == s])).alias(f"best_{o}") for s, o in name.items()])
    row = lambda c, rank, within: F.struct(c.alias("c"), rank.cast("int").alias("rank"), within.cast("int").alias("in_outcome"))
    r = r.withColumn("top", F.slice("all", 1, n))
    top = F.transform("top", lambda c, i: row(c, i + 1, F.size(F.filter(F.slice("top", 1, i + 1), lambda x: x.outcome == c.outcome))))
    rest = F.filter(F.array(*[row(F.col(f"best_{o}"), F.array_position("all", F.col(f"best_{o}")), F.lit(1)) for o in name.values()]), lambda x: x.rank > n)
    return r.select("id", F.inline(F.concat(top, rest))).select("id", F.concat_ws("-", (-F.col("c.h")).cast("string"), (-F.col("c.a")).cast("string")).alias("score"), "c.outcome", "rank", "in_outcome", F.round("c.p", 6).alias("p"))


def rescale(matrix: DataFrame, targets: DataFrame) -> DataFrame:
    """The matrix with each outcome's mass moved to targets (id, home, draw, away), normalised."""
    h, a = F.col("h"), F.col("a")
    now = matrix.groupBy("id").agg(_mass(h > a).alias("nh"), _mass(h == a).alias("nd"), _mass(h < a).alias("na"))
    f = targets.join(now, "id").select("id", (F.col("home") / F.nullif("nh", F.lit(0.0))).alias("fh"), (F.col("draw") / F.nullif("nd", F.lit(0.0))).alias("fd"), (F.col("away") / F.nullif("na", F.lit(0.0))).alias("fa"))
    w = F.col("p") * F.coalesce(F.when(h > a, F.col("fh")).when(h == a, F.col("fd")).otherwise(F.col("fa")), F.lit(0.0))
    raw = matrix.join(f, "id").select("id", "h", "a", w.alias("w"))
    return raw.join(raw.groupBy("id").agg(F.sum("w").alias("t")), "id").select("id", "h", "a", (F.col("w") / F.col("t")).alias("p"))


def rescale_columns(columns: DataFrame, most: int = MOST) -> DataFrame:
    """score_columns (id, p_<h>_<a>) of rows with home, draw and away, each outcome's mass moved to these, normalised; no shuffle."""
    part = {1: "home", 0: "draw", -1: "away"}
    sign = lambda h, a: (h > a) - (h < a)
    r = columns.select("*", *[F.coalesce(F.col(o) / F.nullif(_mass_of(lambda h, a, s=s: sign(h, a) == s, most), F.lit(0.0)), F.lit(0.0)).alias(f"_f_{o}") for s, o in part.items()])
    r = r.select("id", *[(F.col(f"p_{h}_{a}") * F.col(f"_f_{part[sign(h, a)]}")).alias(f"p_{h}_{a}") for h, a in _cells(most)])
    r = r.select("*", _total([F.col(f"p_{h}_{a}") for h, a in _cells(most)]).alias("_t"))
    return r.select("id", *[(F.col(f"p_{h}_{a}") / F.col("_t")).alias(f"p_{h}_{a}") for h, a in _cells(most)])


def first_half(expected: DataFrame) -> DataFrame:
    """From rows (id, home, away, home_share, away_share): first-half goals, or nothing known if a share is missing."""
    t = F.round(F.col("home") * F.col("home_share") + F.col("away") * F.col("away_share"), 9)
    safe = F.greatest(t, F.lit(1e-6))
    return expected.select("id", F.round(t, 6).alias("expected"), F.round(1 - poisson_upto(0, safe), 6).alias("over_0_5"), F.round(1 - poisson_upto(1, safe), 6).alias("over_1_5"), t.isNotNull().alias("sufficient_data"))


def count_rates(rows: DataFrame, value: str, as_of, days: float = 365.0, shrinkage: float = 6.0) -> DataFrame:
    """(team_id, for_home, for_away, against_home, against_away, n): decayed means over the league's, shrunk towards 1."""
    return _rates_and_means(rows, value, as_of, days, shrinkage).drop("mh", "ma")


def _rates_and_means(rows: DataFrame, value: str, as_of, days: float, shrinkage: float) -> DataFrame:
    """count_rates() with the league's means at home and away, mh and ma, the same in every row."""
    r = rows.where(F.col(value).isNotNull()).withColumn("w", half_life(F.datediff(F.to_date(F.lit(as_of).cast("timestamp")), "kickoff_date"), days))
    league = r.agg(F.avg(F.when(F.col("is_home"), F.col(value))).alias("mh"), F.avg(F.when(~F.col("is_home"), F.col(value))).alias("ma"))  # one row
    both = r.select(F.explode(F.array(F.struct(F.col("team_id").alias("t"), F.lit(True).alias("own")), F.struct(F.col("opponent_id").alias("t"), F.lit(False).alias("own")))).alias("x"), "is_home", value, "w").select("x.*", "is_home", F.col(value).alias("v"), "w")

    def shrunk(own: bool, home: bool, mean: str):
        here = (F.col("own") == own) & (F.col("is_home") == home)
        w = F.sum(F.when(here, F.col("w")))
        return (F.sum(F.when(here, F.col("v") * F.col("w"))), w, mean)

    parts = {"for_home": shrunk(True, True, "mh"), "for_away": shrunk(True, False, "ma"), "against_away": shrunk(False, True, "mh"), "against_home": shrunk(False, False, "ma")}
    sums = both.groupBy("t").agg(*[c.alias(f"{k}_{i}") for k, (s, w, _) in parts.items() for i, c in (("s", s), ("w", w))], F.count(F.when(F.col("own"), 1)).alias("n"))
    ratio = lambda k, m: F.round((F.col(f"{k}_s") + shrinkage * F.col(m)) / (F.col(f"{k}_w") + shrinkage) / F.col(m), 6).alias(k)
    return sums.join(F.broadcast(league)).select(F.col("t").alias("team_id"), *[ratio(k, m) for k, (_, _, m) in parts.items()], "n", "mh", "ma")  # league: one row by construction


def dispersion(rows: DataFrame, value: str, least: int = 50) -> DataFrame:
    """Variance over mean of matches' totals by competition, where both sides are known; null below least matches."""
    totals = rows.where(F.col(value).isNotNull()).groupBy("competition_id", "id").agg(F.sum(value).alias("t"), F.count("*").alias("k")).where("k = 2")
    return totals.groupBy("competition_id").agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= least, F.var_samp("t") / F.avg("t")), 6).alias("dispersion")).withColumn("wide", F.coalesce(F.col("dispersion") > 1.1, F.lit(False)))


def referee_multipliers(rows: DataFrame, value: str, least: int = 20) -> DataFrame:
    r = rows.where(F.col(value).isNotNull()).select(F.trim("referee").alias("referee"), value).where("referee <> ''")
    per = r.groupBy("referee").agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("s"))
    overall = per.agg((F.sum("s") / F.sum("n")).alias("o"))  # one row, from the sums that are there: the rows are read once
    return per.join(F.broadcast(overall)).where((F.col("n") >= least) & (F.col("o") > 0)).select("referee", "n", F.round(F.least(F.greatest(F.col("s") / F.col("n") / F.col("o"), F.lit(0.7)), F.lit(1.4)), 6).alias("multiplier"))


#: So many columns are made of the one before them; the next ones start from the last, so that no expression grows with the number of columns.
LINKS = 5


def _chain(rows: DataFrame, name: str, first: Column, step, most: int) -> DataFrame:
    """rows with columns <name>0 to <name><most>, each by step(the one before it, its number)."""
    r = rows.select("*", first.alias(f"{name}0"))
    for k in range(1, most + 1, LINKS):
        last, made = F.col(f"{name}{k - 1}"), []
        for i in range(k, min(k + LINKS, most + 1)):
            last = step(last, i)
            made.append(last.alias(f"{name}{i}"))
        r = r.select("*", *made)
    return r


def count_columns(rows: DataFrame, mean: Column, dispersion: Column, most: int) -> DataFrame:
    """rows with columns _w0 to _w<most>, in proportion to the distribution that counts() makes, _c0 to _c<most>, their sums so far, and _all, their sum.

    Columns, not arrays, as in score_columns: what follows from a row's distribution is compiled. Each weight is the one before it x
    (_a + _b (k - 1)) / k: by Poisson _a is the mean and _b none, by the negative binomial _b = 1 - 1 / dispersion and _a = _b mean / (dispersion - 1).
    None is null and none is divided before the end: a method of more than 8,000 bytes isn't compiled by the JVM.
    """
    r = rows.select("*", F.coalesce(mean, F.lit(float("nan"))).alias("_m"), F.coalesce(F.when(dispersion > 1.1, dispersion), F.lit(0.0)).alias("_d"))
    wide, m, d, none = F.col("_d") > 1.1, F.col("_m"), F.col("_d"), F.lit(0.0)
    r = r.select("*", F.coalesce(F.when(wide, m / (d - 1)), none).alias("_n"), F.coalesce(F.when(wide, 1 - 1 / d), none).alias("_b"))
    r = r.select(*rows.columns, "_b", F.when(wide, F.col("_b") * F.col("_n")).otherwise(m).alias("_a"), F.coalesce(F.exp(F.when(wide, F.col("_n") * F.ln(1 / d)).otherwise(-m)), none).alias("_first"))
    r = _chain(r, "_w", F.col("_first"), lambda last, k: last * ((F.col("_a") + F.col("_b") * float(k - 1)) * (1 / k)), most)
    return _chain(r, "_c", F.lit(0.0) + F.col("_w0"), lambda last, k: last + F.col(f"_w{k}"), most).withColumn("_all", F.col(f"_c{most}"))


def _reach(q: float, most: int) -> Column:
    """The smallest count of count_columns up to which the probability, rounded to nine places, is q or more; null where all weights are too small to tell."""
    least = float(Decimal(str(q)) - Decimal("5e-10")) * F.col("_all")  # what rounds to q at least
    found = F.when(F.col("_all") <= 0, None)
    for k in range(most):
        found = found.when(F.col(f"_c{k}") >= least, k)
    return found.otherwise(most)


def beyond(line: float, most: int) -> Column:
    """The probability in count_columns of more than line."""
    return F.try_divide(_total([F.col(f"_w{k}") for k in range(most + 1) if k > line]), F.col("_all"))


def count_markets(means: DataFrame, lines, most: int = 30) -> DataFrame:
    """From rows (id, mean, dispersion), one an id: 80 % interval and over/under by line, over a distribution of 0 to most. All of it is made in the row."""
    d = count_columns(means.select("id", "mean", "dispersion"), F.greatest("mean", F.lit(0.05)), F.col("dispersion"), most)
    expected = F.try_divide(_total([F.col(f"_w{k}") * float(k) for k in range(most + 1)]), F.col("_all"))
    found = [F.round(expected, 6).alias("expected"), _reach(0.10, most).alias("interval_low"), _reach(0.90, most).alias("interval_high"), *[F.round(beyond(line, most), 6).alias(f"over_{str(line).replace('.', '_')}") for line in lines]]
    # a filter on what was found isn't carried below inline, where each use of a column would be written out in full
    return d.select("id", F.inline(F.array(F.struct(*found))))


def shot_conversion(rows: DataFrame) -> DataFrame:
    """Goals a shot and a shot on target, over matches where both sides' are known."""
    known = lambda own, other: F.col(own).isNotNull() & F.col(other).isNotNull() & F.col("goals_for").isNotNull()
    ratio = lambda own, other: F.round(F.sum(F.when(known(own, other), F.col("goals_for"))) / F.nullif(F.sum(F.when(known(own, other), F.col(own))), F.lit(0)), 6)
    return rows.groupBy("competition_id").agg(ratio("shots_on_target", "sot_against").alias("per_shot_on_target"), ratio("shots", "shots_against").alias("per_shot"))


def player_projection(rows: DataFrame, availability: DataFrame, as_of, blend: float = 0.6, least_minutes: int = 270, recent: int = 8, tie: tuple[str, ...] = ()) -> DataFrame:
    """Scoring chances of every player from matches before the cutoff's day: per-90 rates, minutes, availability. tie: columns that order rows of one day."""
    r = rows.where(F.col("match_date") < F.to_date(F.lit(as_of).cast("timestamp"))).withColumn("rn", F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("match_date"), *[F.desc(t) for t in tie], F.desc("team_id"), F.desc("minutes"))))
    near = F.col("rn") <= recent
    t = r.groupBy("player_id").agg(
        F.sum("minutes").alias("minutes"), F.count(F.when(F.col("minutes") > 0, 1)).alias("appearances"), F.sum("goals").alias("goals"), F.sum("assists").alias("assists"), F.sum("xg").alias("xg"), F.sum("xa").alias("xa"),
        F.avg(F.when(near, F.coalesce("minutes", F.lit(0)))).alias("em"), F.avg(F.when(near & F.col("started").isNotNull(), F.col("started").cast("double"))).alias("sp"))
    t = t.join(availability.select("player_id", "status", "chance_of_playing"), "player_id", "left")
    doubt = F.when((F.col("status") == "doubtful") & F.col("chance_of_playing").isNotNull(), F.col("chance_of_playing")).otherwise(1.0)
    out = F.coalesce(F.col("status").isin("injured", "suspended", "unavailable"), F.lit(False))
    # halves are rounded as the number of units itself says, not as its shortest decimal does: 1.0005 thousandths are 1000.4999...
    nearest = lambda x, d: F.round(x * 10.0**d) / 10.0**d
    rate = lambda n, x: F.coalesce(blend * F.col(x) + (1 - blend) * F.col(n), F.col(n)) * 90.0 / F.col("minutes") * F.col("em") * doubt / 90.0
    t = t.where("minutes > 0 or minutes is null").withColumn("eg", F.when(out, 0.0).otherwise(nearest(rate("goals", "xg"), 9))).withColumn("ea", F.when(out, 0.0).otherwise(nearest(rate("assists", "xa"), 9)))
    at_least = lambda x: 1 - F.exp(-F.greatest(x, F.lit(1e-6)))
    eg, ea = F.col("eg"), F.col("ea")
    enough = out | (F.col("minutes") >= least_minutes)
    shown = lambda c, d: F.when(out, F.lit(0.0)).when(enough, nearest(c, d))
    return t.select(
        "player_id", "minutes", "appearances", F.coalesce(enough, F.lit(False)).alias("sufficient_data"), shown(nearest(F.col("em") * doubt, 9), 1).alias("expected_minutes"), shown(nearest(F.col("sp") * doubt, 9), 3).alias("start_probability"),
        shown(eg, 3).alias("expected_goals"), shown(ea, 3).alias("expected_assists"), shown(at_least(eg), 4).alias("prob_scores"), shown(1 - poisson_upto(1, F.greatest(eg, F.lit(1e-6))), 4).alias("prob_two_plus"),
        shown(at_least(ea), 4).alias("prob_assists"), shown(at_least(eg + ea), 4).alias("prob_involvement"),
    )


def count_expectations(fixtures: DataFrame, rows: DataFrame, value: str, as_of, referees: DataFrame | None = None, least: int = 8, days: float = 365.0, shrinkage: float = 6.0) -> DataFrame:
    """(id, mu_home, mu_away, sufficient_data): a count expected of both sides of fixtures (id, home_team_id, away_team_id, referee): the league's mean
    at that venue x the side's rate for x the other's rate against, and the referee's multiplier where there is one.

    Nothing is known where a side has fewer than least rows with the count.
    """
    made = written(_rates_and_means(rows, value, as_of, days, shrinkage), "rates")  # a row a team; each side's join needs other columns, so that unwritten it would be made twice
    league = made.agg(F.max("mh").alias("mh"), F.max("ma").alias("ma"))  # one row
    rates = made.drop("mh", "ma")
    f = fixtures.select("id", "home_team_id", "away_team_id", F.trim(F.coalesce("referee", F.lit(""))).alias("referee"))
    for p in ("home", "away"):
        f = f.join(rates.select(F.col("team_id").alias(f"{p}_team_id"), *[F.col(c).alias(f"{p}_{c}") for c in rates.columns if c != "team_id"]), f"{p}_team_id", "left")
    f = f.join(F.broadcast(league))
    f = f.withColumn("multiplier", F.lit(None).cast("double")) if referees is None else f.join(referees.select("referee", "multiplier"), "referee", "left")
    rate = lambda c: F.coalesce(c, F.lit(1.0))
    enough = F.least(F.coalesce("home_n", F.lit(0)), F.coalesce("away_n", F.lit(0))) >= least
    by = F.coalesce("multiplier", F.lit(1.0))
    mu = lambda m, own, other: F.when(enough, F.round(F.col(m) * rate(own) * rate(other) * by, 6))
    return f.select("id", mu("mh", "home_for_home", "away_against_away").alias("mu_home"), mu("ma", "away_for_away", "home_against_home").alias("mu_away"), enough.alias("sufficient_data"))


def count_targets(expected: DataFrame, market: str, lines, dispersion: DataFrame | None = None, most: int = 30) -> DataFrame:
    """(id, market, selection, value, low, high, sufficient_data) from count_expectations: the total with its central 80 %, both sides' counts, over and
    under of every line; a withheld row where nothing is known. dispersion: (id, dispersion), for a negative binomial above 1.1."""
    r = expected if dispersion is None else expected.join(dispersion, "id", "left")
    r = count_columns(spread(r, "id"), F.greatest(F.col("mu_home") + F.col("mu_away"), F.lit(0.05)), F.col("dispersion") if dispersion is not None else F.lit(None).cast("double"), most)
    r = r.select("id", "mu_home", "mu_away", "sufficient_data", _reach(0.10, most).alias("_low"), _reach(0.90, most).alias("_high"), *[beyond(line, most).alias(f"_over{i}") for i, line in enumerate(lines)])
    none = F.lit(None).cast("int")

    def row(m: str, s: str, v: Column, low: Column = none, high: Column = none, known: bool = True) -> Column:
        return F.struct(F.lit(m).alias("market"), F.lit(s).alias("selection"), F.round(v, 6).alias("value"), low.alias("low"), high.alias("high"), F.lit(known).alias("sufficient_data"))

    cells = [row(f"expected_{market}", "total", F.col("mu_home") + F.col("mu_away"), F.col("_low"), F.col("_high")), row(f"expected_{market}", "home", F.col("mu_home")), row(f"expected_{market}", "away", F.col("mu_away"))]
    for i, line in enumerate(lines):
        cells += [row(f"{market}_over_under_{line}", "over", F.col(f"_over{i}")), row(f"{market}_over_under_{line}", "under", 1 - F.col(f"_over{i}"))]
    withheld = row(market, "", F.lit(None).cast("double"), known=False)
    # either kind of rows from one read: of a union, each part would work out all that was expected
    return r.select("id", F.inline(F.when(F.col("sufficient_data"), F.array(*cells)).otherwise(F.array(withheld))))


def player_factor(projections: DataFrame, expected: DataFrame, recent: DataFrame, least: float = 0.1) -> DataFrame:
    """projections (player_id, team_id, expected_goals, expected_assists) for one match: both scaled by the team's expected goals over its recent
    rate, between 0.5 and 2, and what follows: (player_id, team_id, id, scale, expected_goals, expected_assists, prob_scores, prob_two_plus, prob_assists, prob_involvement).

    expected: (id, team_id, goals), recent: (team_id, rate). Without a recent rate above least the scale is 1.
    """
    r = projections.join(expected, "team_id").join(recent.select("team_id", "rate"), "team_id", "left")
    scale = F.when(F.coalesce(F.col("rate") > least, F.lit(False)) & (F.col("goals") > 0), F.least(F.greatest(F.col("goals") / F.col("rate"), F.lit(0.5)), F.lit(2.0))).otherwise(1.0)
    r = r.withColumn("scale", F.round(scale, 9)).withColumn("g", F.round(F.col("expected_goals") * F.col("scale"), 9)).withColumn("a", F.round(F.col("expected_assists") * F.col("scale"), 9))
    some = lambda x: F.round(1 - F.exp(-F.greatest(x, F.lit(1e-6))), 4)
    return r.select("player_id", "team_id", "id", F.round("scale", 3).alias("scale"), F.round("g", 3).alias("expected_goals"), F.round("a", 3).alias("expected_assists"), some(F.col("g")).alias("prob_scores"),
                    F.round(1 - poisson_upto(1, F.greatest(F.col("g"), F.lit(1e-6))), 4).alias("prob_two_plus"), some(F.col("a")).alias("prob_assists"), some(F.col("g") + F.col("a")).alias("prob_involvement"))
