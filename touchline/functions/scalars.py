"""Scalar expressions: parsing, dates, decay, distributions, names. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """A double from text, null for blanks and anything that is no finite number."""
    n = F.trim(text).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < F.lit(1e300)), n)


def to_whole(text: Column) -> Column:
    """The number in text without its fraction: '3.7' is 3."""
    n = to_number(text)
    return F.when(F.abs(n) < 2e9, F.when(n < 0, F.ceil(n)).otherwise(F.floor(n))).cast("int")


#: Date patterns, tried in this order.
DATE_PATTERNS = ("d/M/yyyy", "d/M/yy", "yyyy-M-d", "d-M-yyyy", "d.M.yyyy")


def to_day(text: Column) -> Column:
    """The first pattern that reads the text; two-digit years from 69 on are of the last century."""
    shapes = (r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{2}$", r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}\.\d{1,2}\.\d{4}$")
    t = F.trim(text)
    tried = [F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(p)).cast("date")) for shape, p in zip(shapes, DATE_PATTERNS, strict=True)]
    day = F.coalesce(*tried)
    return F.when((F.year(day) >= 2069) & t.rlike(shapes[1]), F.add_months(day, -1200)).otherwise(day)


def season_year(day: Column) -> Column:
    """Seasons begin on 1 July."""
    return F.year(day) - F.when(F.month(day) < 7, 1).otherwise(0)


def season_label(day: Column) -> Column:
    y = season_year(day)
    return F.format_string("%d-%02d", y, F.pmod(y + 1, F.lit(100)))


def half_life(age_days: Column, days: float) -> Column:
    """0.5 to the power of age / days; negative ages count as 0, and days of 0 or less don't decay."""
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0)) / days) if days > 0 else F.lit(1.0)


def poisson(k: Column, mean: Column) -> Column:
    """The probability of k (0 to 20) events."""
    return F.exp(-mean) * F.pow(mean, k) / F.factorial(k)


def poisson_upto(n: int, mean: Column) -> Column:
    terms = [poisson(F.lit(k), mean) for k in range(n + 1)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def counts(mean: Column, dispersion: Column, most: int) -> Column:
    """Probabilities of 0 to most events as an array that sums to 1: negative binomial of variance
    dispersion x mean where dispersion is above 1.1, else Poisson."""
    wide = F.coalesce(dispersion > 1.1, F.lit(False))
    n = F.when(wide, mean / (dispersion - 1))
    q = F.when(wide, 1 - 1 / dispersion)
    first = F.when(wide, F.exp(n * F.ln(1 / dispersion))).otherwise(F.exp(-mean))

    # what a lambda says of all elements is worked out anew for each of them: so the last one and the sum are carried along
    def step(acc: Column, k: Column) -> Column:
        p = acc.last * F.when(acc.wide, acc.q * (acc.n + k - 1) / k).otherwise(acc.mean / k)
        return F.struct(F.array_append(acc.all, p).alias("all"), p.alias("last"), (acc.total + p).alias("total"), acc.mean.alias("mean"), acc.n.alias("n"), acc.q.alias("q"), acc.wide.alias("wide"))

    start = F.struct(F.array(first).alias("all"), first.alias("last"), (F.lit(0.0) + first).alias("total"), mean.alias("mean"), n.alias("n"), q.alias("q"), wide.alias("wide"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda acc: F.transform(acc.all, lambda p: p / acc.total))


#: Accented letters and their plain ones.
ACCENTS = ("áàâäãåāçćčéèêëēíìîïīñńóòôöõøōúùûüūýÿšśžźżł", "aaaaaaaccceeeeeiiiiinnooooooouuuuuyysszzzl")
#: Words that don't tell clubs apart.
NOISE_WORDS = ("fc", "afc", "cf", "sc", "ac", "club", "the", "de", "cd", "ud", "sv", "fk", "if", "bk")


def plain_name(name: Column) -> Column:
    """Lower case, without accents, punctuation or noise words (unless nothing else is left)."""
    t = F.translate(F.lower(F.trim(name)), *ACCENTS)
    t = F.regexp_replace(t, r"(?<=\w)['.’](?=\w)", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]+", " "), r"\s+", " "))
    told = F.array_join(F.filter(F.split(t, " "), lambda w: ~w.isin(*NOISE_WORDS)), " ")
    return F.when(told != "", told).otherwise(t)
