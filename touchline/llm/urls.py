"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A rule names a host and a path prefix; it fits the host and all its subdomains, and
the longest fitting rule decides. Without a rule the vocabulary does: one automaton
finds all terms in the lower-cased url; a hit counts if no letter or digit stands
directly before or after it. One strict term, or several distinct soft terms whose
weights add up to the threshold, reject the url. Rules, terms and weights are parameters of judge.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Terms that reject on their own.
STRICT = (
    "casino", "casinos", "casino-win", "porn", "porno", "pornos", "xxx", "escort", "escorts", "viagra", "cialis", "free-bets", "cheap-pills", "webcam-sex", "sexcam",
    "spielcasino", "glucksspiel", "tragamonedas", "apuestas-gratis", "pornografia", "machines-a-sous", "paris-gratuits", "xn--csino-zqa", "payday-loans", "keygen", "warez",
)
#: Terms that reject together, by weight: weak ones, which clean urls hold too, and strong ones.
WEAK = ("ads", "ad", "track", "tracker", "win", "free", "cheap", "bonus", "adult", "loan", "credit", "download", "click", "promo", "gratis", "gratuit", "kostenlos", "billig", "barato", "oferta", "kredit", "pret", "prestamo", "gewinn", "gana", "gagner")
STRONG = ("bet", "bets", "betting", "pills", "poker", "slots", "sex", "loans", "crack", "cracked", "torrent", "torrents", "roulette", "jackpot", "lottery", "nude", "milf", "wetten", "apuestas", "paris-sportifs", "loteria", "loterie", "sexo", "sexe")
SOFT = {term: 1 for term in WEAK} | {term: 2 for term in STRONG}
#: The distinct soft hits that reject together: their number and the sum of their weights, at least.
DISTINCT, THRESHOLD = 2, 3
#: Escaped separators are read as -.
ESCAPED = "%(2d|2e|2f|5f|20|2b|3d|26)"

_ORDER = "abcdefghijklmnopqrstuvwxyz"


def automaton(strict, soft):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        found.add_word(term, (term, term in strict, soft.get(term, 0)))
    found.make_automaton()
    return found


def hits(found, url: str) -> tuple[list[str], list[str], int]:
    """The distinct strict and soft terms in the url, and the soft terms' weight together."""
    text, strict, soft, weight = re.sub(ESCAPED, "-", url.translate(_LOWER)), set(), set(), 0
    letter = lambda i: 0 <= i < len(text) and (text[i].isascii() and text[i].isalnum())
    for end, (term, is_strict, w) in found.iter(text):
        if letter(end + 1) or letter(end - len(term)):
            continue
        if is_strict:
            strict.add(term)
        elif term not in soft:
            soft.add(term)
            weight += w
    return sorted(strict), sorted(soft), weight


_LOWER = str.maketrans(_ORDER.upper(), _ORDER)


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    strict=STRICT,
    soft=None,
    threshold: int = THRESHOLD,
    distinct: int = DISTINCT,
) -> DataFrame:
    """One row per input row: id_col, host, path, rule, verdict, strict_hits, soft_hits, soft_weight.

    Rules are compared as Spark expressions; only urls' vocabulary hits need Python.
    Null urls and those without :// have empty host and path, fit no rule, and are
    judged by their terms alone (a null has none: allow). Of rules that fit, the one
    with the longest host and path together wins. Repeated rows and null ids give a
    row each; other columns are ignored; there is no shuffle.
    """
    soft = SOFT if soft is None else soft
    after = F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")
    has = F.coalesce(F.instr(F.col(url_col), "://") > 0, F.lit(False))
    host = F.when(has, F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _ORDER.upper(), _ORDER)).otherwise("")
    path = F.when(has, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    rows = rows.select("*", (F.lit(None).cast("string") if rule is None else rule).alias("rule"), (F.lit(None).cast("string") if verdict is None else verdict).alias("_verdict"))

    def batches(found):
        terms = automaton(strict, soft)
        for b in found:
            got = [hits(terms, url or "") for url in b.column("_url").to_pylist()]
            ruled = b.column("_verdict").to_pylist()
            verdicts = [v or ("block" if s or len(t) >= distinct and w >= threshold else "allow") for v, (s, t, w) in zip(ruled, got, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), b.column("host"), b.column("path"), b.column("rule"), pa.array(verdicts, pa.string()), pa.array([",".join(s) for s, _, _ in got], pa.string()), pa.array([",".join(s) for _, s, _ in got], pa.string()), pa.array([w for _, _, w in got], pa.int64())],
                names=[id_col, "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(batches, f"{id_col} {kind}, host string, path string, rule string, verdict string, strict_hits string, soft_hits string, soft_weight long")


def op6_urls(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    def hit(term: str) -> str:
        return f"regexp_matches(u, '(^|[^a-z0-9]){re.escape(term)}($|[^a-z0-9])')"

    rules = "\n".join(f"    when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}|{v}'" for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r)))
    listed = lambda terms: "concat_ws(','" + "".join(f", case when {hit(t)} then '{t}' end" for t in sorted(terms)) + ")"
    weight, number = " + ".join(f"case when {hit(t)} then {w} else 0 end" for t, w in SOFT.items()), " + ".join(f"case when {hit(t)} then 1 else 0 end" for t in SOFT)
    return f"""
with a as (
  select page_id, regexp_replace(translate(coalesce(url, ''), '{_ORDER.upper()}', '{_ORDER}'), '{ESCAPED}', '-', 'g') as u,
    case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
), b as (
  select page_id, u, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_ORDER.upper()}', '{_ORDER}'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from a
), c as (
  select *, case
{rules}
  end as fit, {listed(STRICT)} as strict_hits, {listed(SOFT)} as soft_hits, ({weight})::bigint as soft_weight, ({number}) as soft_number from b
)
select page_id, host, path, split_part(fit, '|', 1) as rule,
  case when fit is not null then split_part(fit, '|', 2) when strict_hits <> '' or soft_number >= {DISTINCT} and soft_weight >= {THRESHOLD} then 'block' else 'allow' end as verdict,
  strict_hits, soft_hits, soft_weight
from c
"""


SQL = _sql()
