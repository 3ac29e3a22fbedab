"""Indexes of the items that the queries share, and keyword search as SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..adapters import items
from ..functions.stemming import STEP_2, STEP_3, STEP_4
from ..operators.keyword_index import KeywordIndex, phrases
from ..session import new_folder

_BUILT: dict[tuple[str, str], str] = {}


def indexed(spark: SparkSession, d: str) -> KeywordIndex:
    """The keyword index of a folder's items, written once an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        path = new_folder(spark)
        KeywordIndex(spark, path, buckets=64, spread=2).build(items(spark, d))
        _BUILT[key] = path
    return KeywordIndex(spark, _BUILT[key], buckets=64, spread=2)


# --- Porter's rules as SQL: C and V are runs of consonants and vowels; a first y is a consonant and written Y ------------

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME, _ONE, _MORE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
_VOWEL, _CLOSED = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def _is(w: str, pattern: str) -> str:
    return f"regexp_matches({w}, '{pattern}')"


def _longest(rules: list[tuple[str, str, str]]) -> str:
    """w with the longest ending replaced, where the rest passes the rule's test."""
    cases = "".join(f" WHEN ends_with(w, '{e}') THEN CASE WHEN {test.format(rest=f'w[:-{len(e) + 1}]')} THEN w[:-{len(e) + 1}] || '{to}' ELSE w END" for e, to, test in sorted(rules, key=lambda r: -len(r[0])))
    return f"CASE{cases} ELSE w END"


def stems_sql(words: str, name: str) -> str:
    """CTEs up to {name}stems (term, stem) of the distinct terms that a query gives."""
    some, more = _is("{rest}", _SOME), _is("{rest}", _MORE)
    steps = [
        f"CASE WHEN {_is('w', '.(ss|i)es$')} THEN w[:-3] WHEN {_is('w', '([^s]|^)s$')} THEN w[:-2] ELSE w END",
        f"CASE WHEN ends_with(w[2:], 'eed') THEN CASE WHEN {_is('w[:-4]', _SOME)} THEN w[:-2] ELSE w END WHEN ends_with(w, 'ed') AND {_is('w[:-3]', _VOWEL)} THEN w[:-3] || '+' WHEN ends_with(w, 'ing') AND {_is('w[:-4]', _VOWEL)} THEN w[:-4] || '+' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '+') THEN w WHEN {_is('w', '(at|bl|iz)[+]$')} THEN w[:-2] || 'e' WHEN w[-2:-2] = w[-3:-3] AND {_is('w[:-2]', '[^aeiouylsz]$')} THEN w[:-3] WHEN {_is('w[:-2]', _ONE)} AND {_is('w[:-2]', _CLOSED)} THEN w[:-2] || 'e' ELSE w[:-2] END",
        f"CASE WHEN ends_with(w, 'y') AND {_is('w[:-2]', _VOWEL)} THEN w[:-2] || 'i' ELSE w END",
        _longest([(e, to, some) for e, to in STEP_2]),
        _longest([(e, to, some) for e, to in STEP_3]),
        _longest([(e, "", more + (" AND " + _is("{rest}", "[st]$") if e == "ion" else "")) for e in STEP_4]),
        f"CASE WHEN ends_with(w, 'e') AND ({_is('w[:-2]', _MORE)} OR {_is('w[:-2]', _ONE)} AND NOT {_is('w[:-2]', _CLOSED)}) THEN w[:-2] ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_is('w', _MORE)} THEN w[:-2] ELSE w END",
    ]
    out = [f"{name}p0 AS (SELECT term, regexp_replace(term, '^y', 'Y') AS w FROM ({words}))"]
    out += [f"{name}p{i} AS (SELECT term, {step} AS w FROM {name}p{i - 1})" for i, step in enumerate(steps, 1)]
    return ",\n".join([*out, f"{name}stems AS (SELECT term, CASE WHEN length(term) BETWEEN 3 AND 64 THEN lower(w) ELSE term END AS stem FROM {name}p{len(steps)})"])


def _terms(column: str) -> str:
    return f"regexp_extract_all(lower(strip_accents(coalesce({column}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def bm25_sql(query: str, k: int, name: str = "b") -> str:
    """CTEs up to `name` (id, score, rank): the k best items that hold every phrase of the query."""
    wanted = phrases(query)
    terms = sorted({t for p in wanted for t in p})
    words = ", ".join(f"list(term) FILTER (stem = '{t}') AS w{i}" for i, t in enumerate(terms))
    hold = lambda t, at: f"coalesce(list_contains(w{terms.index(t)}, {at}), false)"
    times = lambda p, of: f"len(list_filter(range(1, len({of}) + {2 - len(p)}), lambda i: {' AND '.join(hold(t, f'{of}[i + {n}]') for n, t in enumerate(p))}))"
    f = ", ".join(f"{times(p, 'a')} + {times(p, 'c')} AS f{i}" for i, p in enumerate(wanted))
    n = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(wanted)))
    idf = lambda i: f"ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE))"
    part = " + ".join(f"(CASE WHEN {idf(i)} > 0 THEN {idf(i)} ELSE 1e-6::DOUBLE END) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(wanted)))
    return f"""{name}t AS MATERIALIZED (SELECT id, {_terms('title')} AS a, {_terms('content')} AS c FROM items), {stems_sql(f"SELECT DISTINCT unnest(a || c) AS term FROM {name}t", name)},
{name}w AS MATERIALIZED (SELECT {words} FROM {name}stems), {name}f AS MATERIALIZED (SELECT id, len(a) + len(c) AS dl, {f} FROM {name}t, {name}w), {name}s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {n} FROM {name}f),
{name} AS (SELECT id, round(score, 6) AS score, score AS exact, row_number() OVER (ORDER BY score, id) - 1 AS rank FROM (SELECT id, round(-({part}), 12) AS score FROM {name}f, {name}s WHERE {" AND ".join(f"f{i} > 0" for i in range(len(wanted)))} ORDER BY score, id LIMIT {k}))"""
