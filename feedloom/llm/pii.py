"""Personal data: identifiers of known form, and unseen ones found by the contexts that known ones stand in.

First, every whole text is searched for e-mail and IP addresses, card and phone numbers (the base). They are the seeds.
Then bootstrapping: a candidate is a run of digits, or a word with a digit, that may be an identifier; seeds are
candidates of a known kind. Each candidate's place gives lexical patterns (the two words before it; the word before and
the word after). Spark builds the graph of patterns and distinct values and scores it in rounds: a pattern is trusted
for a kind if enough known values of that kind stand in it, hardly any of another, and they are a good share of all
values in it; a value becomes known if trusted patterns of one kind vouch for it enough. The next round's patterns are
scored with the values so found, until nothing new is found or ROUNDS are done. All places of a value found are spans.

Bounds: a task holds one batch of texts, by bytes; the searches are linear in a text's length, also in hostile ones. Only
candidates are shuffled (with at most five words around), never texts; the graph's edges are distinct, so that copies add
nothing, and counts are added up before they are shuffled. A round's values are a written table.

Defined results: a null text is empty and has no spans; so has a text without digits. Null and repeated ids stay, each row
with its own spans. Equal scores of two kinds for a value: it stays unknown. An added span never overlaps a base one.
Spans are code points, from 0, end exclusive, by start, then by kind as listed. Contexts are looked for in the
WINDOW characters on either side. Empty tables give empty results. Other columns take no part, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import in_batches, materialise

KINDS = ("email", "ip", "card", "phone")
#: Distinct known values that a pattern needs, their least share of its known values, and of all its values.
SUPPORT, PURITY, SHARE = 5, 0.9, 0.5
#: Belief that makes a value known: one less the product of what its trusted patterns leave open.
BELIEF = 0.6
ROUNDS = 4
#: Characters on either side of a candidate in which its context is looked for.
WINDOW = 80
#: Digits of a bare number, and characters of a word with a digit, from which it may be an identifier.
DIGITS, LENGTH = 5, 6

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"\(?[0-9][0-9().\x20-]*[0-9](?![A-Za-z0-9_])|[A-Za-z0-9]++(?:[_.%+@/#:-]++[A-Za-z0-9]++)*+")
_WORD = re.compile(r"\w+|[^\w\s]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:  # no match reaches over an @ that is not its own
        start = low + len(text[low:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        low = m.end() if m else at + 1
        if m:
            yield start, low
        at = text.find("@", low)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) // 4 * 4, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


_FINDERS = (emails, addresses, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every identifier of known form, in order."""
    return sorted((start, k, end) for k, find in enumerate(_FINDERS) for start, end in find(text))


def _word(w: str) -> str:
    """A word of a pattern; long ones by digest."""
    w = w.lower()
    return w if len(w) <= 32 else "#" + hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of a place: 'a b _' and 'b _ c' for the words a b before and c after it."""
    before = [_word(w) for w in _WORD.findall(text[max(0, start - WINDOW) : start])[-2:]]
    m = _WORD.search(text, end, end + WINDOW)
    found = []
    if len(before) == 2:
        found.append(f"{before[0]} {before[1]} _")
    if before and m:
        found.append(f"{before[-1]} _ {_word(m.group())}")
    return found


def value(found: str) -> bytes:
    """What makes two mentions the same value: letters in lower case and digits, without what separates them."""
    return hashlib.blake2b(re.sub(r"[^a-z0-9@]+", "", found.lower()).encode(), digest_size=16).digest()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind's number or -1) of the base and of the runs that may be identifiers and touch none of it."""
    out = [(s, e, k) for s, k, e in base]
    covered = sorted((s, e) for s, _, e in base)
    i = 0
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        run = m.group()
        n = len(_NOT_DIGIT.sub("", run))
        if n < DIGITS if run[0] in "(0123456789" and not any(c.isalpha() for c in run) else not n or len(run) < LENGTH:
            continue
        while i < len(covered) and covered[i][1] <= s:
            i += 1
        if i == len(covered) or covered[i][0] >= e:
            out.append((s, e, -1))
    return out


_HAS = re.compile("[0-9@]")
_FOUND = "doc_id {}, counts array<long>, base array<struct<start:long,kind:int,end:long>>, places array<struct<start:long,end:long,kind:int,value:binary,patterns:array<string>>>"
_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value", pa.binary()), ("patterns", pa.list_(pa.string()))]))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, bases, places = [], [], []
        for t in batch.column("text"):
            text = t.as_py() or ""
            if not _HAS.search(text):
                counts.append([0] * len(KINDS))
                bases.append([])
                places.append([])
                continue
            base = base_spans(text)
            counts.append([sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))])
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            places.append([{"start": s, "end": e, "kind": k, "value": value(text[s:e]), "patterns": contexts(text, s, e)} for s, e, k in candidates(text, base)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.list_(pa.int64())), pa.array(bases, _BASE), pa.array(places, _PLACES)], names=["doc_id", "counts", "base", "places"])


def search(docs: DataFrame) -> DataFrame:
    """doc_id, counts and base (spans of known form) and places (candidates with their patterns), a row for each of docs."""
    held = docs.select("doc_id", "text")
    return in_batches(held).mapInArrow(_search, _FOUND.format(held.schema["doc_id"].dataType.simpleString()))


def edges(found: DataFrame) -> DataFrame:
    """pattern, value, kind (null: unknown), each pattern and value once."""
    places = found.select(F.explode("places").alias("p")).select("p.*")
    kind = F.max(F.when(F.col("kind") >= 0, F.col("kind")))
    return places.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(kind.alias("kind"))


def trusted(known: DataFrame, support: int = SUPPORT, purity: float = PURITY, share: float = SHARE) -> DataFrame:
    """pattern, kind, confidence, n_known, n_values of the patterns that speak for a kind, by edges (pattern, value, kind)."""
    of_kind = [F.count_if(F.col("kind") == k) for k in range(len(KINDS))]
    sums = known.groupBy("pattern").agg(F.count("*").alias("n_values"), F.count("kind").alias("n_any"), F.array(*of_kind).alias("by_kind")).where(F.col("n_any") >= support)
    most = F.array_max("by_kind")
    good = sums.withColumn("n_known", most).where((most >= support) & (most >= purity * F.col("n_any")) & (most >= share * F.col("n_values")))
    return good.select("pattern", (F.array_position("by_kind", most) - 1).cast("int").alias("kind"), (F.col("n_known") / F.col("n_values")).alias("confidence"), "n_known", "n_values")


def vouched(unknown: DataFrame, patterns: DataFrame, belief: float = BELIEF) -> DataFrame:
    """value, kind, belief of the unknown values that trusted patterns of one kind vouch for."""
    open_ = F.exp(F.sum(F.ln(F.lit(1.0) - F.least(F.col("confidence"), F.lit(0.999)))))
    by = unknown.select("pattern", "value").join(patterns.select("pattern", "kind", "confidence"), "pattern").groupBy("value", "kind").agg((1 - open_).alias("belief"))
    ranked = by.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("belief", "kind")), asc=False).alias("k"))  # as many as there are kinds
    first, second = F.get("k", F.lit(0)), F.get("k", F.lit(1))
    clear = second.isNull() | (first["belief"] > second["belief"])
    return ranked.where((first["belief"] >= belief) & clear).select("value", first["kind"].alias("kind"), first["belief"].alias("belief"))


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """value, kind of the identifiers discovered in a written result of search(); None if there are none."""
    graph = materialise(edges(found), "pii-edges")
    known: DataFrame | None = None
    for _ in range(rounds):
        if known is None:
            now = graph
        else:
            now = graph.join(known.select("value", F.col("kind").alias("_kind")), "value", "left").select("pattern", "value", F.coalesce("kind", "_kind").alias("kind"))
        new = materialise(vouched(now.where("kind IS NULL"), trusted(now)).select("value", "kind"), "pii-values")
        if new.isEmpty():
            break
        known = new if known is None else known.unionByName(new)
    return known


def detect(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, counts, base, added (spans of discovered identifiers), a row for each of docs."""
    numbered = search(docs).withColumn("_row", F.monotonically_increasing_id())
    found = materialise(numbered, "pii")
    known = bootstrap(found, rounds)
    span = "array<struct<start:bigint,kind:int,end:bigint>>"
    if known is None:
        return found.select("doc_id", "counts", "base", F.array().cast(span).alias("added"))
    places = found.select("_row", F.explode("places").alias("p")).where("p.kind < 0").select("_row", "p.start", "p.end", "p.value")
    hits = places.join(known, "value").groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    return found.join(hits, "_row", "left").select("doc_id", "counts", "base", F.coalesce("added", F.array().cast(span)).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    counts = [F.get("counts", F.lit(i)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return detect(docs).select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
