"""Near-duplicate detection with bottom-k sketches of one hash function.

A document's set holds its distinct five-word shingles (with fewer words, the whole sequence; without words,
nothing). Its sketch is the K_SKETCH smallest hashes of that set. Documents of equal sets form one class, whose
smallest doc_id is its label. Inverted lists over the LISTED smallest retained values generate pairs of classes
with the overlap of their listed values; the overlap within the K_SKETCH smallest values of the union estimates the
similarity and drops pairs far below the threshold; the rest are verified on full sets, computed from the whole texts.

Why no link is lost: of the 24 smallest hashes of the union of two sets with J >= 0.75, each is in both sets with
probability J, and one in both is in both sketches. So both share at least ENOUGH listed values but for odds of
about 1e-7, and the estimate (mean 0.75, deviation 0.054) falls under LOOSE with odds of about the same order.

What keeps the work near the number of classes:

- A class with fewer than ENOUGH listed values that another class lists too has no partner.
- The share of a class: how many of its shingles some class of another component holds, counted on full sets. Two sets
  overlap in no more than the lesser share, which bounds their similarity from above, exactly. Classes whose share is below
  the threshold leave; of the others, pairs that this bound rules out are never made. Shares fall as components merge: a
  class that only resembles members of its own component has nothing left to meet.
- Two sets differ in at least as many shingles as their parity bitmaps differ in bits: a second bound, exact too, which
  rules out nearly all pairs of members of a large group that are near the threshold and below it.
- In a large group of near copies nearly every shingle is held by some other class, so shares no longer fall, and the members
  outside its largest component grow with the group. There a pair shares a rare shingle, one that at most RARE classes hold, or
  overlaps in common ones alone. Pairs of the first kind are found by their rare shingles, of which a class lists no more than it
  can miss (prefixes in order of frequency). For all others the number of common shingles takes the place of the share, and a
  class is only compared with those of the sizes that this number allows.
- Lists are compared with pivots, not pair by pair. First each list's class of the greatest share takes all members, and
  each class keeps the pivot that it shares most lists with: one pair a class. Then, round by round, pivots are taken from
  outside each list's largest component, and compared with the members outside their own component; a pair is made in the
  first list that it shares, and only there. That ends when every class outside a largest component was a pivot, so each pair
  that shares a list lies in one component, was compared, shares a rare shingle, or is ruled out by a bound.

What keeps the shuffles in proportion to the input: texts, sketches and sets pass a broadcast filter of the names that a join asks
for before it deals them out, so texts without a possible partner stay where they are and a round moves what its pairs need.

Components are found by smallest labels and pointer jumping on DataFrames; every round is cut by a table in the shared
folder.

Defined results: a null or wordless text has an empty set and links with nothing. Repeated rows and copies share
a class. For `components` a null doc_id gets no class of its own: its row has null component_id and kept false, but where
the set is shared it changes nothing for the others; `keep_one` decides on such rows too. Two rows of one doc_id with different texts are both linked to
that id. An empty table gives an empty result. Other columns are dropped by `components` and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .store import in_batches, is_small, materialise, release, small

SHINGLE = 5
PERCENT = 75
K_SKETCH = 64
LISTED = 24
ENOUGH = 7
LOOSE = 0.47
#: Numbers of 64 bits in a class's parity bitmap: bit b says whether an odd number of its shingles hash to b.
BITMAP = 16
#: Rows of texts whose sets are held at once.
A_BATCH = 512
#: Classes that hold a rare shingle, at most.
RARE = 256
#: Steps of size by which lists are cut, in a factor of e.
SIZES = 24
#: Bits that each name has in the filter that rows pass before a join deals them out.
FILTER_BITS = 16
#: Pivots that a list gives in the second round, and by how much more each later round takes.
PIVOTS, MORE_PIVOTS = 8, 32


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, as signed numbers."""
    data, offsets = K.utf8(column)
    for a, b in K.slices(offsets, K.PIECE):
        low = offsets[a]
        part = K.LOWER[data[low : offsets[b]]]
        starts, ends, first = K.words(part, offsets[a : b + 1] - low, K.SPACED)
        hashes = K.word_hashes(part, starts, ends)
        fives = K.grams(hashes, SHINGLE).view(np.int64)
        for i in range(b - a):
            s, e = first[i], first[i + 1]
            n = e - s
            if n >= SHINGLE:
                yield np.unique(fives[s : e - SHINGLE + 1])
            elif n:
                yield K.grams(hashes[s:e], int(n), salt=int(n)).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, mark, flat, ends = [], [], [], [0]
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            mark.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            flat.append(s[:K_SKETCH])
            ends.append(ends[-1] + len(flat[-1]))
        values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["doc_id", "key", "n_shingles", "mark", "sketch"])


def _key() -> Column:
    return F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n_shingles, mark (of the whole set; null if empty), sketch."""
    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key().alias("key")).mapInArrow(_sketch, "doc_id long, key binary, n_shingles long, mark binary, sketch array<long>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.offsets.to_numpy(), column.values.to_numpy()


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, s_a, s_b: a, b and the similarity that the smallest values of the union of both sketches show, if LOOSE or more."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            n = part.num_rows
            wide = np.full((n, 2 * K_SKETCH), np.iinfo(np.int64).max)
            for k, name in enumerate(("s_a", "s_b")):
                ends, flat = _lists(part.column(name))
                size = np.diff(ends)
                row = np.repeat(np.arange(n), size)
                wide[row, k * K_SKETCH + np.arange(size.sum()) - np.repeat(ends[:-1] - ends[0], size)] = flat[ends[0] : ends[-1]]
            wide.sort(axis=1)
            some = wide != np.iinfo(np.int64).max
            again = np.zeros_like(some)
            again[:, 1:] = (wide[:, 1:] == wide[:, :-1]) & some[:, 1:]
            place = np.cumsum(some & ~again, axis=1)  # among the union's values
            union = np.minimum(place[:, -1], K_SKETCH)
            est = (again & (place <= K_SKETCH)).sum(axis=1) / np.maximum(union, 1)
            keep = pa.array(est >= LOOSE)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep), pa.array(est).filter(keep)], names=["a", "b", "est"])


def _among(table: DataFrame, key: str, named: DataFrame) -> DataFrame:
    """The rows of table whose key may be in named (one column), so that a join deals out few others: each name sets one of FILTER_BITS
    times as many bits, and 4 KB of bits are a row that is broadcast."""
    bits = max(1 << 15, FILTER_BITS * named.count())
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = named.select(slot(named.columns[0]).alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    at = F.bitmap_bit_position(slot(key))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, 1)), 16, 10).cast("int")
    met = (F.bitmap_bucket_number(slot(key)) == F.col("_bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return table.join(F.broadcast(maps), met, "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    """rep of the classes that stand in pairs."""
    return materialise(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "ends")


def _estimate(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches are alike enough."""
    side = lambda x: sketched.select(F.col("rep").alias(x), F.col("sketch").alias(f"s_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "s_a", "s_b").mapInArrow(_overlap, "a long, b long, est double").select("a", "b")


def _components(state: DataFrame, links: DataFrame) -> DataFrame:
    """state (rep, n, enough, comp) after links (a, b): the labels that links join are contracted, and each takes the smallest it reaches,
    by the smallest label of a neighbour and the label of its own label, until nothing moves."""
    # few links or labels are broadcast, so that a round on them deals nothing out; what is more is joined by shuffles
    ends = state.select(F.col("rep").alias("a"), F.col("comp").alias("x")).join(small(links), "a")
    ends = state.select(F.col("rep").alias("b"), F.col("comp").alias("y")).join(ends, "b").where("x <> y")
    both = materialise(ends.select("x", "y").union(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "hooks")
    labels = materialise(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("low")), "labels")
    few = is_small(labels)
    held = lambda df: F.broadcast(df) if few else df
    while True:
        near = both.join(held(labels.select(F.col("x").alias("y"), "low")), "y").groupBy("x").agg(F.min("low").alias("near"))
        best = near.join(held(labels), "x").select("x", "low", F.least("low", "near").alias("now"))
        jump = best.join(held(labels.select(F.col("x").alias("now"), F.col("low").alias("next"))), "now", "left")
        new = materialise(jump.select("x", F.least("now", F.coalesce("next", "now")).alias("low"), (F.least("now", F.coalesce("next", "now")) < F.col("low")).alias("moved")), "labels")
        still = new.where("moved").isEmpty()
        release(labels)
        labels = new.select("x", "low")
        if still:
            break
    out = materialise(state.join(held(labels.select(F.col("x").alias("comp"), "low")), "comp", "left").select("rep", "n", "enough", F.coalesce("low", "comp").alias("comp")), "components")
    release(both, labels)
    return out


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    ends = _ends(pairs)
    sets = _among(sets, "rep", ends)
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("full").alias(f"set_{x}"))
    held = pairs.join(side("b"), "b").join(side("a"), "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    links = materialise(held.where(_alike(both, F.size("set_a"), F.size("set_b"))).select("a", "b"), "links")
    release(ends)
    return links


def _alike(both: Column, n_a: Column, n_b: Column) -> Column:
    """Whether sets of n_a and n_b that have so many in common reach the threshold."""
    return both * 100 >= (n_a + n_b - both) * PERCENT


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each of docs (doc_id, text)."""
    return _by_row(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _by_row(docs: DataFrame) -> DataFrame:
    """What components() gives, with key and mark."""
    made = materialise(sketches(docs), "sketches")
    classes = made.where(F.col("mark").isNotNull() & F.col("doc_id").isNotNull()).groupBy("mark")
    # classes are named by a hash of their mark so that a doc_id may repeat
    reps = classes.agg(F.min("doc_id").alias("label"), F.count("*").alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    reps = materialise(reps.withColumn("rep", F.xxhash64("mark")), "classes")
    state = _link(reps, docs)
    # a component's id is the smallest doc_id in it
    moved = state.join(reps.select("rep", "label"), "rep")
    smallest = moved.groupBy("comp").agg(F.min("label").alias("component"), F.count("*").alias("of")).where("of > 1").drop("of")
    linked = materialise(state.join(smallest, "comp").select("rep", "component"), "linked")
    known = reps.select("mark", "rep", "label", "n_docs").join(small(linked), "rep", "left")
    known = materialise(known.where((F.col("n_docs") > 1) | F.col("component").isNotNull()).select("mark", F.coalesce("component", "label").alias("component")), "known")
    release(reps, linked)
    out = made.select("doc_id", "key", "n_shingles", "mark").join(small(known), "mark", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "doc_id"), "doc_id"))
    return out.select("doc_id", "key", "mark", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _link(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, comp for every class that may have a partner."""
    every = reps.select("rep", "n_shingles", F.explode(F.slice("sketch", 1, LISTED)).alias("value"))
    shared = every.groupBy("value").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("value")
    listed = materialise(every.join(shared, "value").select("value", "rep", "n_shingles"), "listed")
    enough = F.least(F.lit(ENOUGH), F.ceil(F.least(F.col("n_shingles"), F.lit(LISTED)) * PERCENT / 100)).cast("int")
    able = listed.groupBy("rep", "n_shingles").count().where(F.col("count") >= enough).select("rep", F.col("n_shingles").alias("n"), enough.alias("enough"))
    able = materialise(able, "able")
    # the sketch, the listed values and the full set of each class that may have a partner
    held = reps.select("rep", "label", "mark", "sketch").join(small(able), "rep")
    sketched = materialise(held.select("rep", "label", "mark", "sketch"), "sketched")
    posts = materialise(listed.select("value", "rep").join(small(able.select("rep")), "rep", "left_semi"), "posts")
    release(listed)
    sets = _sets(docs, sketched.select("rep", F.col("label").alias("doc_id"), "mark"))
    traits = materialise(sketched.select("rep", F.slice("sketch", 1, LISTED).alias("values")).join(sets.select("rep", "bits"), "rep"), "traits")
    state = materialise(able.select("rep", "n", "enough", F.col("rep").alias("comp")), "components")
    release(able)
    live = _live(sets, state)
    state, moved = _merge(_first_pairs(posts.join(small(live), "rep")), state, sketched, sets)
    if moved:
        live = _live(sets, state, live)
    rare = _rare(sets, live, traits)
    live = materialise(rare.where((F.col("common") * 100 >= F.col("n") * PERCENT) & (F.size("values") >= F.col("enough"))).select("rep", "n", "enough", F.col("common").alias("share"), "values"), "live")
    # the class with the most common shingles stands in the middle of its group
    at = live.join(small(state.select("rep", "comp")), "rep").withColumn("value", F.explode("values"))
    state, _ = _merge(_first_pairs(at), state, sketched, sets)
    state, _ = _merge(_rare_pairs(rare.drop("comp").join(small(state.select("rep", "comp")), "rep")), state, sketched, sets)
    release(rare)
    pivots, done = PIVOTS, None
    while True:
        at = live.join(small(state.select("rep", "comp")), "rep").withColumn("value", F.explode("values"))
        now = _pivots(at, pivots, done)
        if now.isEmpty():
            break
        state, _ = _merge(_pivot_pairs(at, now, done, traits), state, sketched, sets)
        done = now if done is None else done.union(now)
        pivots *= MORE_PIVOTS
    release(posts, sets, sketched, traits, live)
    return state.select("rep", "comp")


def _live(sets: DataFrame, state: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """The classes (of `among`) whose share allows a partner: state with share, the number of shingles that another component holds."""
    held = state if among is None else materialise(state.join(small(among.select("rep")), "rep", "left_semi"), "open")
    each = sets.join(small(held.select("rep", "comp")), "rep").select("rep", "comp", F.explode("full").alias("shingle"))
    across = each.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("shingle")
    share = each.select("rep", "shingle").join(across, "shingle").groupBy("rep").agg(F.count("*").alias("share"))
    return materialise(held.join(share, "rep").where(F.col("share") * 100 >= F.col("n") * PERCENT).select("rep", "n", "enough", "comp", "share"), "live")


def _rare(sets: DataFrame, live: DataFrame, traits: DataFrame) -> DataFrame:
    """live with common, the number of a class's shingles that more than RARE classes hold, values, those of them that it lists, and
    prefix, its rarest shingles: all rare ones but as many, less one, as it must share with any partner beyond its common ones. Where the
    common ones may suffice, that is every rare one, so that pairs not met here share common values only."""
    each = sets.join(small(live.select("rep", "comp")), "rep").select("rep", "comp", F.explode("full").alias("shingle"))
    across = each.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("of")).where("low <> high").select("shingle", "of")
    by = each.select("rep", "shingle").join(across, "shingle").groupBy("rep")
    held = by.agg(F.collect_list(F.when(F.col("of") > RARE, F.col("shingle"))).alias("commons"), F.collect_list(F.when(F.col("of") <= RARE, F.struct("of", "shingle"))).alias("rare"))
    common = F.size("commons")
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * PERCENT / 100).cast("int") - common)
    prefix = F.slice(F.array_sort("rare"), 1, F.greatest(F.lit(0), F.size("rare") - least + 1))
    held = live.join(held, "rep").join(traits, "rep")
    return materialise(held.select("rep", "n", "enough", "comp", "share", "bits", common.alias("common"), F.array_intersect("values", "commons").alias("values"), prefix["shingle"].alias("prefix")), "rare")


def _rare_pairs(rare: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components that share a rare shingle of both prefixes and that no bound rules out."""
    held = rare.select("rep", "n", "share", "comp", "bits", F.explode("prefix").alias("shingle"))
    other = held.select(*(F.col(c).alias(f"p_{c}") for c in held.columns))
    met = held.join(other, (F.col("shingle") == F.col("p_shingle")) & (F.col("rep") < F.col("p_rep")) & (F.col("comp") != F.col("p_comp")) & _possible("", "p_") & _near())
    return met.select(F.col("rep").alias("a"), F.col("p_rep").alias("b")).distinct()


def _near() -> Column:
    """Whether the parity bitmaps of two classes allow the threshold."""
    differ = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("p_bits")[k])) for k in range(BITMAP)), F.lit(0))
    return _alike((F.col("n") + F.col("p_n") - differ) / 2, F.col("n"), F.col("p_n"))


def _step(n: Column) -> Column:
    return F.floor(F.ln(n) * SIZES).cast("int")


def _possible(x: str, y: str) -> Column:
    """Whether the shares of two classes allow the threshold."""
    return _alike(F.least(f"{x}share", f"{y}share"), F.col(f"{x}n"), F.col(f"{y}n"))


def _first_pairs(at: DataFrame) -> DataFrame:
    """For each class the pair (a, b) with the pivot of another component that it shares most lists with; a list's pivot has its greatest share."""
    named = F.struct("rep", "n", "share", "comp")
    pivot = at.groupBy("value").agg(F.max_by(named, F.struct(F.col("share") / F.col("n"), F.col("rep"))).alias("p"), F.count("*").alias("size")).where("size > 1")
    pivot = pivot.select("value", F.col("p.rep").alias("p_rep"), F.col("p.n").alias("p_n"), F.col("p.share").alias("p_share"), F.col("p.comp").alias("p_comp"))
    met = at.join(pivot, "value").where((F.col("comp") != F.col("p_comp")) & _possible("", "p_"))
    met = met.groupBy("rep", "p_rep").agg(F.count("*").alias("both"))
    best = met.groupBy("rep").agg(F.max(F.struct("both", "p_rep")).alias("p"))
    return best.select(F.least("rep", F.col("p.p_rep")).alias("a"), F.greatest("rep", F.col("p.p_rep")).alias("b")).distinct()


def _pivots(at: DataFrame, most: int, done: DataFrame | None) -> DataFrame:
    """rep of up to `most` classes of each list that are outside its largest component and not done."""
    sizes = at.groupBy("value", "comp").count()
    main = sizes.groupBy("value").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("value", "main")
    outside = at.join(main, "value").where("comp <> main")
    if done is not None:
        outside = outside.join(small(done), "rep", "left_anti")
    bucket = F.pmod(F.xxhash64("rep", F.lit(most)), F.lit(most))
    chosen = outside.groupBy("value", bucket.alias("bucket")).agg(F.max_by("rep", F.struct(F.col("share") / F.col("n"), F.col("rep"))).alias("rep"))
    return materialise(chosen.select("rep").distinct(), "pivots")


def _pivot_pairs(at: DataFrame, now: DataFrame, done: DataFrame | None, traits: DataFrame) -> DataFrame:
    """The pairs (a, b) of a pivot and a class of another component that share enough listed values, each once, from its first
    list. Classes that are done have met all others."""
    if done is not None:
        at = at.join(small(done), "rep", "left_anti")
    held = at.join(traits.select("rep", "bits"), "rep").join(small(now).withColumn("is_pivot", F.lit(True)), "rep", "left").withColumn("step", _step(F.col("n")))
    # the sizes that a pivot's size and share allow, with one to spare at either end for rounding
    n, share = F.col("n"), F.col("share")
    low, high = F.floor(n * PERCENT / 100) - 1, F.least(n * 100 / PERCENT, share * (100 + PERCENT) / PERCENT - n) + 1
    chosen = held.where("is_pivot").withColumn("step", F.explode(F.sequence(_step(F.greatest(low, F.lit(1))), _step(F.greatest(high, low, F.lit(1))))))
    chosen = chosen.select(*(F.col(c).alias(f"p_{c}") for c in ("value", "rep", "n", "share", "comp", "enough", "values", "bits", "step")))
    both = F.array_intersect("values", "p_values")
    first = (F.array_min(both) == F.col("value")) & (F.size(both) >= F.least("enough", "p_enough"))
    met = held.join(chosen, (F.col("value") == F.col("p_value")) & (F.col("step") == F.col("p_step")) & (F.col("comp") != F.col("p_comp")) & (F.col("is_pivot").isNull() | (F.col("rep") < F.col("p_rep"))) & _possible("", "p_") & _near() & first)
    return met.select(F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b"))


def _merge(pairs: DataFrame, state: DataFrame, sketched: DataFrame, sets: DataFrame) -> tuple[DataFrame, bool]:
    """The components after these pairs, and whether any has changed."""
    pairs = materialise(pairs, "pairs")
    ends = _ends(pairs)
    close = materialise(_estimate(pairs, _among(sketched, "rep", ends)), "candidates")
    release(pairs, ends)
    links = verify(close, sets)
    some = not links.isEmpty()
    if some:
        state = _components(state, links)
    release(close, links)
    return state, some


def _sets(docs: DataFrame, named: DataFrame) -> DataFrame:
    """rep, full (its sorted shingle hashes), bits (its parity bitmap) of the classes in named (rep, doc_id, mark). Of a doc_id's texts, those of the class."""
    texts = _among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", named.select("doc_id"))
    held = texts.join(small(named), "doc_id")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, A_BATCH):
                part = batch.slice(at, A_BATCH)
                rows, full, bits = [], [], []
                for i, (s, m) in enumerate(zip(shingle_sets(part.column("text")), part.column("mark").to_pylist(), strict=True)):
                    if blake2b(s.tobytes(), digest_size=16).digest() == m:
                        rows.append(i)
                        full.append(s)
                        bits.append(np.packbits(np.bincount(K.mix(s.view(np.uint64)) & np.uint64(64 * BITMAP - 1), minlength=64 * BITMAP) & 1).view(np.int64))
                ends = np.cumsum([0, *map(len, full)]).astype(np.int32)
                flat = pa.array(np.concatenate(full) if full else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([b.tolist() for b in bits], pa.list_(pa.int64()))], names=["rep", "full", "bits"])

    sets = materialise(held.select("rep", "text", "mark").mapInArrow(pick, "rep long, full array<long>, bits array<long>"), "sets")
    if sets.groupBy("rep").count().where("count > 1").isEmpty():
        return sets
    once = materialise(sets.dropDuplicates(["rep"]), "sets")
    release(sets)
    return once


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the smallest of their own text's component; of repeated rows
    with an id, each. Rows of null doc_id come after all others: of those in a component that no other row keeps, one stays.
    Texts without words link with nothing, so all such rows stay."""
    id_, key = (_free(docs, x) for x in ("_id", "_key"))
    of = F.col("doc_id").cast("long")
    ends = docs.agg(F.min(of).alias("least"), F.max(of).alias("most"), F.count("*").alias("n"), F.count(of).alias("named")).first()
    nameless = ends["n"] > ends["named"]
    if nameless:  # ids made of the texts, above all others; below them where no room is left
        least, most = (ends["least"], ends["most"]) if ends["named"] else (0, 0)
        at = F.pmod(F.xxhash64("text"), F.lit(1 << 62))
        made = F.lit(most + 1) + at if most < (1 << 62) else F.lit(max(least - 1, -(1 << 63))) - F.pmod(at, F.lit(min(1 << 62, max(1, least + (1 << 63)))))
        of = F.coalesce(of, made)
    held = docs.withColumns({id_: of, key: _key()})
    linked = _by_row(held.select(F.col(id_).alias("doc_id"), "text"))
    gone = materialise(linked.where(~F.col("kept")).select(F.col("doc_id").alias(id_ + "k"), F.col("key").alias(key + "k")).distinct(), "dropped")
    out = held.join(small(gone), (F.col(id_) == F.col(id_ + "k")) & (F.col(key) == F.col(key + "k")), "left_anti")
    if nameless:
        worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        one = out.where(F.col("doc_id").isNull() & worded)
        rest = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
        number = _free(docs, "_number")
        one = one.withColumn(number, F.row_number().over(Window.partitionBy(id_, key).orderBy(F.xxhash64(*rest)))).where(F.col(number) == 1).drop(number)
        out = out.where(F.col("doc_id").isNotNull() | ~worded).unionByName(one)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def _free(docs: DataFrame, name: str) -> str:
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    return name
