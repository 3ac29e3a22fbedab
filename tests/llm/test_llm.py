"""The training-data operators against brute force, on planted and awkward rows."""

import collections
import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import ann, decontaminate, langid, licenses, linededup, mixing, neardup, queries, sharding, substrings, tokens
from feedloom.llm.store import materialise, new_path

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folded(x):
    return WORD.findall((x or "").translate(FOLD))


def spaced(x):
    return [w for w in re.split(r"[ \t-\r]+", x or "") if w]


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def docs(spark):
    """Plain, empty, null, tiny, periodic, repeated, near and shared texts; a repeated row; a null id."""
    passage, base = prose(1, 70), prose(2, 200)
    near = base.split()
    near[100] = "changed"
    texts = [
        prose(3, 120), "", None, "one", "a " * 300, "a b " * 200, base, base, " ".join(near), prose(4, 40) + " " + passage + " " + prose(5, 30),
        passage + "\n" + prose(6, 10), prose(7, 50) + "\t" + passage, "!!! ???", "Released under the MIT License. " + prose(8, 20), "É é ß 12 x_y", "Ünter " * 3 + "die der und " * 30,
        prose(9, 4000, 50), " ".join(near[:150]), "the Apache\nlicense, mit LICENSE gnu general public license",
    ]
    rows = [(10 * i + 3, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], (None, prose(3, 120), None, None, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(docs):
    return docs.where("false")


# --- decontamination


def leaks(rows, bench, n=10):
    win = collections.defaultdict(set)
    for i, t in bench:
        w = folded(t)
        for k in range(max(0, len(w) - n) + 1 if w else 0):
            win[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in rows:
        w, hit, got = folded(t), set(), set()
        for m in {len(k) for k in win}:
            for p in range(len(w) - m + 1):
                if (k := tuple(w[p : p + m])) in win:
                    hit |= set(range(p, p + m))
                    got |= {str(x) for x in win[k] if x is not None}
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return collections.Counter(out)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontaminate(spark, docs, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    items = [(1, prose(1, 70).upper()), (2, "one"), (3, None), (2, ""), (None, prose(7, 50)), (5, "É é ß")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = decontaminate.report(docs, bench)
    assert collections.Counter(map(tuple, got.collect())) == leaks(rows, items)
    clean = decontaminate.scrub(docs, bench)
    bad = {k[0] for k in leaks(rows, items) if k[5]}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - bad and clean.columns == docs.columns
    spans = {r["doc_id"]: r["text"] for r in decontaminate.scrub(docs, bench, remove="spans").collect()}
    assert folded(spans[33]) == [] and spans[13] == "" and spans[23] is None
    assert decontaminate.report(empty(docs), bench).count() == 0
    assert decontaminate.report(docs, bench.where("false")).where("contaminated").count() == 0


# --- sharding


def test_shards(spark, docs, tmp_path):
    got = sharding.shard(docs, 3, map_path=f"file://{tmp_path}/map").collect()
    assert len(got) == docs.count() and {r["law"] for r in got} == {"bytes"}
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        t = text[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode()))
    assert sharding.shard(empty(docs)).count() == 0


def test_shards_of_repeated_rows(spark):
    """4,000 equal rows, and a third of null ids with null texts, are dealt over all shards."""
    rows = [(7, "same text")] * 4000 + [(None, None)] * 2000 + [(i, prose(i, 5)) for i in range(100)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    load = collections.Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(got) == len(rows) and len(load) == 8 and max(load.values()) <= 1.05 * min(load.values())
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_a_map_lives(spark, tmp_path):
    """The map is the plain greedy one of the slots' sums; runs over the same rows keep it; more rows and shards edit it."""
    path = f"file://{tmp_path}/map"
    rows = [(i, prose(i, 5 + i % 50)) for i in range(3000)] + [(-1, prose(1, 4000))] * 60 + [(None, None)] * 900
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).cache()
    got = sharding.shard(docs, 6, map_path=path).collect()
    sums = collections.Counter()
    for r in got:
        sums[r["vslot"]] += r["size"]
    load, to = [0] * 6, {}
    for slot in sorted(sums, key=lambda s: (-sums[s], s)):
        to[slot] = load.index(min(load))
        load[to[slot]] += sums[slot]
    assert all(r["shard"] == to[r["vslot"]] for r in got) and max(load) <= 1.01 * min(load)
    at = lambda x: {(r["doc_id"], r["size"], r["vslot"]): r["shard"] for r in x}
    assert at(sharding.shard(docs, 6, map_path=path).collect()) == at(got) and sharding.latest(spark, path) == 0
    more = docs.union(spark.createDataFrame([(i, prose(i, 30)) for i in range(5000, 5300)], docs.schema))
    for version, (table, shards) in enumerate([(more, 6), (docs, 7), (docs, 5)], 1):
        now = sharding.shard(table, shards, map_path=path).collect()
        load = collections.Counter()
        for r in now:
            load[r["shard"]] += r["size"]
        assert sharding.latest(spark, path) == version and set(load) == set(range(shards)) and max(load.values()) <= 1.03 * min(load.values())
    for _ in range(2):
        assert sharding.shard(docs.limit(0), 6, map_path=f"{path}-of-none").count() == 0


def test_one_row_over_a_hundred_shards(spark):
    """Rows that are all equal are dealt evenly over more shards than a slot's usual parts."""
    docs = spark.createDataFrame([(7, "same text")] * 60_000, "doc_id long, text string").repartition(3)
    load = {r["shard"]: r["count"] for r in sharding.shard(docs, 100).groupBy("shard").count().collect()}
    assert len(load) == 100 and sum(load.values()) == 60_000 and max(load.values()) <= 1.1 * min(load.values())


def test_rebalance_moves_little(spark):
    sizes = spark.range(512).selectExpr("cast(id as int) as vslot", "100 + id % 7 as bytes")
    old = sharding.plan(sizes, 8).cache()
    new = {r["vslot"]: r["shard"] for r in sharding.rebalance(sizes, old, 9).collect()}
    was = {r["vslot"]: r["shard"] for r in old.collect()}
    load = collections.Counter()
    for r in sizes.collect():
        load[new[r["vslot"]]] += r["bytes"]
    moved = [k for k in new if new[k] != was[k]]
    assert len(new) == 512 and set(load) == set(range(9)) and max(load.values()) < 1.05 * min(load.values())
    assert sum(new[k] == 8 for k in moved) >= 0.9 * len(moved) and len(moved) < 512 / 9 * 1.2


# --- language


def test_language(spark, docs, sf_dir):
    got = queries.op4_language_id(spark, sf_dir).join(queries.read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    out = {(r["doc_id"], r["text"]): r for r in langid.identify(docs).collect()}
    assert out[(23, None)]["lang_pred"] == out[(13, "")]["lang_pred"] == out[(123, "!!! ???")]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.identify(empty(docs)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang is null")).collect()} == {"und"}


def test_sample_is_filled_beside_long_texts(spark):
    order = [r["id"] for r in spark.range(100).orderBy(F.xxhash64(F.col("id").cast("string"))).collect()]
    for place in (0, 1, 2):
        for size in (100_000, 59_000):
            rows = [(i, prose(i, 200) if i != order[place] else "z" * size, "en") for i in order] + [(1000, "long only " * 9000, "de"), (1001, "", "fr")]
            held = spark.createDataFrame(rows, "doc_id long, text string, lang string")
            got = langid.sample(held, bytes_per_lang=60_000)
            texts = dict(rows_[:2] for rows_ in rows)
            whole = {t for t in texts.values() if len(t) <= 6000}
            used = [len(t) for t in got["en"]]
            assert sum(used) <= 60_000 and sum(used) > 54_000 and set(got["en"]) <= whole and set(got) == {"en", "de"}
            assert got["de"] == ["long only " * 150]
    short = langid.sample(held.where("doc_id < 100").limit(20), bytes_per_lang=60_000)["en"]
    assert len(short) == 20


def test_sample_by_steps(spark):
    """The first rows by length and hash, whatever the partitions; equal rows count as often as they stand, null ids too."""
    rows = [(i, prose(i, 4 + i % 9), "en" if i % 3 else "de") for i in range(900)] + [(None, "same words", "fr")] * 40 + [(7, "again", "de")] * 5 + [(3, None, "de"), (4, "123", "de"), (5, "no label", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    h = {r["doc_id"]: r["h"] for r in frame.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).distinct().collect()}
    for parts in (1, 7, 40):
        got = langid.sample(frame.repartition(parts), docs_per_lang=30)
        assert {k: len(v) for k, v in got.items()} == {"en": 30, "de": 30, "fr": 30} and set(got["fr"]) == {"same words"}
        en = sorted((h[i], i, t) for i, t, lang in rows if lang == "en")[:30]
        assert sorted(got["en"]) == sorted(t for _, _, t in en)


def test_code_lengths():
    model = langid.train({"a": ["abab abab", "abba"], "b": ["xyz xyz zyx"]})
    counts = [collections.defaultdict(collections.Counter) for _ in range(2)]
    for c, ts in zip(counts, (["abab abab", "abba"], ["xyz xyz zyx"]), strict=True):
        for t in ts:
            raw = t.encode()
            for i, b in enumerate(raw):
                for k in range(langid.ORDER + 1):
                    c[(k, (b"\0" * k + raw[:i])[-k:] if k else b"")][b] += 1

    def cost(c, text):
        raw, total = text.encode(), 0.0
        for i, b in enumerate(raw):
            for k in range(langid.ORDER, -1, -1):
                seen = c[(k, (b"\0" * k + raw[:i])[-k:] if k else b"")]
                if seen:
                    n = sum(seen.values()) + len(seen)
                    if b in seen:
                        total -= np.log2(seen[b] / n)
                        break
                    total -= np.log2(len(seen) / n)
            else:
                total += 8
        return total

    import pyarrow as pa

    from feedloom.llm import kernels

    texts = ["abab", "xyz ab", "", "qqq", "ba ab xy zz"]
    got = model.lengths(*kernels.utf8(pa.array(texts)))
    want = [[cost(c, t) for c in counts] for t in texts]
    assert np.allclose(got, want, atol=1e-3)


# --- neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 12))
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [0.0] * 12), (1020, None), (1040, [float("nan")] * 12), (1060, [1.0]), (None, x[0].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    for q in range(0, 400, 20):
        s = (x * x[q]).sum(axis=1)
        want = [j for j in np.lexsort((np.arange(400), -s)) if j != q][:20]
        mine = [r for r in got if r["query_id"] == q]
        assert [r["vec_id"] for r in mine] == want and np.allclose([r["score"] for r in mine], s[want])
    assert len(got) == 400
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 12))
    ids = np.arange(600)
    ids[200:400] = 7  # a third of the rows, different vectors
    ids[400:430] = 11
    x[400:430] = x[11]
    ids[430:450] = 20  # a query of 21 rows
    x[450:480], ids[450:480] = x[60] + 1e-3 * x[450:480], 61
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for t in (table, table.union(table)):
        got = ann.search(t).collect()
        for q in {int(i) for i in ids if i % 20 == 0}:
            s = (x @ x[ids == q].T).max(axis=1)
            top = {int(i): s[ids == i].max() for i in ids if i != q}
            want = sorted(top, key=lambda i: (-top[i], i))[:20]
            mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
            assert [r["vec_id"] for r in mine] == want and np.allclose([r["score"] for r in mine], [top[i] for i in want])
    mixed = spark.createDataFrame([(0, [1.0, 2.0]), *((i, [1.0, float(i), 2.0]) for i in range(1, 61))], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["rank"]) for r in ann.search(mixed).collect()) == [(q, k) for q in (20, 40, 60) for k in range(1, 21)]
    few = spark.createDataFrame([(0, [1.0, 0.0])] + [(1, [1.0, 0.1 * k]) for k in range(1, 40)] + [(i, [0.5, 0.01 * i]) for i in range(2, 22)], "vec_id long, embedding array<double>")
    assert len({r["vec_id"] for r in ann.search(few).where("query_id = 0").collect()}) == 20


def test_hilbert_is_a_curve():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    at = np.argsort(ann.hilbert(cells, 3))
    assert len(set(ann.hilbert(cells, 3).tolist())) == 512
    assert (np.abs(np.diff(cells[at], axis=0)).sum(axis=1) == 1).all()


# --- near duplicates


def near(rows):
    sets = []
    for i, t in rows:
        w = spaced((t or "").translate(FOLD))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    label = {i: i for i, _ in sets}
    moved = True
    while moved:
        moved = False
        for i, x in sets:
            for j, y in sets:
                if x and y and 100 * len(x & y) >= 75 * len(x | y) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    return {i: (len(s), label[i]) for i, s in sets}


@pytest.mark.parametrize("pivots", [neardup.PIVOTS, 64])
def test_near_duplicates(spark, docs, pivots, monkeypatch):
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    held = docs.where("doc_id is not null")
    extra = []
    base = prose(20, 150).split()
    for k in range(12):
        w = list(base)
        for j in range(k):
            w[7 * j] = f"edit{k}-{j}"
        extra.append((1000 + k, " ".join(w), "en", "s1", 1))
    held = held.union(spark.createDataFrame(extra, DOCS))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.components(held).collect()}
    assert got == near({(r["doc_id"], r["text"]) for r in held.collect()})
    kept = neardup.keep_one(held)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c} and kept.columns == held.columns
    assert neardup.components(empty(docs)).count() == 0
    assert neardup.components(docs).where("doc_id is null").first()["kept"] is False


def test_near_duplicates_in_large_groups(spark):
    """Chains, subgroups and members just short of the threshold, all sharing one text's shingles; one class is a third of all rows."""
    rng, rows = np.random.default_rng(5), []
    base = prose(60, 100).split()
    for k in range(160):
        w = list(base)
        for j in rng.choice(100, rng.integers(1, 9), replace=False):
            w[j] = f"e{k}-{j}" if k % 3 else f"e{k // 12}-{j}"
        rows.append((k, " ".join(w)))
    for k in range(40):  # each a few words on from the one before it
        rows.append((1000 + k, " ".join((base + prose(61, 200).split())[4 * k : 4 * k + 90])))
    rows += [(2000 + k, rows[17][1]) for k in range(100)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = near(rows)
    assert got == want and 5 < len({c for _, c in want.values()}) < 200


def test_keep_one_decides_by_row(spark):
    a, b, c, d = (prose(300 + k, 120) for k in range(4))
    near_b = b.replace(b.split()[60], "changed", 1)
    rows = [
        (None, a, "x"), (None, a, "y"), (None, a.upper(), "z"), (None, None, "x"), (None, None, "x"), (None, "", "x"), (None, "", "x"),  # one of a's, all the empty ones
        (3, b, "x"), (5, near_b, "x"), (5, c, "x"), (5, c, "y"), (None, near_b, "x"), (None, c, "x"), (6, c, "x"),  # 5 stays with c only
        (8, None, "x"), (None, d, "x"), (None, d + " more", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [tuple(r) for r in neardup.keep_one(docs).collect()]
    assert sum(r[0] is None and (r[1] or "").lower() == a for r in got) == 1
    assert sum(r[0] is None and not r[1] for r in got) == 4
    assert sorted(r for r in got if r[0] is not None and r[1] is not None) == [(3, b, "x"), (5, c, "x"), (5, c, "y")]
    assert (8, None, "x") in got and sum((r[1] or "").startswith(d) for r in got) == 1 and len(got) == 10
    named = neardup.keep_one(docs.where("doc_id is not null"))
    assert named.count() == 4 and named.columns == docs.columns
    top = spark.createDataFrame([((1 << 63) - 1, a, "x"), (None, b, "x"), (None, a, "x")], docs.schema)
    assert sorted(r["text"] for r in neardup.keep_one(top).collect()) == sorted([a, b])


# --- tokens


def test_tokens(spark, docs):
    path = new_path(spark, "test-shards")
    written = new_path(spark, "test-docs")
    docs.write.parquet(written)
    rows = tokens.write(spark.read.parquet(written), path, length=64, shard_bytes=128 * 10).orderBy("slot").collect()
    n = len(rows)
    assert [r["slot"] for r in rows] == list(range(n)) and sorted(r["sequence"] for r in rows) == list(range(n)) and len({r["shard"] for r in rows}) == -(-n // 10)
    ids = tokens.read_slots(path, 0, n, 64, 128 * 10)
    assert [zlib.crc32(x.tobytes()) for x in ids] == [r["crc32"] for r in rows]
    by = {r["sequence"]: ids[r["slot"]][: r["n_tokens"]] for r in rows}
    stream = np.concatenate([by[k] for k in range(n)]).tolist()
    encode = tokens.encoder(tokens.ranks(tokens.VOCABULARY))
    parts = collections.Counter()
    at = 0
    for k, t in enumerate(stream):
        if t == tokens.END:
            parts[tuple(stream[at:k])] += 1
            at = k + 1
    assert parts == collections.Counter(tuple(encode(r["text"] or "")) for r in docs.collect())


def test_a_path_used_before_holds_the_last_run(spark):
    path, frame = new_path(spark, "test-shards"), lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    texts = [f"some words of number {i} and more of them" for i in range(60)]
    tokens.write(frame(texts), path, length=16, shard_bytes=32 * 4).count()
    rows = tokens.write(frame([t.replace("some", "other") for t in texts[:20]]), path, length=16, shard_bytes=32 * 4)
    for _ in range(2):  # asked for again, rows and files stay the same
        found = rows.orderBy("slot").collect()
        ids = tokens.read_slots(path, 0, len(found), 16, 32 * 4)
        assert [zlib.crc32(x.tobytes()) for x in ids] == [r["crc32"] for r in found]
    files = sorted(p.name for p in Path(path.removeprefix("file://")).iterdir() if not p.name.startswith("."))
    assert files == [f"shard-{i:06d}.bin" for i in range(-(-len(found) // 4))]
    assert tokens.write(frame([]), path, length=16).count() == 0 and not list(Path(path.removeprefix("file://")).glob("shard-*"))


def test_permutation():
    for n in (1, 2, 5, 64, 1000, 4097):
        assert sorted(tokens.permute(np.arange(n), n).tolist()) == list(range(n))


def test_segments():
    table = tokens.ranks(tokens.VOCABULARY)
    tokenizer, encode = tokens.Tokenizer(table), tokens.encoder(table)
    import pyarrow as pa

    from feedloom.llm import kernels

    texts = ["a  b", " lead", "trail ", "tab\t x\n\n y", "nbsp  x  y", "don't  stop", "é è  z", "12 34  5", "", "x \n y", "日本 語 a", "end \n"]
    want = [t for x in texts for t in [*encode(x), tokens.END]]
    assert tokenizer(*kernels.utf8(pa.array(texts))).tolist() == want


# --- licences


def test_licences(docs):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    phrases = [(p.split(), label) for p, label in licenses.PHRASES]
    for r in docs.collect():
        w = folded(r["text"])
        at = [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (g["first_word"], g["last_word"]) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
    assert got[133]["labels"] == "mit" and got[183]["base_labels"] == "apache,gpl,mit"
    assert licenses.scan(empty(docs)).count() == 0


def test_licence_chain():
    text = dict((t[:20], t) for _, t in licenses.TEMPLATES)["permission is hereby"].split()
    text[9] = "other"
    found = licenses.spans("x y " + " ".join(text), licenses.Automaton())
    assert [(f[0], f[1], f[2]) for f in found] == [("mit", 2, 2 + len(text))]


def test_licence_clause_told_twice(spark):
    """A template that repeats a clause: both places are chained; spans tell where, equal rows and other columns included."""
    clause, template = "the above copyright notice must be kept", "one two three four the above copyright notice must be kept five six seven eight the above copyright notice must be kept nine"
    automaton = licenses.Automaton((("twice", template),), ())
    text = f"x one two three four y {clause} z five six seven eight w {clause} nine v"
    assert licenses.spans(text, automaton) == [("twice", 1, 27, 1.0)]
    for state, held in enumerate(automaton.ends):
        for places in held.values():
            assert places == sorted(set(places)) and (state == 0 or places)
    long = dict((len(t), t) for k, t in licenses.TEMPLATES if k == "bsd")
    texts = [f"Some words. {long[max(long)]}. The MIT license", "", None, "filler " * 200_000 + long[max(long)]]
    rows = spark.createDataFrame([(1, t, "x") for t in texts + texts[:1]], "doc_id long, text string, spans string")
    got = sorted((r["spans"], r["labels"], r["score"]) for r in licenses.scan(rows).collect())
    n = len(long[max(long)].split())
    assert [g[1] for g in got] == ["", "", "bsd", "bsd,mit", "bsd,mit"]
    assert f"bsd:2:{2 + n}" in got[-1][0] and f"mit:{3 + n}:{5 + n}" in got[-1][0] and got[-1] == got[-2] and f"bsd:200000:{200_000 + n}" in got[2][0]


# --- mixing


def test_mixing(spark, docs):
    got = mixing.report(docs).collect()
    assert len(got) == docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["size"] == len(spaced(text[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.report(docs).collect()), key=repr)
    assert mixing.report(empty(docs)).count() == 0
    assert sum(r["n"] for r in mixing.emit(docs).groupBy().agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()) == sum(r["taken"] // r["size"] for r in got if r["size"]) + sum(0 for r in got) + mixing.mix(docs).where("size = 0").selectExpr("coalesce(sum(copies), 0) c").first()["c"]


def test_mixing_keeps_other_columns(spark, docs):
    held = docs.select("*", *(F.lit(c).alias(c) for c in ("_key", "_b", "_h", "_own", "_row", "_base")))
    got = mixing.mix(held)
    assert got.columns == [*held.columns, "size", "source_size", "target", "copies"]
    assert {tuple(r) for r in got.select("_key", "_b", "_h", "_own", "_row", "_base").collect()} == {("_key", "_b", "_h", "_own", "_row", "_base")}
    assert mixing.emit(held).columns == held.columns


def test_targets(spark):
    sizes = {"a": 100, "b": 10, "c": 40, "d": 0, "e": 3}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip("abcde", (1, 2, 3, 1, 2), strict=True))
    want, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            want[s] += left * weight[s] / total
        left = sum(max(0, want[s] - 3 * sizes[s]) for s in sizes)
        for s in sizes:
            if want[s] >= 3 * sizes[s]:
                want[s] = 3.0 * sizes[s]
                open_.discard(s)
    assert got == pytest.approx(want)


# --- repeated windows


def repeated(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        w, gone = spaced(t), set()
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            if first.setdefault(k, i) < i:
                gone |= set(range(p, p + 50))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_repeated_windows(docs):
    held = docs.where("doc_id is not null")
    got = substrings.remove(held).collect()
    want = repeated({(r["doc_id"], r["text"] or "") for r in held.collect()})
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want and len(got) == held.count()
    assert sum(w[1] > 0 for w in want.values()) >= 4
    assert substrings.remove(empty(docs)).count() == 0
    assert substrings.remove(docs).where("doc_id is null").first()["n_removed"] == 120


def test_windows_share_anchors():
    from feedloom.llm import kernels

    rng = np.random.default_rng(4)
    for vocabulary in (2, 3, 50):
        body = kernels.mix(rng.integers(0, vocabulary, 90).astype(np.uint64) + np.uint64(7))
        got = []
        for seed in range(6):
            r = np.random.default_rng(seed)
            a, b = (kernels.mix(r.integers(0, vocabulary, r.integers(0, 60)).astype(np.uint64) + np.uint64(7)) for _ in range(2))
            hashes = np.concatenate([a, body, b])
            got.append(substrings.anchors(hashes, np.array([0, len(hashes)]))[len(a) : len(a) + 41])
        assert all((g == got[0]).all() for g in got)


# --- lines


def lines_left(rows):
    """By brute force: the rows' lines that are in no run of two lines and more that an earlier place holds."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256((rows[i][1] or "").encode()).digest()[:16]))
    seen, out = {}, [None] * len(rows)
    for i in order:
        lines = rows[i][1].split("\n") if rows[i][1] is not None else []
        gone = set()
        for p in range(len(lines) - 1):
            first = seen.setdefault(tuple(lines[p : p + 2]), (i, p))
            if first[0] != i or first[1] + 1 < p:
                gone |= {p, p + 1}
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone) if rows[i][1] is not None else None
        out[i] = (rows[i][0], kept, len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest() if kept is not None else None)
    return collections.Counter(out)


def test_planted_passages_go_whole(spark):
    rows = []
    for n in range(2, 22):
        passage = [prose(1000 * n + k, 6) for k in range(n)]
        for copy in range(2):
            before, after = ([prose(50_000 + 1000 * n + 100 * copy + 10 * side + k, 5) for k in range(3)] for side in range(2))
            rows.append((100 * n + copy, "\n".join([*before, *passage, *after])))
    got = {r["doc_id"]: r["n_removed"] for r in linededup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 100 if i % 100 else 0 for i, _ in rows}


@pytest.mark.parametrize("hot", [linededup.HOT, 1])
def test_lines_by_row(spark, hot, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", hot)
    a, b = "one\ntwo\nthree", "x\none\ntwo\ny\none\ntwo\n"
    rows = [
        (1, b), (2, a), (2, a), (2, "four\n" + a), (3, None), (4, ""), (4, "lone"), (None, "new\nlines"), (None, "new\nlines"), (None, a), (None, None), (None, "own\n\ntext"),
        (5, "r\nr\nr"), (6, "s\ns\ns\ns"), (7, "r\nr"), (8, "two\nthree\none"), (9, "\n\n\n\n"), (9, "\n\n\n\n"), (10, "dä\nß\r\nz"), (11, "q\ndä\nß\r"),
    ]
    got = linededup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed", "kept_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == lines_left(rows)


def test_chunks_move_with_their_lines():
    lines = [prose(i, 4).encode() for i in range(400)]
    runs = lambda x: {linededup.run_bytes(x, *c) for c in linededup.chunks(x)}
    whole, moved = runs(lines), runs([b"one line more", *lines[:200], b"and another", *lines[200:]])
    assert 60 < len(whole) < 160 and len(whole - moved) <= 4
    for x in (lines, [b"same"] * 50, [b"", b""]):
        found = linededup.chunks(x)
        assert found[0][0] == 0 and found[-1][1] == len(x) - 1 and all(a < b for a, b in found) and all(p[1] == q[0] for p, q in zip(found, found[1:]))
    assert linededup.chunks([]) == linededup.chunks([b"lone"]) == []


def test_names_shared_by_different_lines(spark, monkeypatch):
    """Names of one byte say nothing: the bytes under them are compared, and longer names are taken."""
    rows = [(i, "\n".join(prose(7 * (i % 40) + k, 3) for k in range(9))) for i in range(80)]
    held = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(linededup, "NAMES", (1, 16))
    assert collections.Counter(map(tuple, linededup.remove(held).collect())) == lines_left(rows)
    monkeypatch.setattr(linededup, "NAMES", (1,))
    with pytest.raises(ValueError):
        linededup.remove(held)


def test_lines_of_equal_rows_and_long_texts(spark):
    """A third of the rows equal, a third null, one text of more than four megabytes, other columns of clashing names."""
    long = "\n".join(prose(i, 18) for i in range(60_000))
    rows = [(1, "a\nb\nc")] * 500 + [(None, None)] * 500 + [(i, f"own {i}\na\nb\nend {i}") for i in range(2, 500)] + [(600, long), (601, "x\n" + long)]
    held = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS mark", "2 AS later", "3 AS spots", "4 AS _id").repartition(5)
    assert len(long) > 4 << 20 and collections.Counter(map(tuple, linededup.remove(held).collect())) == lines_left(rows)


def test_lines_of_a_table(spark, docs, sf_dir):
    held = queries.read(spark, sf_dir, "documents").select("doc_id", "text")
    for t in (held, held.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.floor(F.col("doc_id") / 4))), docs):
        assert collections.Counter(map(tuple, linededup.remove(t).collect())) == lines_left([(r["doc_id"], r["text"]) for r in t.collect()])
    assert linededup.remove(empty(docs)).count() == 0


# --- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs, columns = queries.read(spark, sf_dir, "documents"), None
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        path = new_path(spark, "test-stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    last = P.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() > 0 and P.run(spark, sf_dir).count() == last.count()


@pytest.mark.parametrize("rare", [neardup.RARE, 6])
def test_large_group_is_not_compared_in_all_pairs(spark, monkeypatch, rare):
    """Members outside a group's largest component meet by their rare shingles, not by lists that every member is in."""
    monkeypatch.setattr(neardup, "RARE", rare)
    listed, pivots = [], neardup._pivots
    monkeypatch.setattr(neardup, "_pivots", lambda at, *rest: listed.append(at.count()) or pivots(at, *rest))
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"x{rng.integers(3)}" if rng.random() < p else w for w in words)) for i, p in enumerate(rng.uniform(0.005, 0.1, 60))]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows]
    label = list(range(60))
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < 60
    assert listed[0] == 0 or rare == 6


def test_first_stage_keeps_other_columns(spark, sf_dir):
    import corpus_pipeline as P

    docs = queries.read(spark, sf_dir, "documents").limit(60).selectExpr("*", "'mine' AS _lang_pred", "'too' AS _LANG_SCORE", "7 AS _lang_bits_")
    found = P.language(spark, docs, sf_dir)
    rows = found.collect()
    assert found.columns == docs.columns and rows and {(r["_lang_pred"], r["_LANG_SCORE"], r["_lang_bits_"]) for r in rows} == {("mine", "too", 7)}


def _shuffled(spark):
    """Bytes that the executors have written for shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    held = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))


def test_only_what_pairs_need_is_dealt_out(spark, monkeypatch):
    """Texts of classes that may have a partner, and sets of classes in pairs, also where tables are too large to be broadcast."""
    monkeypatch.setattr(neardup, "small", lambda table: table)
    rng = np.random.default_rng(12)
    texts = [" ".join(map(str, rng.integers(10**9, 10**10, 2000))) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts), (150, texts[7] + " and more"), (None, texts[8])], "doc_id long, text string")
    named = materialise(neardup.sketches(docs).where("doc_id IN (7, 150)").select(F.xxhash64("mark").alias("rep"), "doc_id", "mark"), "named")
    full = spark.createDataFrame([(i, rng.integers(-(1 << 62), 1 << 62, 2000).tolist()) for i in range(100)], "rep long, full array<long>")
    full = materialise(full.union(full.where("rep = 5").select(F.lit(200).cast("long"), "full")), "full")
    pairs = materialise(spark.createDataFrame([(5, 200), (4, 200)], "a long, b long"), "pairs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        assert neardup._sets(docs, named).count() == 2
        between = _shuffled(spark)
        assert [tuple(r) for r in neardup.verify(pairs, full).collect()] == [(5, 200)]
        assert between - before < sum(map(len, texts)) / 4 and _shuffled(spark) - between < 100 * 2000 * 8 / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filter_keeps_all_that_is_named(spark):
    table = spark.range(-2000, 2000).union(spark.createDataFrame([(None,)], "id long"))
    few = neardup._among(table, "id", spark.range(-3000, 2000, 40).withColumnRenamed("id", "rep"))
    found = {r["id"] for r in few.collect()}
    assert found >= set(range(-2000, 2000, 40)) and len(found) < 500
    assert neardup._among(table, "id", spark.range(0)).isEmpty()
