"""Merkle manifest, personal data and whitening against versions in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from feedloom.llm import merkle, pii, whitening

DOC = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root of a list of digests, and each one's siblings by level as (side, digest) or None."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            other = p ^ 1
            paths[i].append(None if other >= len(level) else ("l" if p & 1 else "r", level[other]))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [p >> 1 for p in at]
    return level[0] if level else None, paths


def fold(node, path):
    for s in path:
        node = h(node) if s is None else h(s[1], node) if s[0] == "l" else h(node, s[1])
    return node


def manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    held = {g: sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in groups[g]), key=lambda x: x[:3]) for g in names}
    trees = {g: climb([x[2] for x in held[g]]) for g in names}
    root, outer = climb([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, outer):
        for (_, _, digest, r), path in zip(held[g], trees[g][1]):
            path = path + above
            probe = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            folded = fold(leaf((*r[:3], r[3] + 1, r[4])) if probe else digest, path)
            out.append((r[0], digest, trees[g][0], root, h(*(s[1] for s in path if s)), folded, folded == root))
    return sorted(out, key=repr)


def reported(spark, rows, **kw):
    found = merkle.report(spark.createDataFrame(rows, DOC).select(*merkle.FIELDS), **kw).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found), key=repr)


def doc(i, lang="en", text=None, n=5):
    return (i, f"s{i % 3}" if i is not None else None, lang, n, f"text {i}" if text is None else text)


@pytest.mark.parametrize("rows", [
    [doc(1)], [doc(1), doc(2, "de")], [doc(i, "en" if i % 3 else "fr") for i in range(17)],
    [doc(i, [None, "", "é", "z", "en"][i % 5]) for i in range(40)],
    [doc(5)] * 9 + [doc(None), doc(None, None, "", None), doc(7, None, "x" * 3_000_000, 2**63 - 1), (8, None, None, None, None), doc(8, "en", "ä")],
], ids=["one", "two groups", "odd", "null and empty groups", "repeated, null, long"])
def test_merkle_small(spark, rows):
    assert reported(spark, rows) == manifest(rows)


def test_merkle_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FEW", 3)  # joins are shuffled
    rows = [doc(i, "en" if i % 8 else "fr") for i in range(150)]
    random.Random(1).shuffle(rows)
    assert reported(spark, rows, levels=2) == manifest(rows)


def test_merkle_full_blocks(spark):
    rows = [doc(i) for i in range(1500)] + [doc(i, "de") for i in range(1024)] + [doc(i, "fr") for i in range(1025)]
    assert reported(spark, rows) == manifest(rows)


def test_merkle_empty_table(spark):
    assert reported(spark, []) == []


def test_merkle_detects_changes(spark):
    rows = [doc(i) for i in range(30)]
    whole = reported(spark, rows)
    for other in (rows[:-1], rows + [doc(30)], rows[:4] + [doc(4, text="changed")] + rows[5:]):
        assert reported(spark, other)[0][3] != whole[0][3]
    assert all(v == (zlib.crc32(str(i).encode()) % 7 != 0) for i, *_, v in whole)


# --- personal data -------------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(2)
    pieces = ["a@b.c", "@", ".", "1", "255", "256", "0255", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 555-0100", "+", "-", " ", "x", "é", "a.b%", "@b.c", "..", "5-5", "(", "\n", "12345678901234567890"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        assert pii.base_spans(text) == plain(text), text


def test_search_of_long_hostile_texts_ends():
    for text in ("a" * 3_000_000, "@" * 1_000_000, "a@" * 500_000, "1" * 3_000_000, "1." * 1_000_000, "1 " * 1_000_000, "+1" * 500_000, "+1 " + " " * 3_000_000, "a-" * 1_000_000):
        pii.candidates(text, pii.base_spans(text))


def test_context_finds_unseen_identifiers(spark):
    rows = [(i, f"Words before. Passenger phone: +1 555 010 {1000 + i} and the rest of {i} words") for i in range(12)]
    unseen = "Some other words. Passenger phone: 555 0199 77 and so on"
    rows += [(100, unseen), (101, "it costs 12345678 coins"), (102, "see 555 0199 77 there"), (103, None), (104, ""), (100, unseen)]
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    at = unseen.index("555")
    assert [r.spans for r in by[100]] == [f"phone:{at}:{at + 11}"] * 2 and [r.n_phone for r in by[100]] == [0, 0]
    assert by[102][0].spans == "phone:4:15" and by[101][0].spans == "" and by[103][0].spans == "" == by[104][0].spans
    for r in by[3]:
        spans = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain(rows[3][1]))
        assert r.spans == spans and r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and r.n_phone == 1


def test_second_round_uses_values_found_in_the_first(spark):
    rows = [(i, f"my passenger phone: +1 555 010 {1000 + i}") for i in range(12)]
    found = [f"44{i}7{i}01" for i in range(6)]
    rows += [(20 + i, f"my passenger phone: {v}") for i, v in enumerate(found)]
    rows += [(40 + i, f"ring her under {v}") for i, v in enumerate(found)] + [(60, "ring her under 9090909"), (61, "ring 9090908")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    added = {r.doc_id: r.n_added for r in pii.report(docs).collect()}
    assert added[25] == added[45] == added[60] == 1 and added[61] == 0 and added[0] == 0
    once = {r.doc_id: len(r.added) for r in pii.detect(docs, rounds=1).collect()}
    assert once[45] == 1 and once[60] == 0


def test_mixed_contexts_and_copies_find_nothing(spark):
    mixed = [f"of the +1 555 010 {i:04}" for i in range(6)] + [f"of the 10.0.0.{i}" for i in range(6)] + ["of the 7777777"]
    copies = ["call me +1 555 010 9999"] * 50 + ["call me 8888888"]
    docs = spark.createDataFrame(list(enumerate(mixed + copies)), "doc_id long, text string")
    assert {r.n_added for r in pii.report(docs).collect()} == {0}


def test_pii_on_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: plain(r.text or "") for r in docs.collect()}
    for r in pii.report(docs).collect():
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want[r.doc_id]) for i in range(4)]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_pii_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- whitening -----------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def whitened(vectors, top=4):
    """By the covariance and its eigenvectors."""
    x = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    listed = np.unique(x, axis=0)
    n, sums = len(listed), listed.sum(axis=0)
    c = listed - sums / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    w = (x - sums / n) @ v[:, :top] / np.sqrt(e[:top])
    dev = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, dev, w, e[:top] / e.sum()


def check(found, ids, vectors):
    n, dev, w, share = whitened(vectors)
    got = {(r.vec_id, r.component): r for r in found}
    assert len(got) == len(found) == w.size
    for k in range(w.shape[1]):
        mine = np.array([got[i, k + 1].whitened for i in ids])
        sign = np.sign(mine @ w[:, k])
        assert np.allclose(mine, sign * w[:, k], atol=1e-9, rtol=1e-9)
        for j, i in enumerate(ids):
            r = got[i, k + 1]
            assert r.n == n and r.deviation == dev[j] and abs(r.explained / share[k] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_against_eigenvectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = table.orderBy("vec_id").collect()
    check(whitening.whiten(table.repartition(7)).collect(), [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float32))


def test_whitening_of_many_partitions_and_hot_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((900, 12)) * np.linspace(3, 0.2, 12) + 5).astype(np.float32)
    x[300:600] = x[7]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS).repartition(40)
    monkeypatch.setattr(whitening, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(whitening.whiten(table).collect(), list(range(900)), x)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_merged_states_lose_no_dimension():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (500, 16))
    parts = [whitening.decomposed(p) for p in np.array_split(x, 9)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whitening.merged(whole, p)
    c = x - x.mean(axis=0)
    assert np.allclose((whole.vectors.T * whole.values**2) @ whole.vectors, c.T @ c, rtol=1e-12, atol=1e-6) and len(whole.values) == 16


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (2, [-1.0, 4.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [0.0, -0.0]), (9, [2.0]), (10, [1e30, 1e30])]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (8, 1), (8, 2), (9, 1), (10, 1), (10, 2)]
    assert {r.n for r in got if r.vec_id != 9} == {5} and {r.deviation for r in got if r.vec_id == 10} == {None}
    [alone] = [r for r in got if r.vec_id == 9]
    assert (alone.n, alone.deviation, alone.whitened, alone.explained, alone.identity_error) == (1, 0, None, None, None)


def test_whitening_of_flat_lists(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(got) == 30 and got[3, 1].whitened is not None and got[3, 2].whitened is None and abs(got[3, 1].explained - 1) < 1e-9 and got[3, 1].identity_error < 1e-9
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
