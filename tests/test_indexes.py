"""Indexes, stems, loops, batches and state against plain versions and SQLite's full-text search."""

import json
import re
import sqlite3
import sys
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F

from feedloom.functions import spam as S
from feedloom.functions import stemming
from feedloom.operators import analysis, keyword_index, preference, research, versions
from feedloom.operators import retrieval as R
from feedloom.operators.keyword_index import KeywordIndex, phrases
from feedloom.operators.vector_index import VectorIndex
from feedloom.providers import Providers, embedding, loaded, spam_flag
from feedloom.session import new_folder
from feedloom.streaming import flows

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests

PAPER = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope formalize formal electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit
replacement replac adoption adopt communism commun effective effect probate probat rate rate cease ceas controll control roll roll""".split()


def fts(rows):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, content, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, a or "", b or "") for i, a, b in rows])
    return db


def fts_search(db, query, k):
    found = db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (" ".join(f'"{w}"' for w in re.findall(r"\w+", query)),)).fetchall()
    return [(int(i), round(r, 6)) for i, r in sorted(((i, round(s, 12)) for i, s in found), key=lambda x: (x[1], int(x[0])))[:k]]


def test_stems_are_those_of_the_paper():
    assert [stemming.stem(w) for w in PAPER[::2]] == PAPER[1::2]


def test_stems_are_those_of_sqlite(spark, sf_dir):
    found = sorted({w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() for w in stemming.words(r.text or "")})
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(found)))
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    terms = {}
    for term, doc, at in db.execute("SELECT term, doc, offset FROM v"):
        terms.setdefault(doc, []).append((at, term))
    assert len(found) > 1000 and [(w, terms[i]) for i, w in enumerate(found) if [t for _, t in sorted(terms[i])] != [stemming.stem(w)]] == []


def test_phrases_of_a_query():
    assert phrases("Running a_b, café?") == [["run"], ["a", "b"], ["cafe"]] and phrases("?! _") == []


ITEMS = "id long, title string, content string"


def test_search_ranks_as_sqlite_does(spark, sf_dir):
    rows = [(r.doc_id, (r.text or "").split("\n")[0][:80], r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    db, index = fts(rows), KeywordIndex(spark, new_folder(spark), buckets=8, spread=2)
    index.build(spark.createDataFrame(rows, ITEMS))
    asked = {"two": "this from", "one": "die", "phrase": "of_the", "doubled": "the the", "inflected": "things", "nothing": "zzzzzz the"}
    found = index.search_many(asked, 50).collect()
    for name, text in asked.items():
        mine, want = sorted((r for r in found if r["query"] == name), key=lambda r: r["rank"]), fts_search(db, text, 50)
        assert [r.id for r in mine] == [i for i, _ in want] and [r.score for r in mine] == pytest.approx([x for _, x in want], abs=2e-6), name


def test_index_reads_only_the_buckets_of_the_terms(spark):
    index = KeywordIndex(spark, new_folder(spark), buckets=16)
    index.build(spark.createDataFrame([(i, f"word{i}", "common text") for i in range(50)], ITEMS))
    plan = index.rows(["word7"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan or "EqualTo(term" in plan
    files = index.rows(["word7"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len(files) == 1


def test_index_changes(spark):
    path = new_folder(spark)
    index = KeywordIndex(spark, path, buckets=4, spread=2)
    frame = lambda rows: spark.createDataFrame(rows, ITEMS)
    ids = lambda q: [r.id for r in index.search(q, 10).orderBy("rank").collect()]
    index.build(frame([(1, "red fox", None), (2, None, "red dog"), (None, "red", "red"), (3, "", "")]))
    assert ids("red") == [1, 2] and index.items().count() == 3
    index.append(frame([(2, "never seen", "red red"), (4, "red bird", "x")]))
    assert ids("red") == [1, 2, 4] and ids("never") == []
    index.upsert(frame([(2, "blue", "dog"), (5, "Red-Car", "")]))
    assert ids("red") == [1, 5, 4] and ids("blue") == [2]
    index.delete(frame([(1, "", "")]).select("id"))
    assert ids("red") == [5, 4] and ids("fox") == []
    index.upsert(frame([(1, "fox again", "")]))
    assert ids("fox") == [1]
    before = index.rows().select("id", "term").orderBy("id", "term").collect()
    index.compact()
    assert index.rows().select("id", "term").orderBy("id", "term").collect() == before and len(index.manifest().segments) == 1
    index.append(frame([(1, "no", "news")]))
    assert ids("news") == [] and index.manifest()["items"] == 5
    index.build(frame([]))
    assert ids("red") == [] and index.manifest()["items"] == 0


def test_a_version_is_committed_once(spark):
    path = new_folder(spark)
    versions.commit(spark, path, 0, {"x": 1}, "x int")
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, 0, {"x": 2}, "x int")
    assert versions.latest(spark, path).x == 1 and versions.committed(spark, path) == [0]


AT = datetime(2024, 1, 31)


def dated(spark, rows):
    """Items (id, hours before AT, is_duplicate)."""
    return spark.createDataFrame([(i, f"title {i}", f"content of {i}", AT - timedelta(hours=h), dup) for i, h, dup in rows], "id long, title string, content string, published_at timestamp_ntz, is_duplicate boolean")


def test_vector_index_life(spark):
    index = VectorIndex(spark, new_folder(spark), most=3)
    first = [(i, i, i == 2) for i in range(10)] + [(99, 400, False), (None, 1, False)]
    assert index.ensure_fresh(dated(spark, first), AT) == "rebuilt" and index.manifest()["items"] == 9
    assert index.ensure_fresh(dated(spark, first + [(20, 0, False)]), AT + timedelta(seconds=599)) == "fresh"
    later = AT + timedelta(seconds=600)
    assert index.ensure_fresh(dated(spark, first), later) == "unchanged" and index.manifest().built_at == later
    index.invalidate()
    assert index.ensure_fresh(dated(spark, first + [(20, 0, False)]), later) == "appended"
    again = VectorIndex(spark, new_folder(spark))
    again.ensure_fresh(dated(spark, first + [(20, 0, False)]), later)
    rows = lambda x: [(r.id, tuple(r.embedding)) for r in x.vectors().orderBy("id").collect()]
    assert rows(index) == rows(again) and len(rows(index)) == 10
    assert index.ensure_fresh(dated(spark, first + [(30 + i, 0, False) for i in range(4)]), later + timedelta(hours=1)) == "rebuilt"
    assert [r.id for r in index.search("title 33 content of 33", 1).collect()] == [33]
    empty = VectorIndex(spark, new_folder(spark))
    assert empty.ensure_fresh(dated(spark, []), AT) == "rebuilt" and empty.vectors().count() == 0


def fails(*_):
    raise RuntimeError("no model")


def ranked(spark, providers, **kw):
    rows = [("q", i, i, f"t{i}", None, "alpha " * i, 5.0, AT, 0.5, "src9") for i in range(6)] + [("other", 7, 0, "x", "y", "z", None, AT, 0.1, "src1")]
    held = spark.createDataFrame(rows, "query string, id long, ord int, title string, summary string, content string, relevance double, published_at timestamp_ntz, raw_score double, source string")
    authority = spark.createDataFrame([("SRC1", 0.9)], "source string, weight double")
    found = R.rank_by_query(held, authority, F.lit(AT).cast("timestamp_ntz"), providers, **kw).where("query = 'q'").orderBy("rank").collect()
    return [r.id for r in found]


def length_embedding(texts):
    return np.array([[len(t), 1.0] for t in texts])


def shortest(query, texts):
    return [-len(t) for t in texts]


def test_rank_by_query_and_its_fallbacks(spark):
    assert ranked(spark, Providers(embed=length_embedding, cross=None)) == [5, 4, 3, 2, 1, 0]
    assert ranked(spark, Providers(embed=length_embedding, cross=shortest), depth=3) == [3, 4, 5, 2, 1, 0]
    assert ranked(spark, Providers(embed=length_embedding, cross=fails), depth=3) == [5, 4, 3, 2, 1, 0]
    assert ranked(spark, Providers(embed=None)) == ranked(spark, Providers(embed=fails, cross=None)) == [0, 1, 2, 3, 4, 5]
    assert ranked(spark, Providers(embed=length_embedding, cross=None), top=2) == [5, 4]


def test_embedding_is_of_unit_length(spark):
    [row] = spark.createDataFrame([("some words here",)], "t string").select(embedding("t").alias("e")).collect()
    assert abs(np.linalg.norm(row.e) - 1) < 1e-6


def two_letters():
    return lambda texts: [1.0 if "zz" in t else 0.0 for t in texts]


def broken():
    raise OSError("no such model")


def test_model_step_of_the_funnel(spark):
    posts = [(1, 0, "plain", 9), (2, 1, "zz", 9), (3, 2, "zz", 0), (4, 3, "plain", 9), (1, 4, "again", 9), (2, 5, "calm", 9), (2, 6, "zz", 9), (5, 7, "x" * 600 + "zz", 9), (6, 8, "dm me for signals zz", 9)]
    held = spark.createDataFrame([(*p, 0, AT) for p in posts], "id long, ord long, text string, likes long, reposts long, published_at timestamp_ntz")
    at, seen = F.lit(AT).cast("timestamp_ntz"), spark.createDataFrame([(4,), (4,)], "id long")
    told, counts = S.counted(S.funnel(held, at, seen=seen, flag=spam_flag("text", two_letters)), "test")
    steps = {r["ord"]: r["dropped"] for r in told.collect()}
    assert steps == {0: "none", 1: "model", 2: "engagement", 3: "seen", 4: "seen", 5: "none", 6: "seen", 7: "none", 8: "spam"}
    assert {k: v for k, v in counts.get.items() if v} == {"none": 3, "model": 1, "engagement": 1, "seen": 3, "spam": 1}
    assert {r.f for r in held.select(spam_flag("text", broken).alias("f")).collect()} == {False} == {r.f for r in held.select(spam_flag("text", None).alias("f")).collect()}


def test_a_model_is_loaded_once():
    calls = []

    def load():
        calls.append(1)
        return "model"

    assert loaded(load) == loaded(load) == "model" and calls == [1]


def plan_of(question, tried):
    return research.Plan([f"{question} {len(tried)}", "gamma"], stop=len(tried) > 3)


def test_research_loop(spark):
    rows = [(i, "alpha" if i < 3 else "beta gamma" if i < 5 else "gamma", "", AT - timedelta(hours=i), i == 2) for i in range(8)]
    held = spark.createDataFrame(rows, "id long, title string, content string, published_at timestamp_ntz, is_duplicate boolean")
    index = KeywordIndex(spark, new_folder(spark), buckets=4)
    index.build(held)
    since = F.lit(AT - timedelta(hours=6)).cast("timestamp_ntz")
    run = lambda **kw: [(r.question, r.id) for r in research.research(index, held, {"a": "alpha", "b": "beta"}, since, research.Mode(3, 2, 10, 5), **kw).orderBy("question", "rank").collect()]
    assert run(planner=plan_of) == [("a", 0), ("a", 1), ("a", 5), ("a", 6), ("a", 3), ("b", 3), ("b", 4), ("b", 5), ("b", 6)]
    assert run() == [("a", 0), ("a", 1), ("b", 3), ("b", 4)]
    assert run(planner=plan_of, least_gain=99)[:3] == [("a", 0), ("a", 1), ("a", 5)]
    assert research.first_and_last_words("What is new in the world?", []).queries == ["what is new", "in the world"] and research.first_and_last_words("a b", []).queries == []


def test_judge_winner(spark):
    rows = [(1, "x", 8, 2), (1, "y", 20, 1), (2, "x", 4, 1), (2, "y", 4, 1), (3, "x", 0, 0)]
    found = research.judged(spark.createDataFrame(rows, "question int, name string, items int, queries int"), ["x", "y"]).collect()
    assert {(r.question, r["name"]): (r.score, r.winner) for r in found} == {(1, "x"): (4, "y"), (1, "y"): (4, "y"), (2, "x"): (2, "tie"), (2, "y"): (2, "tie"), (3, "x"): (1, "x")}


def answer(model, prompt):
    asked = json.loads(prompt)
    if model == "busy":
        raise analysis.RateLimited
    if model == "odd":
        return json.dumps([{"summary": "odd", "relevance_score": "n/a"}])
    return {"bad": "not json", "fails": None}.get(asked["topic"]) or json.dumps([{"summary": i["title"], "relevance_score": 7, "tags": ["x"]} for i in asked["items"]]) if asked["topic"] != "fails" else fails()


def unanalysed(spark, n, topic="t"):
    rows = [(i, f"title {i}", "c", "s", topic if i % 4 else "bad" if i % 8 else "fails", AT - timedelta(hours=i), None, i == 5, None, ["old"]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, content string, source string, topic string, fetched_at timestamp_ntz, summary string, is_duplicate boolean, relevance double, tags array<string>")


def test_backfill_rounds(spark):
    held, at = unanalysed(spark, 30), new_folder(spark)
    sizes = list(analysis.rounds(spark, held, at, ["good", "busy", "odd"], answer, size=12, batch=4))
    assert sizes == [12, 12, 5]
    found = {r.id: r for r in analysis.segments(spark, at).collect()}
    assert all(r.model in ("good", "odd") for r in found.values()) and 5 not in found and not any(i % 4 == 0 for i in found)
    first = [i for i in range(13) if i != 5 and i % 4][:9]  # the topic's items of the first round, newest first
    assert [found[i].model for i in first[:4]] == ["good"] * 4 and found[first[4]].model == "odd" and first[5] not in found and found[first[4]].relevance == 5.0
    after = {r.id: r for r in analysis.with_analyses(held, analysis.segments(spark, at)).collect()}
    assert after[1].summary == "title 1" and after[1].relevance == 7.0 and after[1].tags == ["x"] and after[4].summary is None and after[4].tags == ["old"] and len(after) == 30


def test_backfill_goes_on_where_it_was_cut_off(spark):
    held, at = unanalysed(spark, 20), new_folder(spark)
    turns = analysis.rounds(spark, held, at, ["good"], answer, size=8)
    assert next(turns) == 8
    assert list(analysis.rounds(spark, held, at, ["good"], answer, size=8)) == [8, 3]
    assert analysis.backfill(spark, held, at, ["good"], answer, size=8) == 0


def test_answers_are_parsed():
    assert analysis.parsed("```json\n[{}]\n```") == [{}] and analysis.parsed(" [] ") == [] and analysis.parsed("{}") is None is analysis.parsed("x") and analysis.parsed("[1]") is None


def test_streamed_preferences_compound(spark):
    top = new_folder(spark)
    held = spark.createDataFrame([Row(id=1, source="A", tags=["x"], entities=["e"]), Row(id=2, source="b", tags=["x", "y"], entities=[])], "id long, source string, tags array<string>, entities array<string>")
    schema = "item_id long, action string, read_seconds double, cycle long"
    parts = [[(1, "upvote", None, 3), (2, "click", None, 1)], [(1, "downvote", None, 2), (9, "upvote", None, 2)], [(2, "read", 200.0, 9), (2, "read", 1.0, 9)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{top}/in")
    stream = flows.watch(spark, f"{top}/in", schema, maxFilesPerTrigger=1)
    with flows.keyed_state(spark):
        flows.drain_batches(flows.preference_changes(stream, held, F.col("cycle")), flows.changes_to(f"{top}/out"), f"{top}/checkpoint")
        spark.createDataFrame([(2, "unupvote", None, 5)], schema).coalesce(1).write.mode("append").parquet(f"{top}/in")
        flows.drain_batches(flows.preference_changes(stream, held, F.col("cycle")), flows.changes_to(f"{top}/out"), f"{top}/checkpoint")
    acts = spark.createDataFrame([a for p in parts for a in p] + [(2, "unupvote", None, 5)], schema)
    rows = lambda df: sorted((r.dimension, r.value, r.score) for r in df.collect())
    want = rows(preference.compounded(acts, held, F.col("cycle"), 12))
    assert rows(flows.preferences_at(spark, f"{top}/out", 12)) == want and ("source", "a", 5.0 * 10 - 8.0 * 11) in want


def test_postings_are_made_in_pieces():
    """What a task holds is bounded by bytes of text, not by rows."""
    import pyarrow as pa

    from feedloom.operators import keyword_index as K

    text = "some words of a text " * 500
    batch = pa.RecordBatch.from_pydict({"id": list(range(100)), "title": [None] + ["t"] * 99, "content": [text * 100] + [text] * 98 + [None]})
    out = list(K._postings(iter([batch])))
    assert max(sum(map(len, b.column("positions").to_pylist())) for b in out[1:]) < K.PIECE // 2 and len(out) > 4 and out[0].column("id").unique().to_pylist() == [0]
    assert pa.Table.from_batches(out).column("id").unique().to_pylist() == list(range(100))


def test_backfill_runs_many_rounds_as_one_job(spark):
    held, at = unanalysed(spark, 200), new_folder(spark)
    assert list(analysis.rounds(spark, held, at, ["good"], answer, size=8)) == [8] * 24 + [7]
    now = analysis.versions.latest(spark, at)
    assert len(now.segments) == 5 and now.rounds == 25
    order = sorted(i for i in range(200) if i != 5)  # newest first
    assert {r.id: r.round for r in analysis.segments(spark, at).collect()} == {i: n // 8 for n, i in enumerate(order) if i % 4}


def test_postings_against_plain_loops_and_rules_by_table():
    """Postings as loops over words make them; words that no rule touches are not taken through every ending of every rule."""
    texts = [("Relational ties", "the ties of relational élan, hoping"), (None, "x x y"), ("", None), ("?", "vietnamization sensibiliti")]
    batch = pa.record_batch([pa.array([4, 9, 2, 7]), pa.array([t for t, _ in texts]), pa.array([c for _, c in texts])], names=["id", "title", "content"])
    plain = []
    for i, (title, content) in zip([4, 9, 2, 7], texts, strict=True):
        head, body = (stemming.words(x or "") for x in (title, content))
        held = {}
        for n, w in [*enumerate(head), *enumerate(body, len(head) + 1)]:
            held.setdefault(stemming.stem(w), []).append(n)
        plain += [(i, "", [], len(head) + len(body)), *((i, t, at, len(head) + len(body)) for t, at in held.items())]
    got = [(r["id"], r["term"] or "", r["positions"], r["length"]) for b in keyword_index._postings(iter([batch])) for r in b.to_pylist()]
    assert sorted(got) == sorted(plain)
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(arg.__name__) if event == "c_call" else None)
    try:
        assert stemming.stem("wxqzk") == "wxqzk"
    finally:
        sys.setprofile(None)
    assert calls.count("endswith") < 20
