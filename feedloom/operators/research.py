"""The research loop: a question is searched, then the sub-queries that a planner names, in rounds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyword_index import KeywordIndex


@dataclass(frozen=True)
class Mode:
    rounds: int
    branches: int
    per_query: int
    final: int


#: The presets' rounds, sub-queries a round, items a query, items at the end.
MODES = {"balanced": Mode(3, 2, 12, 24), "deep": Mode(6, 3, 14, 36)}


@dataclass(frozen=True)
class Plan:
    queries: list[str]
    stop: bool = False


def first_and_last_words(question: str, tried: list[str]) -> Plan:
    """The planner without a model: a question's first three words, and of six and more its last three."""
    words = [w.strip(" ?.,:;!").lower() for w in question.split()]
    found = [" ".join(words[:3])] if len(words) >= 3 else []
    found += [" ".join(words[-3:])] if len(words) >= 6 else []
    return Plan(list(dict.fromkeys(q for q in found if q)))


def research(index: KeywordIndex, items: DataFrame, questions: dict[str, str], since: Column, mode: str | Mode = "balanced", planner: Callable[[str, list[str]], Plan] = first_and_last_words, least_gain: int = 0) -> DataFrame:
    """question, id, rank from 0: the items found for each question, in the order in which they were found.

    All sub-queries of a round, of all questions, are one plan; the questions and their queries are the driver's, the items
    never are. A question ends when its planner stops or names nothing new, after the mode's rounds, or, with `least_gain`,
    after a round that found fewer new items."""
    m = MODES[mode] if isinstance(mode, str) else mode
    among = items.where((F.col("published_at") >= since) & ~F.coalesce("is_duplicate", F.lit(False))).select("id", "published_at")
    tried = {q: [text] for q, text in questions.items()}
    found: list[DataFrame] = []
    now = {(q, 0): text for q, text in questions.items()}
    for turn in range(m.rounds + 1):
        if not now:
            break
        part = index.search_many({f"{n}:{q}": text for (q, n), text in now.items()}, m.per_query, among)
        number, question = F.split_part("query", F.lit(":"), F.lit(1)).cast("int"), F.regexp_replace("query", "^[0-9]+:", "")
        found.append(part.select(question.alias("question"), "id", F.struct(F.lit(turn).alias("turn"), number.alias("n"), "rank").alias("place")))
        open_ = set(questions)
        if least_gain and turn:
            gained = found[-1].select("question", "id").distinct().join(reduce(DataFrame.unionByName, found[:-1]).select("question", "id"), ["question", "id"], "left_anti").groupBy("question").count()
            open_ = {r["question"] for r in gained.where(F.col("count") >= least_gain).collect()}  # questions, not items
        now = {}
        for q in open_ if turn < m.rounds else ():
            plan = planner(questions[q], tried[q])
            new = [] if plan.stop else [s.strip() for s in plan.queries if s.strip() and s.strip() not in tried[q]][: m.branches]
            tried[q] += new
            now |= {(q, n): text for n, text in enumerate(new)}
    every = reduce(DataFrame.unionByName, found).groupBy("question", "id").agg(F.min("place").alias("place"))
    ranked = every.withColumn("rank", (F.row_number().over(Window.partitionBy("question").orderBy("place")) - 1).cast("long"))
    return ranked.where(F.col("rank") < m.final).select("question", "id", "rank")


def judged(evidence: DataFrame, names: list[str]) -> DataFrame:
    """question, name, score, winner of variants (question, name, items, queries) by how broad their evidence is: up to five
    points; the best variant wins, `tie` if the two best have as many points and items."""
    score = F.least(F.lit(5), F.greatest(F.lit(1), 1 + F.least(F.lit(3), F.floor(F.col("items") / 4)) + F.least(F.lit(1), F.greatest(F.lit(0), F.col("queries") - 1)))).cast("int")
    held = evidence.where(F.col("name").isin(*names)).withColumn("score", score)
    by = held.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("score", "items", "name")), asc=False).alias("all"))  # a few variants
    first, second = F.get("all", F.lit(0)), F.get("all", F.lit(1))
    tie = second.isNotNull() & (first["score"] == second["score"]) & (first["items"] == second["items"])
    return held.select("question", "name", "score").join(by.select("question", F.when(tie, "tie").otherwise(first["name"]).alias("winner")), "question")

