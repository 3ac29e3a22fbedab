"""Models as functions that callers may replace; the defaults are deterministic and need no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import col

#: Frequent small words that tell languages apart.
SMALL_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "ein", "zu", "von"),
    "en": ("the", "and", "of", "to", "is", "that", "with", "for", "are", "this"),
    "es": ("el", "los", "que", "por", "con", "una", "del", "para", "las", "es"),
    "fr": ("le", "les", "et", "des", "est", "une", "dans", "pour", "que", "qui"),
}


def hashed_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors of hashed words."""
    import zlib

    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1 if h & 0x10000 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def overlap_score(query: str, texts: list[str]) -> list[float]:
    """Share of the query's words that a text holds: stands for a cross-encoder."""
    q = set(query.lower().split())
    return [len(q & set((t or "").lower().split())) / max(1, len(q)) for t in texts]


@dataclass(frozen=True)
class Providers:
    embed: Callable[[list[str]], np.ndarray] | None = hashed_embedding
    cross: Callable[[str, list[str]], list[float]] | None = overlap_score
    spam: Callable[[], Callable[[list[str]], list[float]]] | None = None
    analyse: Callable[[str], str] | None = None
    options: dict = field(default_factory=dict)


def embedding(text: Column | str, providers: Providers = Providers()) -> Column:
    embed = providers.embed

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(list(embed(s.fillna("").tolist()).astype("float32")))

    return run(col(text))


_LOADED: dict[str, object] = {}


def loaded(load: Callable[[], object]) -> object:
    """What a loader gives, loaded once a worker; None if it cannot be loaded."""
    name = f"{load.__module__}.{load.__qualname__}"
    if name not in _LOADED:
        try:
            _LOADED[name] = load()
        except Exception:  # a worker without the model does without it
            _LOADED[name] = None
    return _LOADED[name]


def pair_score(query: Column | str, text: Column | str, cross: Callable[[str, list[str]], list[float]]) -> Column:
    """The model's score of each query and text, in batches by query; null where the model fails."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            out = pd.Series(np.nan, index=q.index)
            for one, at in q.groupby(q).groups.items():
                try:
                    out.loc[at] = cross(one, t.loc[at].fillna("").tolist())
                except Exception:  # scores of a failing model count as missing
                    continue
            yield out

    return F.nanvl(run(col(query), col(text)), F.lit(None))


def similarity(query: Column | str, text: Column | str, embed: Callable[[list[str]], np.ndarray]) -> Column:
    """Inner product of the embeddings of a query and a text; null where the model fails. A query is embedded once a batch."""

    def cross(q: str, texts: list[str]) -> list[float]:
        found = embed([q, *texts])
        return (found[1:] @ found[0]).tolist()

    return pair_score(query, text, cross)


def spam_flag(text: Column | str, load: Callable[[], Callable[[list[str]], list[float]]] | None, threshold: float = 0.8) -> Column:
    """Whether the model that `load` gives, loaded once a worker, calls the first 512 characters spam; false without a model."""
    if load is None:
        return F.lit(False)

    @F.pandas_udf("boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(load)
        for s in parts:
            try:
                yield pd.Series([p >= threshold for p in model(s.fillna("").str.slice(0, 512).tolist())], dtype=bool)
            except Exception:  # a missing or failing model flags nothing
                yield pd.Series([False] * len(s), dtype=bool)

    return run(col(text))


def language(text: Column | str) -> Column:
    """The language with most of its small words in the first 500 characters; en for short texts and ties at none."""
    words = F.regexp_extract_all(F.lower(F.substring(col(text), 1, 500)), F.lit(r"[\p{L}]+"), F.lit(0))
    vote = lambda small: F.size(F.filter(words, lambda w: w.isin(*small)))
    votes = [F.struct(vote(small).alias("n"), F.lit(code).alias("code")) for code, small in sorted(SMALL_WORDS.items())]
    best = F.array_max(F.array(*votes))
    return F.when((F.length(F.trim(col(text))) < 10) | (best["n"] == 0), "en").otherwise(best["code"])
