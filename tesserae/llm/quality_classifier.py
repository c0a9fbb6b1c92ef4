"""Quality scores by voting of the nearest labelled documents in a latent semantic space.

A text is a bag of terms that say how it is written rather than what about: shapes of words
and of word pairs, and how often words, word windows and lines come again. Term weights times
inverse document frequency, projected on the leading singular directions of the labelled
sample, give a short vector. For every document the exact cosines with all labelled vectors
are computed block by block, and the labels of the nearest vote, weighted by similarity and
by how thinly their class was sampled.

The labelled sample is bounded: about ``PER_CLASS`` rows of each label, chosen by a hash of
the row. Only its vectors reach the driver and are sent to the tasks; their size is fixed
(``2 * PER_CLASS`` x ``DIMENSIONS``). Labels, languages, sources and ids are no features.

Defined cases: a null text counts as empty; a text without words has no direction and scores
the share of good labels, as does everything when there are no labelled rows (0.5 without
labels at all); texts are used whole; equal texts get equal scores; an empty table gives an
empty table; ``doc_id`` may be null or repeat (one text of each labelled id is learned from); ids
labelled both ways are left out; of equally similar neighbours at the edge of the vote any are
taken; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import texts
from tesserae.llm.language_id import sample

#: Hashed terms, of which the first are the fixed ones about repetition.
TERMS = 1024
DIMENSIONS = 48
#: Labelled rows of each class, about.
PER_CLASS = 1500
NEIGHBOURS = 25
#: Votes weigh similarity to this power.
SHARPNESS = 8
#: A document is predicted good from this score on (fixed value).
GOOD_FROM = 0.3
#: Documents whose similarities with all labelled vectors are held at a time.
BLOCK = 256


def _shape_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[97:123] = 97
    table[128:] = 97
    table[65:91] = 65
    table[48:58] = 48
    return table


_SHAPE = _shape_table()
_FIXED = 6


def _shapes(part: texts.Texts, words: texts.Spans) -> np.ndarray:
    """Hash of every word's shape: letters, capitals and digits as one sign each, runs as one."""
    kind = _SHAPE[part.data]
    kept = np.ones(len(kind), dtype=bool)
    kept[1:] = kind[1:] != kind[:-1]
    kept[words.start] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    short = texts.Texts(kind[kept], part.offsets, 0)
    return texts.hashes(short, texts.Spans(place[words.start], place[words.end], words.row))


def terms(part: texts.Texts) -> np.ndarray:
    """Square roots of term shares, one row per text."""
    n = part.count
    words = texts.words(part)
    value = texts.hashes(part, words)
    shape = _shapes(part, words)
    row = words.row
    counts = np.zeros((n, TERMS))

    def add(rows: np.ndarray, hashed: np.ndarray) -> None:
        slot = _FIXED + (hashed % np.uint64(TERMS - _FIXED)).astype(np.int64)
        np.add(counts, np.bincount(rows * TERMS + slot, minlength=n * TERMS).reshape(n, TERMS), out=counts)

    add(row, shape)
    at, pair = texts.windows(row, shape, 2)
    add(row[at], pair)
    total = np.bincount(row, minlength=n)
    distinct, _, _, _ = texts.tally(row, value)
    counts[:, 0] = total - np.bincount(distinct, minlength=n)
    stays = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
    counts[:, 1] = np.bincount(row[1:][stays], minlength=n)
    at, window = texts.windows(row, value, 3)
    distinct, _, _, _ = texts.tally(row[at], window)
    counts[:, 2] = np.bincount(row[at], minlength=n) - np.bincount(distinct, minlength=n)
    lines = texts.lines(part)
    distinct, _, _, _ = texts.tally(lines.row, texts.hashes(part, lines))
    of_line = total / np.maximum(np.bincount(lines.row, minlength=n), 1)
    counts[:, 3] = (np.bincount(lines.row, minlength=n) - np.bincount(distinct, minlength=n)) * of_line
    counts[:, 4] = part.per_text(_SHAPE[part.data] == 65) / 3
    size = np.diff(part.offsets)
    counts[:, 5] = part.per_text((_SHAPE[part.data] != 97) & (_SHAPE[part.data] != 65) & ~texts._SPACE[part.data])
    return np.sqrt(counts / np.maximum(total, 1)[:, None]) * (size > 0)[:, None]


@dataclass
class Model:
    project: np.ndarray  # term x dimension, with the inverse document frequencies
    vectors: np.ndarray  # labelled row x dimension, of length 1
    labels: np.ndarray
    weights: np.ndarray  # how many rows of the corpus each labelled row stands for
    share: float


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def fit_matrix(x: np.ndarray, labels: np.ndarray, sizes: dict[int, int]) -> Model:
    """``x``: term weights of the labelled sample; ``sizes``: labelled rows of each class in all."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    # Directions of the largest variance of the terms, from their second moments.
    scaled = unit(x * idf)
    _, directions = np.linalg.eigh(scaled.T @ scaled)
    project = idf[:, None] * directions[:, ::-1][:, :DIMENSIONS]
    sampled = np.bincount(labels, minlength=2)
    weights = np.array([sizes.get(c, 0) / max(sampled[c], 1) for c in (0, 1)])
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    vectors = unit(x @ project).astype(np.float32)
    return Model(project.astype(np.float32), vectors, labels.astype(np.float32), weights[labels].astype(np.float32), share)


def vote(model: Model, x: np.ndarray) -> np.ndarray:
    """Score of every row of term weights."""
    found = unit(x.astype(np.float32) @ model.project)
    cosine = found @ model.vectors.T
    near = min(NEIGHBOURS, cosine.shape[1])
    pick = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
    weight = np.maximum(np.take_along_axis(cosine, pick, axis=1), 0) ** SHARPNESS * model.weights[pick]
    total = weight.sum(1)
    score = (weight * model.labels[pick]).sum(1) / np.where(total > 0, total, 1)
    return np.where(total > 0, score, model.share)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """Fit on the documents that ``labels`` (``key``, ``label``) gives 0 or 1.

    The sample is drawn from the labels, so only its few keys are sent to the documents.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    # One row per document; contradicting labels say nothing.
    usable = usable.groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("_other"))
    usable = usable.filter(F.col(label) == F.col("_other")).drop("_other")
    sizes = {row[label]: row["count"] for row in usable.groupBy(label).count().collect()}
    # Keys occur once, so a share of their hashes is a bound.
    drawn = sample(usable, PER_CLASS, 2 * PER_CLASS, label, [key], 2)
    rows = docs.select(key, F.col(f"`{text}`").alias("text")).join(F.broadcast(drawn), key)
    # Of documents that repeat a key, the one with the least hash of its text.
    first = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text")))
    rows = rows.groupBy(key, label).agg(first.alias("one")).select(label, F.col("one.text").alias("text"))
    found = texts.map_texts(
        rows, "text", [label], "vector binary", lambda part: {"vector": [v.tobytes() for v in terms(part).astype(np.float32)]}
    ).toPandas()
    if found.empty:
        return None
    found = found.sort_values([label, "vector"])
    x = np.stack([np.frombuffer(v, dtype=np.float32) for v in found["vector"]])
    return fit_matrix(x, found[label].to_numpy(dtype=int), sizes)


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted``."""
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: texts.Texts) -> dict:
        scores = []
        for first in range(0, part.count, BLOCK):
            last = min(first + BLOCK, part.count)
            at = part.offsets[first : last + 1]
            block = texts.Texts(part.data[at[0] : at[-1]], at - at[0], first)
            scores.append(vote(shared.value, terms(block)))
        score = np.clip(np.concatenate(scores).astype(float), 0, 1)
        return {"score": score, "predicted": (score >= GOOD_FROM).astype(np.int32)}

    return texts.map_texts(docs, text, keep, "score double, predicted int", work)
