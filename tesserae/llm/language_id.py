"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. One linear classifier per bit looks at hashed byte
n-grams of a text and predicts that bit; the language whose codeword loses least against all
predictions, each bit weighted by how often it was right in training, is the answer. When the
second best loses nearly as little, the answer is flagged as ambiguous.

The classifiers are fitted on a sample of labelled rows: about ``PER_LANGUAGE`` different rows
and at least one of every language, however many there are, chosen by a hash of the row, so the
sample does not depend on partitioning. At most ``SUM_TASKS`` tasks sum it up to normal equations
(features x features and features x bits), and only these reach the driver, with a count for each
language; the fitted matrix (features x bits) is sent to the tasks.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and not
ambiguous; texts are used whole; equal texts get equal answers; languages that are null are
not learned; without any labelled row everything is ``und``; an empty table gives an empty
table; ``doc_id`` may be null or repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import texts
from tesserae.session import broadcast_if_small, materialise

#: Size of the hashed n-gram space, and the orders of n-grams in bytes.
FEATURES = 4096
ORDERS = (1, 2, 3)
#: Rows of each language that are fitted on, about.
PER_LANGUAGE = 500
#: Tasks that sum up the sample, rows of it for each, rows of the sums in a piece, and rows taken at a time.
SUM_TASKS, SUM_ROWS, SUM_PIECE, SUM_STEP = 32, 2000, 128, 1000
#: Strength of the ridge penalty.
RIDGE = 1e-3
#: An answer with a lower score is flagged as ambiguous.
AMBIGUOUS_BELOW = 0.5
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Digits, punctuation and spaces all end a word the same way.
_LOWER[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32


def vectors(part: texts.Texts, features: int = FEATURES) -> np.ndarray:
    """Square roots of n-gram shares, scaled to length 1; one row per text."""
    data = _LOWER[part.data].astype(np.uint32)
    row = np.repeat(np.arange(part.count), np.diff(part.offsets))
    out = np.zeros(part.count * features, dtype=np.float32)
    code = np.zeros(len(data), dtype=np.uint32)
    for order in range(1, max(ORDERS) + 1):
        code = code[: len(data) - order + 1] * np.uint32(257) + data[order - 1 :] if order <= len(data) else code[:0]
        if order not in ORDERS or not len(code):
            continue
        n = len(code)
        inside = row[:n] == row[order - 1 :]
        spread = (code + np.uint32(order)) * np.uint32(2654435761)
        slot = (spread >> np.uint32(32 - int(features).bit_length() + 1)).astype(np.int64)
        found = np.bincount((row[:n] * features + slot)[inside], minlength=len(out)).astype(np.float32)
        out += found
    out = np.sqrt(out.reshape(part.count, features))
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(size, 1e-9)


def codewords(n: int) -> np.ndarray:
    """``n`` codewords of -1 and 1. Up to five languages use all splits in two, more use a seeded
    draw of splits that keeps the smallest distance between codewords large."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = [[1 if (m >> i) & 1 else -1 for i in range(n)] for m in range(1, 1 << (n - 1))]
        return np.array(splits).T
    random = np.random.default_rng(n)
    bits = max(16, 8 * int(np.ceil(np.log2(n))))
    best, far = None, -1
    for _ in range(50):
        code = np.where(random.random((n, bits)) < 0.5, -1, 1)
        near = int((bits - max(_overlap(code, first, bits) for first in range(0, n, 512))) // 2)
        if near > far:
            best, far = code, near
    return best


def _overlap(code: np.ndarray, first: int, bits: int) -> int:
    """The largest product of one of 512 codewords with another codeword."""
    block = code[first : first + 512].astype(np.float32)
    gram = block @ code.T.astype(np.float32)
    gram[np.arange(len(block)), first + np.arange(len(block))] -= 2 * bits
    return int(gram.max())


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # (features + 1) x bit
    trust: np.ndarray  # per bit


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, ambiguous) by the least weighted hinge loss against the codewords."""
    margin = x @ model.weights[:-1] + model.weights[-1]
    trust = model.trust / model.trust.sum()
    loss = np.stack([(np.maximum(0, 1 - margin * code) * trust).sum(1) for code in model.codes], axis=1)
    best = loss.argmin(1)
    near = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    score = 1 / near.sum(1)
    return best, score, score < AMBIGUOUS_BELOW


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sample(labelled: DataFrame, per_class: int, total: int, label: str, keys: list[str], most: int) -> DataFrame:
    """About ``per_class`` rows of each of the ``most`` commonest labels, ``total`` in all, by a hash of ``keys``."""
    sizes = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), label).limit(most).collect()
    per_class = min(per_class, total // max(1, len(sizes)))
    draw = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for s in sizes:
        share = F.when(F.col(label) == s[label], min(1.0, per_class / s["_n"])).otherwise(share)
    return labelled.filter(draw < share)


def _blocks(batches: Iterator[pa.RecordBatch], numbers: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features and a one, language numbers) of some rows of the sample at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, SUM_STEP):
            part = batch.slice(first, SUM_STEP)
            x = np.stack([np.frombuffer(v, dtype=np.float16) for v in part.column("vector").to_pylist()]).astype(np.float32)
            y = np.array([numbers[v] for v in part.column("lang").to_pylist()])
            yield np.hstack([x, np.ones((len(x), 1), dtype=np.float32)]), y


def solve(a: np.ndarray, b: np.ndarray, steps: int = 1000, apart: float = 1e-5) -> np.ndarray:
    """Columns of ``b`` solved by conjugate gradients; the ridge bounds the condition of ``a``."""
    x, r = np.zeros_like(b), b.copy()
    p, size = r.copy(), (r * r).sum(0)
    enough = apart**2 * np.maximum(size, 1e-30)
    for _ in range(steps):
        if (size <= enough).all():
            break
        ap = a @ p
        step = size / np.maximum((p * ap).sum(0), 1e-30)
        x, r = x + step * p, r - step * ap
        last, size = size, (r * r).sum(0)
        p = r + size / np.maximum(last, 1e-30) * p
    return x


def fit_sums(sample: DataFrame, sizes: dict[str, int]) -> Model:
    """One ridge-regression classifier per bit on (lang, vector); classes weigh the same whatever their size."""
    languages = sorted(sizes)
    numbers = {v: i for i, v in enumerate(languages)}
    codes = codewords(len(languages)).astype(np.float32)
    total = sum(sizes.values())
    balance = np.sqrt(total / (len(languages) * np.array([sizes[v] for v in languages]))).astype(np.float32)
    wide = FEATURES + 1 + codes.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for x, y in _blocks(batches, numbers):
            xb, tb = x * balance[y][:, None], codes[y] * balance[y][:, None]
            found = xb.T @ np.hstack([xb, tb])
            sums = found if sums is None else np.add(sums, found, out=sums)
        for piece in range(0, 0 if sums is None else len(sums), SUM_PIECE):
            part = [pa.array([piece], pa.int32()), pa.array([sums[piece : piece + SUM_PIECE].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(part, names=["piece", "sums"])

    def merge(rows):
        parts = sum(np.frombuffer(v, dtype=np.float32).astype(np.float64) for v in rows["sums"])
        return rows.iloc[:1].assign(sums=[parts.astype(np.float32).tobytes()])

    spread = sample.repartition(max(1, min(SUM_TASKS, -(-total // SUM_ROWS))))
    schema = "piece int, sums binary"
    pieces = sorted(spread.mapInArrow(add, schema).groupBy("piece").applyInPandas(merge, schema).collect())
    sums = np.concatenate([np.frombuffer(p["sums"], dtype=np.float32).reshape(-1, wide) for p in pieces])
    gram = sums[:, : FEATURES + 1].copy()
    gram[np.diag_indices_from(gram)] += RIDGE * total
    weights = solve(gram, sums[:, FEATURES + 1 :]).astype(np.float32)
    shared = sample.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(codes.shape[1], dtype=np.int64)
        for x, y in _blocks(batches, numbers):
            right += ((x @ shared.value > 0) == (codes[y] > 0)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([right.tolist()], pa.list_(pa.int64()))], names=["right"])

    counted = sample.mapInArrow(score, "right array<bigint>").select(F.posexplode("right").alias("bit", "n"))
    right = {r["bit"]: r["n"] for r in counted.groupBy("bit").agg(F.sum("n").alias("n")).collect()}
    right = np.array([right[b] for b in range(codes.shape[1])]) / total
    return Model(languages, codes, weights, np.clip(right - 0.5, 0.01, None))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", keys: list[str] | None = None) -> Model | None:
    """Fit on the rows of ``labelled`` with a language and a letter."""
    usable = labelled.filter(F.col(lang).isNotNull() & has_letter(F.col(text)))
    # The text is hashed with the keys, so that a key that repeats is drawn from as well.
    row_hash = F.xxhash64(*(keys or []), text)
    marked = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), row_hash.alias("row"))
    draw = F.pmod("row", F.lit(1 << 30))
    sizes = marked.groupBy("lang").agg(F.approx_count_distinct("row").alias("n"), F.min(draw).alias("least"))
    rows = marked.join(broadcast_if_small(materialise(sizes)), "lang")
    rows = rows.filter((draw * F.col("n") < float(PER_LANGUAGE << 30)) | (draw == F.col("least")))
    # Equal rows count once.
    rows = rows.groupBy("lang", "row").agg(F.min("text").alias("text"))
    found = texts.map_texts(
        rows, "text", ["lang"], "vector binary", lambda part: {"vector": [v.tobytes() for v in vectors(part).astype(np.float16)]}
    )
    found = materialise(found)
    counts = {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()}
    return fit_sums(found, counts) if counts else None


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` and ``ambiguous``."""
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: texts.Texts) -> dict:
        m = shared.value
        best, score, near = [], [], []
        # The dense rows of a block of texts are bounded, however short the texts.
        for first in range(0, part.count, 256):
            last = min(first + 256, part.count)
            at = part.offsets[first : last + 1]
            block = texts.Texts(part.data[at[0] : at[-1]], at - at[0], first)
            b, s, a = decode(m, vectors(block))
            best.append(b), score.append(s), near.append(a)
        names = np.array(m.languages, dtype=object)
        return {
            "lang_pred": names[np.concatenate(best)],
            "score": np.concatenate(score).astype(float),
            "ambiguous": np.concatenate(near),
        }

    letter = "_has_letter"
    source = docs.select(*keep, F.col(text).alias("_body"), has_letter(F.col(text)).alias(letter))
    made = texts.map_texts(source, "_body", [*keep, letter], "lang_pred string, score double, ambiguous boolean", work)
    known = F.col(letter)
    return made.select(
        *keep,
        F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.least(F.col("score"), F.lit(1.0))).otherwise(0.0).alias("score"),
        (known & F.col("ambiguous")).alias("ambiguous"),
    )
