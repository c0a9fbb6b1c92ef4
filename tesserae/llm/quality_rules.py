"""Quality rules as weak supervision.

Each rule looks at a few counts of a whole text and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation over the number of documents per vote pattern estimates how often
each rule votes what for good and for bad documents, and the posterior probability of being
good replaces a filter in which every rule must pass.

The only thing that reaches the driver is one row per vote pattern that occurs: at most
3 to the number of rules, whatever the number of documents. Counting is over all documents.

Defined cases: a null text counts as empty; an empty text has zero counts, fails the base
filter and every rule abstains on it; equal rows get equal results; an empty table gives an
empty table and rules keep their prior accuracies; ``doc_id`` may be null or repeat; columns
other than the key and the text are carried along untouched by ``score`` and ignored by ``measure``.
"""

from __future__ import annotations

from dataclasses import dataclass

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import texts
from tesserae.llm.names import fresh

#: Characters counted as symbols (fixed value).
SYMBOLS = b"#*$%&|<>"

COUNTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_lines bigint, n_upper bigint, n_letters bigint, n_distinct bigint, n_marks bigint, n_odd bigint, "
    "n_doubled bigint, n_stutter bigint"
)
NAMES = [part.split()[0] for part in COUNTS.split(", ")]


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOL = _table(SYMBOLS)
_MARK = _table(b".,;:?")
_SIGN = _table(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)))
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]))


def count(part: texts.Texts) -> dict[str, np.ndarray]:
    """The counts the rules look at, for every text of a chunk."""
    data, n = part.data, part.count
    words = texts.words(part)
    value = texts.hashes(part, words)
    solid = ~texts._SPACE[data]
    lines = texts.lines(part)
    held = np.searchsorted(words.start, lines.end) - np.searchsorted(words.start, lines.start)
    with_word = held > 0
    lines = texts.Spans(lines.start[with_word], lines.end[with_word], lines.row[with_word])
    line_row, _, copies, _ = texts.tally(lines.row, texts.hashes(part, lines))
    # A window that occurs twice or more covers its three words, the first time included.
    at, window = texts.windows(words.row, value, 3)
    _, _, often, group = texts.tally(words.row[at], window)
    again = at[often[group] > 1] if len(at) else at
    covered = np.zeros(len(value), dtype=bool)
    for j in range(3):
        covered[again + j] = True
    twice = np.zeros(len(data), dtype=bool)
    twice[1:] = (data[1:] == data[:-1]) & _SIGN[data[1:]]
    same = (value[1:] == value[:-1]) & (words.row[1:] == words.row[:-1])
    distinct_row, _, _, _ = texts.tally(words.row, value)
    return {
        "n_words": np.bincount(words.row, minlength=n),
        "word_chars": part.per_text(solid & ((data & 0xC0) != 0x80)),
        "n_symbols": part.per_text(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_row, weights=copies - 1, minlength=n).astype(np.int64),
        "n_repeat_words": np.bincount(words.row[covered], minlength=n),
        "n_lines": np.bincount(lines.row, minlength=n),
        "n_upper": part.per_text(_UPPER[data]),
        "n_letters": part.per_text(_LETTER[data]),
        "n_distinct": np.bincount(distinct_row, minlength=n),
        "n_odd": np.bincount(words.row[_SYMBOL[data[words.end - 1]]], minlength=n),
        "n_doubled": part.per_text(twice),
        "n_stutter": np.bincount(words.row[1:][same], minlength=n),
        "n_marks": np.bincount(words.row[_MARK[data[words.end - 1]]], minlength=n),
    }


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the counts of every whole text."""
    return texts.map_texts(docs, text, [key], COUNTS, count)


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are conditions on the counts; neither holding is an abstention."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "20 * n_symbols > word_chars", "n_words >= 20 AND 100 * n_symbols <= word_chars"),
    Rule("endings", "5 * n_odd > n_words", "n_words >= 20 AND 20 * n_odd <= n_words"),
    Rule("doubled", "10 * n_doubled > n_words", "n_words >= 20 AND 50 * n_doubled <= n_words"),
    Rule("capitals", "2 * n_upper > n_letters", "n_words >= 20 AND 5 * n_upper <= n_letters"),
    Rule("repeats", "3 * n_repeat_words > n_words", "n_words >= 20 AND 20 * n_repeat_words <= n_words"),
    Rule("lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines", "n_lines >= 4 AND n_dup_lines = 0"),
    Rule("variety", "n_words BETWEEN 20 AND 1000 AND 5 * n_distinct < n_words", "n_words >= 20 AND 2 * n_distinct >= n_words"),
    Rule("stutter", "5 * n_stutter > n_words", "n_words >= 20 AND 20 * n_stutter <= n_words"),
    Rule("marks", "n_words >= 20 AND 50 * n_marks < n_words", "n_words >= 20 AND 25 * n_marks >= n_words"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)", "n_words >= 20 AND word_chars BETWEEN 3 * n_words AND 9 * n_words"),
)

#: What the estimate starts from: share of good documents, chance that a rule calls a good
#: document bad, and chance that it calls a bad one bad (one rule sees one kind of junk).
PRIOR_GOOD, PRIOR_FALSE_ALARM, PRIOR_HIT = 0.85, 0.005, 0.3
#: Weight of the prior in shares of the corpus: rules are written to spare good documents, and
#: without that belief kinds of junk that never occur together could not be told from good text.
PRIOR_WEIGHT = 0.5
#: A document is kept from this posterior on.
KEEP_FROM = 0.5


def _named(condition: str, prefix: str) -> str:
    """A condition with every count read from the column ``prefix`` + count."""
    return re.sub("|".join(rf"\b{n}\b" for n in NAMES), lambda m: f"`{prefix}{m.group()}`", condition)


def vote(rule: Rule, prefix: str = "") -> Column:
    bad, good = _named(rule.bad, prefix), _named(rule.good, prefix)
    return F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END").cast("int")


@dataclass
class Model:
    """Share of good documents, and per rule the chance of a bad vote among the votes it casts on each class.

    The accuracy of a rule is ``1 - false_alarm`` on good and ``hit`` on bad documents.
    """

    good: float
    false_alarm: np.ndarray
    hit: np.ndarray


def estimate(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> Model:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) seen ``weights`` times.

    Votes are independent given the class and abstaining tells nothing.
    """
    rules = patterns.shape[1]
    bad, cast = (patterns < 0).T * weights, np.abs(patterns).T * weights
    prior = PRIOR_WEIGHT * max(1.0, float(weights.sum()))
    model = Model(PRIOR_GOOD, np.full(rules, PRIOR_FALSE_ALARM), np.full(rules, PRIOR_HIT))
    good = posterior(model, patterns)
    for _ in range(rounds):
        share = (good @ weights + prior * PRIOR_GOOD) / (weights.sum() + prior)
        alarm = (bad @ good + prior * PRIOR_GOOD * PRIOR_FALSE_ALARM) / (cast @ good + prior * PRIOR_GOOD)
        hit = (bad @ (1 - good) + prior * (1 - PRIOR_GOOD) * PRIOR_HIT) / (cast @ (1 - good) + prior * (1 - PRIOR_GOOD))
        model = Model(float(share), alarm, hit)
        new = posterior(model, patterns)
        moved = np.abs(new - good).max(initial=0)
        good = new
        if moved < tolerance:
            break
    return model


def weigh(model: Model) -> tuple[float, np.ndarray, np.ndarray]:
    """Log odds of being good: of any document, and what each rule's bad and good vote adds."""
    start = np.log(model.good) - np.log1p(-model.good)
    return float(start), np.log(model.false_alarm / model.hit), np.log((1 - model.false_alarm) / (1 - model.hit))


def posterior(model: Model, patterns: np.ndarray) -> np.ndarray:
    """P(good | votes) of every pattern."""
    start, bad, good = weigh(model)
    logit = start + (patterns < 0) @ bad + (patterns > 0) @ good
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(votes: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """Estimate the model from the votes of all documents; at most 3**rules rows are collected."""
    names = [f"vote_{r.name}" for r in rules]
    rows = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()
    patterns = np.array([[row[c] for c in names] for row in rows], dtype=int).reshape(len(rows), len(names))
    return estimate(patterns, np.array([row["n"] for row in rows], dtype=float))


def with_votes(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return measured.withColumns({f"vote_{r.name}": vote(r) for r in rules})


def quality_expression(model: Model, prefix: str = "", rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The posterior probability of being good as a sum of literals per vote, and the base filter's failure."""
    start, bad, good = weigh(model)
    logit = F.lit(start)
    for rule, minus, plus in zip(rules, bad, good):
        column = vote(rule, prefix)
        logit = logit + F.when(column < 0, float(minus)).when(column > 0, float(plus)).otherwise(0.0)
    failed = F.expr(_named("n_words < 50 OR 100 * n_repeat_words > 50 * n_words", prefix))
    return 1 / (1 + F.exp(-logit)), failed


def score(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add votes, ``base_failed``, ``quality`` and ``kept`` to measured documents.

    ``measured`` is read twice, once to estimate: store it first if it is dear to compute.
    """
    votes = with_votes(measured, rules)
    quality, failed = quality_expression(fit(votes, rules), "", rules)
    out = votes.withColumns({"quality": quality, "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def kept_rows(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows that the base filter and the posterior keep, with their columns.

    Each row is judged by its own text, so ids may repeat or be null. The text is read twice:
    once for the estimate, of which only vote patterns leave the tasks, and once to filter.
    """
    body = F.col(f"`{text}`").cast("string")
    model = fit(with_votes(texts.map_texts(docs.select(body.alias("text")), "text", [], COUNTS, count), rules), rules)
    held = fresh(docs, "counts")

    @F.pandas_udf(", ".join(COUNTS.split(", ")))
    def counts(column: pd.Series) -> pd.DataFrame:
        parts = [pd.DataFrame(count(part)) for part in texts.chunks(pa.array(column, pa.string()))]
        return pd.concat(parts, ignore_index=True)[NAMES] if parts else pd.DataFrame({n: pd.Series(dtype="int64") for n in NAMES})

    judged = docs.withColumn(held, counts(body)).select("*", *[F.col(f"{held}.{n}").alias(f"{held}_{n}") for n in NAMES])
    posterior_column, failed = quality_expression(model, f"{held}_", rules)
    return judged.filter(~failed & (posterior_column >= KEEP_FROM)).select(*[f"`{c}`" for c in docs.columns])
