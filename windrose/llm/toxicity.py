"""Toxicity by a counterfactually regularised classifier (operator 1).

A logistic regression over the words of a text and their beginnings (so inflected and compounded forms of a stem count
together). It is fitted on a bounded sample of labelled texts, over the features that a likelihood ratio test ties to
the label. In the sample's sentences each identity term is swapped for each other term of its group; the change of the
sentence's score is penalised, so that mentioning one group rather than another can't make a text toxic.

Scoring runs where the texts are; a task keeps the weights (some thousand features) and a bounded memo of words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .labelled import held_out, sample

# Groups of terms for identities, in lower case; a term is swapped for the others of its group.
IDENTITY_GROUPS = [
    "muslim christian jewish hindu buddhist sikh atheist".split(),
    "muslims christians jews hindus buddhists sikhs atheists".split(),
    "black white asian african european arab latino indigenous".split(),
    "gay straight lesbian bisexual queer heterosexual".split(),
    "woman man girl boy".split(),
    "women men girls boys".split(),
    "immigrant refugee foreigner native".split(),
    "immigrants refugees foreigners natives".split(),
    "deaf blind disabled autistic".split(),
    "muslimisch christlich jüdisch hinduistisch buddhistisch".split(),
    "muslime christen juden hindus buddhisten".split(),
    "frau mann".split(),
    "frauen männer".split(),
    "schwul lesbisch bisexuell heterosexuell".split(),
    "musulman chrétien juif hindou bouddhiste athée".split(),
    "musulmans chrétiens juifs hindous bouddhistes athées".split(),
    "femme homme".split(),
    "femmes hommes".split(),
    "musulmán cristiano judío hindú budista ateo".split(),
    "musulmanes cristianos judíos hindúes budistas ateos".split(),
    "mujer hombre".split(),
    "mujeres hombres".split(),
]

PREFIXES = range(3, 9)
#: A feature is kept if its likelihood ratio against the label is at least this, and it speaks for toxicity.
LEAST_RATIO = 22.0
MAX_FEATURES = 2000
#: Weights of the L2 penalty, and of the squared change of score under swaps.
RIDGE, COUNTERFACTUAL = 2e-4, 1.0
MEMO_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def word_features(word: str) -> list[str]:
    return [word[:k] + "-" for k in PREFIXES if len(word) >= k] + [word]


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


@dataclass
class Model:
    """Bias and weights by feature."""

    bias: float
    weights: dict[str, float]
    memo: dict[str, tuple] = field(default_factory=dict)

    def logit(self, text: str | None) -> float:
        found: set[str] = set()
        memo = self.memo
        for w in text_words(text):
            hit = memo.get(w)
            if hit is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                hit = memo[w] = tuple(f for f in word_features(w) if f in self.weights)
            if hit:
                found.update(hit)
        return self.bias + math.fsum(self.weights[f] for f in found)


def _ratio(k1: float, n1: float, k0: float, n0: float) -> float:
    """Likelihood ratio (twice its logarithm) of a feature's share being different between two labels."""

    def part(k, n, p):
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    both = (k1 + k0) / (n1 + n0)
    if not 0 < both < 1:
        return 0.0
    return 2 * (part(k1, n1, k1 / n1) + part(k0, n0, k0 / n0) - part(k1, n1, both) - part(k0, n0, both))


def swaps(text: str, groups: list[list[str]]) -> Counter:
    """Of each sentence with an identity term: the words that a swap takes away and brings, with how often."""
    group_of = {t: g for g in groups for t in g}
    found: Counter = Counter()
    for sentence in _SENTENCE.findall(text.lower()):
        said = set(_WORD.findall(sentence))
        for term in said & group_of.keys():
            for other in group_of[term]:
                if other not in said:
                    found[term, other] += 1
    return found


def fit(rows: list[tuple[str, int, float]], *, counterfactual: float = COUNTERFACTUAL, groups: list[list[str]] | None = None, steps: int = 400) -> Model:
    """A model of (text, label, weight) rows. Without rows of both labels, a constant one."""
    groups = IDENTITY_GROUPS if groups is None else groups
    total = [sum(w for _, y, w in rows if y == k) for k in (0, 1)]
    n = [sum(1 for _, y, _ in rows if y == k) for k in (0, 1)]
    if not n[0] or not n[1]:
        share = total[1] / (total[0] + total[1]) if rows else 0.0
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(math.log(share / (1 - share)), {})
    k1s: Counter = Counter()
    for text, y, _ in rows:
        if y:
            k1s.update(features(text_words(text)))
    k1s = Counter({f: k for f, k in k1s.items() if k >= 3})
    k0s: Counter = Counter()
    for text, y, _ in rows:
        if not y:
            k0s.update(features(text_words(text)) & k1s.keys())
    rated = []
    for f, k1 in k1s.items():
        k0 = k0s.get(f, 0)
        if k1 * n[0] > 2 * k0 * n[1] and (r := _ratio(k1, n[1], k0, n[0])) >= LEAST_RATIO:
            rated.append((-r, f))
    names = [f for _, f in sorted(rated)[:MAX_FEATURES]]
    del k1s, k0s, rated
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, (text, _, _) in enumerate(rows):
        x[i, [index[f] for f in features(text_words(text)) & index.keys()]] = 1
    y = np.array([r[1] for r in rows], np.float32)
    weight = np.array([r[2] for r in rows], np.float32)
    weight /= weight.sum()
    changed: Counter = Counter()
    for text, _, _ in rows:
        changed.update(swaps(text, groups))
    delta = np.zeros((len(changed), len(names)), np.float32)
    often = np.array(list(changed.values()), np.float32)
    for i, (term, other) in enumerate(changed):
        for sign, w in ((-1, term), (1, other)):
            for f in word_features(w):
                if f in index:
                    delta[i, index[f]] += sign
    often = often / often.sum() if len(often) else often
    w, b = np.zeros(len(names), np.float32), np.float32(math.log(total[1] / total[0]))
    m1, m2 = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        wrong = weight * (p - y)
        slope = x.T @ wrong + RIDGE * w
        if len(delta):
            slope = slope + counterfactual * (delta.T @ (often * (delta @ w)))
        g = np.append(slope, wrong.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), np.float32(b - move[-1])
    return Model(float(b), {f: float(v) for f, v in zip(names, w, strict=True) if v})


def _score(model):
    def run(batches):
        known = model.value
        for batch in batches:
            ids = batch.column(0)
            for lo in range(0, len(ids), 500):
                logits = np.array([known.logit(t) for t in batch.column(1).slice(lo, 500).to_pylist()])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 500), pa.array(1 / (1 + np.exp(-np.clip(logits, -700, 700))))], names=["id", "score"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", **options) -> Model:
    return fit(sample(docs, labels, label, doc_id=doc_id, text=text), **options)


def toxicity(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", at: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (1 from ``at``).

    A null or empty text scores as one without words; texts of any length are scored whole. Rows that repeat each get a
    row and score alike. Ids are integers; a null id stays null, and so is its held_out. Other columns are ignored. An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast(Model(model.bias, model.weights))  # bounded by MAX_FEATURES
    scored = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(_score(sent), "id long, score double")
    return scored.select(F.col("id").alias(doc_id), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``at``, with all their columns, of any names, in one scan; null, empty and long
    texts count as in toxicity(), ids play no part, rows that repeat stay or go together."""
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast(Model(model.bias, model.weights))
    place = docs.columns.index(text)

    def run(batches):
        known, limit = sent.value, math.log(at / (1 - at))
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield part.filter(pa.array([known.logit(t) < limit for t in part.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
