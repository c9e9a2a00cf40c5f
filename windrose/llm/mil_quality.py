"""Quality by attention-based multiple-instance learning (operator 5).

A text is a bag of passages of PASSAGE words. A passage is described by the shapes of its words (letter case, digits,
punctuation, length) counted in hashed cells, and by a few ratios; an encoder maps that to a small vector h. Gated
attention weighs the passages, a = softmax(w . (tanh(V h) * sigmoid(U h))), and the weighted sum of the h is scored.
Only texts are labelled, so the weights learn which passages decide. It is fitted on a bounded sample of labelled texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .labelled import held_out, sample
from .textvec import NONSPACE_BYTES, U64, mix, string_buffers, words

PASSAGE = 64
CELLS, RATIOS = 192, 10
HIDDEN, GATE = 24, 12

# Byte classes of the shapes: 0 other, 1 lower, 2 upper, 3 digit, 4 non-ASCII; each punctuation mark is its own class.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
for _i, _b in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[_b] = 5 + _i


def passages(column: pa.Array):
    """Per slice of rows: first row, rows, description of each passage, and where each row's passages begin."""
    offsets, data = string_buffers(column)
    for w in words(column, NONSPACE_BYTES):
        begin, stop = int(offsets[w.row0]), int(offsets[w.row0 + w.n_rows])
        kind = _CLASS[data[begin:stop]]
        count = w.counts()
        per_row = -(-count // PASSAGE)
        first = np.concatenate([[0], np.cumsum(per_row)])
        n = int(first[-1])
        if not n:
            yield w.row0, w.n_rows, np.zeros((0, CELLS + RATIOS), np.float32), first
            continue
        owner = first[w.row] + (np.arange(len(w.hash)) - w.first[w.row]) // PASSAGE
        size = np.bincount(owner, minlength=n).astype(np.float32)
        length = (w.end - w.start).astype(np.float32)
        lead, tail, before = kind[w.start], kind[w.end - 1], kind[np.maximum(w.end - 2, w.start)]
        shape = mix(lead.astype(U64) + tail.astype(U64) * U64(64) + before.astype(U64) * U64(4096) + np.minimum(length, 12).astype(U64) * U64(1 << 18))
        cell = (shape >> U64(32)) * U64(CELLS) >> U64(32)
        x = np.bincount(owner * CELLS + cell.astype(np.int64), minlength=n * CELLS).reshape(n, CELLS).astype(np.float32)
        x = np.sqrt(x / size[:, None])
        of = lambda k: np.concatenate([[0], np.cumsum(k)])
        per = lambda sums: np.bincount(owner, sums[w.end] - sums[w.start], n)
        chars = np.maximum(np.bincount(owner, length, n), 1)
        order = np.lexsort((w.hash, owner))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        again = np.zeros(len(owner), bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
        shout = (lead == 2) & (before == 2)
        r = np.stack(
            [
                per(of(kind == 2)) / chars,
                per(of(kind == 3)) / chars,
                per(of(kind >= 5)) / chars,
                per(of(kind == 4)) / chars,
                chars / size / 10,
                np.bincount(owner[order][fresh], minlength=n) / size,
                np.bincount(owner, again, n) / size,
                np.bincount(owner, shout, n) / size,
                np.bincount(owner, length == 1, n) / size,
                size / PASSAGE,
            ],
            1,
        )
        yield w.row0, w.n_rows, np.concatenate([x, r.astype(np.float32)], 1), first


def _softmax_by(values: np.ndarray, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(values, first)
    e = np.exp(values - top[owner])
    return e / np.add.reduceat(e, first)[owner]


class Model:
    """Weights as arrays: encoder (We, be), attention (V, U, w), and score (c, b)."""

    def __init__(self, seed: int = 5, share: float = 0.5):
        rng = np.random.Generator(np.random.PCG64(seed))
        d = CELLS + RATIOS
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.p = {"We": init(d, HIDDEN), "be": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE), "c": init(HIDDEN), "b": np.float32(np.log(share / (1 - share)))}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """``first``: where each bag begins; all bags have passages."""
        p = self.p
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        h = np.tanh(x @ p["We"] + p["be"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = _softmax_by((t * g) @ p["w"], first, owner)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "first": first, "owner": owner, "h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ p["c"] + p["b"]}

    def gradient(self, s: dict, error: np.ndarray) -> dict:
        """Of the loss whose derivative by each bag's logit is ``error``."""
        p, a, h, t, g, owner = self.p, s["a"], s["h"], s["t"], s["g"], s["owner"]
        dz = error[:, None] * p["c"]
        da = (dz[owner] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, s["first"])[owner])
        dtg = ds[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"We": s["x"].T @ dh, "be": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": s["z"].T @ error, "b": error.sum()}

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of every row; a row without passages scores by the bias alone."""
        logit = np.full(len(first) - 1, float(self.p["b"]))
        some = np.flatnonzero(np.diff(first))
        if len(some):
            logit[some] = self.forward(x, first[some])["logit"]
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def fit(rows: list[tuple[str, int, float]], *, epochs: int = 25, batch: int = 128, rate: float = 5e-3, ridge: float = 1e-4, seed: int = 5) -> Model:
    """A model of (text, label, weight) rows, by Adam on the weighted cross-entropy. Without rows, a constant one."""
    total = sum(r[2] for r in rows)
    share = sum(r[2] for r in rows if r[1]) / total if rows else 0.5
    model = Model(seed, share)
    if not 0 < share < 1:
        model.p["c"] *= 0
        return model
    xs, sizes = [], []
    for _, _, x, first in passages(pa.array([r[0] for r in rows], pa.string())):
        xs.append(x)
        sizes.append(np.diff(first))
    x, size = np.concatenate(xs), np.concatenate(sizes)
    begin = np.concatenate([[0], np.cumsum(size)])
    y = np.array([r[1] for r in rows], np.float32)
    weight = np.array([r[2] for r in rows], np.float32)
    weight *= len(rows) / weight.sum()
    rng = np.random.Generator(np.random.PCG64(seed))
    some = np.flatnonzero(size)
    m1, m2, step = {}, {}, 0
    for epoch in range(epochs):
        for pick in np.array_split(rng.permutation(some), max(1, len(some) // batch)):
            at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in pick])
            s = model.forward(x[at], np.concatenate([[0], np.cumsum(size[pick])[:-1]]))
            prob = 1 / (1 + np.exp(-np.clip(s["logit"], -30, 30)))
            grads = model.gradient(s, weight[pick] * (prob - y[pick]) / len(pick))
            step += 1
            for k, g in grads.items():
                g = g + ridge * model.p[k]
                m1[k] = 0.9 * m1.get(k, 0) + 0.1 * g
                m2[k] = 0.999 * m2.get(k, 0) + 0.001 * g * g
                model.p[k] = (model.p[k] - rate * (1 - epoch / epochs) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fitted(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", **options) -> Model:
    return fit(sample(docs, labels, label, doc_id=doc_id, text=text), **options)


def quality(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", at: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from ``at``), n_passages and
    top_passage (place of the passage with the most attention; null without passages).

    A null, empty or blank text has no passages and scores by the trained bias alone, as all such texts do. Rows that
    repeat each get a row and score alike, as do ties. A null id stays null, and so is its held_out. Texts of any length
    are scored whole. Ids are integers; other columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        known = sent.value
        for batch in batches:
            for row0, n_rows, x, first in passages(batch.column(1)):
                n = np.diff(first)
                top = np.full(n_rows, -1)
                logit = np.full(n_rows, float(known.p["b"]))
                some = np.flatnonzero(n)
                if len(some):
                    s = known.forward(x, first[some])
                    logit[some] = s["logit"]
                    best = np.maximum.reduceat(s["a"], first[some])
                    hit = np.flatnonzero(s["a"] == best[s["owner"]])
                    bag, where = np.unique(s["owner"][hit], return_index=True)
                    top[some[bag]] = hit[where] - first[some[bag]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row0, n_rows), pa.array(1 / (1 + np.exp(-np.clip(logit, -700, 700)))), pa.array(n), pa.array(top, mask=top < 0)],
                    names=["id", "score", "n_passages", "top_passage"],
                )

    scored = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, score double, n_passages long, top_passage long")
    return scored.select(F.col("id").alias(doc_id), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), "n_passages", "top_passage")
