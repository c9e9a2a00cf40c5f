"""Runs of repeated words by the runs theorem (operator 12).

A run is a stretch of words with smallest period q, at least two periods long, that no neighbouring word extends. By the
runs theorem every run holds a Lyndon root that is the longest Lyndon word at its place under an order of the words or
under the reversed order. These words end at the next smaller value of the inverse suffix array (the next greater one for
the reversed order, whose end mark is the greatest word: a run at the end of a text is found under the first). So there
are at most two candidates at each place; each is extended to the right by the longest common prefix of the suffixes at
its start and behind its end (a range minimum of the LCP array by a sparse table) and to the left by the same over the
reversed words, and is a run if both extensions together cover a period.

Texts are taken in slices of bounded size, whole texts always, joined by end marks of their own; all steps are NumPy over
a slice. The reversed side is made for those texts only that have a candidate left. A text's memory is its words times
the logarithm of its longest repeat.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textvec import slices, string_buffers

#: Steps from candidate to candidate before the places left look up a table of minima.
HOPS = 8


def suffix_ranks(s: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... words at each place, equal for equal ones; the last are those of suffixes.

    ``s`` are words as numbers from 0; every text in it ends with a number of its own, less than all words.
    """
    n = len(s)
    times = np.bincount(s)
    rank = (np.cumsum(times) - times)[s].astype(np.int32)
    levels, size = [rank], 1
    active = np.flatnonzero(times[s] > 1)
    while len(active):
        own = rank[active].astype(np.int64)
        key = own * n + rank[active + size]
        order = np.argsort(key)
        key, own, place = key[order], own[order], active[order]
        at = np.arange(len(order))
        part = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], own[1:] != own[:-1]])
        first = np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[place] = own + first
        levels.append(rank)
        member = np.cumsum(part) - 1
        active = place[np.bincount(member)[member] > 1]
        size *= 2
    return levels


def minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: the k-th array holds the least of 2 ** k values from each place on."""
    table, k = [values], 1
    while 2 * k <= len(values):
        last = table[-1]
        table.append(np.minimum(last[:-k], last[k:]))
        k *= 2
    return table


def next_smaller(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each of ``places`` the next place with a smaller value, which there is."""
    to = np.arange(1, len(values) + 1)
    active = places
    for _ in range(HOPS):
        far = to[active]
        more = values[far] > values[active]
        active = active[more]
        if not len(active):
            return to[places]
        to[active] = to[far[more]]  # all between a place and where it points are greater
    table = minima(values)
    at = to[active]
    for k in range(len(table) - 1, -1, -1):
        inside = at + (1 << k) <= len(values)
        step = inside & (table[k][np.minimum(at, len(table[k]) - 1)] > values[active])
        at = at + (step.astype(np.int64) << k)
    to[active] = at
    return to[places]


class Extension:
    """Longest common prefixes of suffixes: the LCP array of neighbours in suffix order and its sparse table."""

    def __init__(self, levels: list[np.ndarray]):
        self.rank = levels[-1]
        order = np.empty(len(self.rank), np.int64)
        order[self.rank] = np.arange(len(order))
        lcp = np.zeros(len(order), np.int32)
        at = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]]) + 1
        a, b = order[at - 1], order[at]
        shared = np.zeros(len(at), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            step = (levels[k][a] == levels[k][b]).astype(np.int64) << k
            a, b, shared = a + step, b + step, shared + step
        lcp[at] = shared
        self.table = minima(lcp)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        k = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            own = np.flatnonzero(k == level)
            row = self.table[level]
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << int(level)) + 1])
        return out


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' words with an end mark each; the text and first place of every place's text."""
    size = np.array([len(p) for p in parts])
    first = np.concatenate([[0], np.cumsum(size + 1)])
    s = np.empty(first[-1], np.int64)
    for k, p in enumerate(parts):
        s[first[k] : first[k] + size[k]] = p + len(parts)
        s[first[k] + size[k]] = k
    text = np.repeat(np.arange(len(parts)), size + 1)
    return s, text, first


def runs(parts: list[np.ndarray], least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of each run of ``least`` words or more, by text, start and period."""
    none = (np.zeros(0, np.int64),) * 4
    if not any(len(p) >= max(2, least) for p in parts):
        return none
    s, text, first = _joined(parts)
    levels = suffix_ranks(s)
    rank = levels[-1].astype(np.int64)
    word = np.flatnonzero(s >= len(parts))
    up = next_smaller(rank, word)
    down = next_smaller(np.where(s < len(parts), -1, len(s) - rank), word)
    inside = s[down] >= len(parts)
    i, j = np.concatenate([word, word[inside]]), np.concatenate([up, down[inside]])
    same = s[i] == s[j]
    begin = first[text[i]]
    before = (i > begin) & (s[i - 1] == s[j - 1])
    some = np.flatnonzero(same | before)
    i, j, same, before, begin = i[some], j[some], same[some], before[some], begin[some]
    right = np.zeros(len(i), np.int64)
    if same.any():
        right[same] = Extension(levels)(i[same], j[same])
    period = j - i
    lack = period - right  # words that the left has to add
    fits = (lack <= 0) | (before & (i - lack >= begin))
    at = np.maximum(i - np.maximum(lack, 0), 0)
    some = np.flatnonzero(fits & ((lack <= 0) | (s[at] == s[at + period])))
    i, j, right, before, period = i[some], j[some], right[some], before[some], period[some]
    if not len(i):
        return none
    left = np.zeros(len(i), np.int64)
    if before.any():
        chosen = np.unique(text[i[before]])
        back, _, back_first = _joined([parts[k][::-1] for k in chosen])
        a, b = i[before], j[before]
        own = np.searchsorted(chosen, text[a])
        turn = back_first[own + 1] - 2 + first[text[a]]  # where a place of the text stands in the reversed one
        left[before] = Extension(suffix_ranks(back))(turn - (a - 1), turn - (b - 1))
    size = left + period + right
    some = np.flatnonzero((left + right >= period) & (size >= least))
    out = np.stack([text[i[some]], i[some] - left[some] - first[text[i[some]]], period[some], size[some]], 1)
    out = np.unique(out, axis=0)
    return out[:, 0], out[:, 1], out[:, 3], out[:, 2]


def _found(least: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            offsets, data = string_buffers(texts)
            for lo, hi in slices(offsets):
                split = [bytes(data[offsets[k] : offsets[k + 1]]).split() for k in range(lo, hi)]
                known = defaultdict(count().__next__)
                parts = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in split]
                text, start, size, period = runs(parts, least)
                held = np.searchsorted(text, np.arange(hi - lo + 1))
                collapsed = []
                for k, w in enumerate(split):
                    a, b = held[k], held[k + 1]
                    if a < b:
                        edge = np.zeros(len(w) + 1, np.int64)
                        np.add.at(edge, start[a:b] + period[a:b], 1)
                        np.add.at(edge, start[a:b] + size[a:b], -1)
                        w = [w[x] for x in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(w))
                fields = pa.StructArray.from_arrays([pa.array(start), pa.array(size), pa.array(period)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(w) for w in split], pa.int64()), pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), fields), pa.array(collapsed, pa.binary()).view(pa.string())],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    return run


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (array of start, length, period, by start and period) and
    collapsed (the words outside of runs and those of runs' first periods, joined by single spaces).

    Words are what ASCII white space separates; they are the same if their bytes are. Runs have ``least`` words or more.
    A null or empty text has no words, no runs and collapses to an empty text. Rows that repeat each get a row, ids may
    be null and of any type, other columns are ignored; an empty table gives an empty one. Texts of any length are taken
    whole: the longest one bounds a task's memory, at about 100 bytes a word and 4 more for each doubling of its longest
    repeat, in either direction.
    """
    common.ship(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    out = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(_found(least), f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", doc_id)
