"""Benchmark decontamination by winnowing (operator 4).

Both sides are cut into k-grams of words; of each window of consecutive k-grams the one with the least hash is kept
(the last of equals). A run of ``window`` words that stands on both sides keeps the same k-gram on both, so joining the
kept fingerprints finds every shared run; each match is then extended word by word and only runs of ``window`` equal
words count. Items shorter than the window are one run of their own length and are looked up whole.

The scan of the documents drops fingerprints that no item has by a bitmap, and what is left carries the word hashes around
it, so texts are never shuffled; items shorter than the window are known by the hash of all their words and carry nothing.
Fingerprints that items share are one row with the list of these items. Matches are extended by array functions, so a
task runs one Python process, that of the scan. The one shuffle gathers the matches of each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .textvec import U64, WORD_BYTES, Words, grams, mix, words

#: Bits of the bitmap of item fingerprints that the scan of the documents tests: sixteen for each fingerprint, from 2 MB
#: to 16 MB; what a full bitmap lets through, the join drops.
FILTER_BITS, FILTER_SHARE = (1 << 24, 1 << 27), 16

_PRINT = "key_id long, key_hash long, n_words int, hash long, at int, span int, around array<long>"


def kept(w: Words, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the k-grams that winnowing keeps: the last least of each ``width`` consecutive ones."""
    at, h = grams(w, k)
    n = len(at) - width + 1
    if n <= 0:
        return at[:0], h[:0]
    starts = np.flatnonzero(w.row[at[:n]] == w.row[at[width - 1 :]])
    if not len(starts):
        return at[:0], h[:0]
    least, where = h[starts], starts.copy()
    for j in range(1, width):
        other = h[starts + j]
        better = other <= least
        np.copyto(least, other, where=better)
        np.copyto(where, starts + j, where=better)
    where = np.unique(where)
    return at[where], h[where]


def _around(w: Words, at: np.ndarray, size: np.ndarray, reach: int, total: int) -> np.ndarray:
    """Word hashes from ``reach`` before to ``reach`` after each fingerprint of ``size`` words; 0 outside its text."""
    index = at[:, None] + np.arange(-reach, total - reach)[None, :]
    row = w.row[at]
    good = (index >= w.first[row][:, None]) & (index < np.minimum(w.first[row + 1], at + size + reach)[:, None])
    values = w.hash[np.clip(index, 0, max(len(w.hash) - 1, 0))]
    return np.where(good, values | U64(1), U64(0))


def _bitmap(prints: DataFrame, rows: int) -> np.ndarray:
    """One bit for each fingerprint, gathered as words of 64 bits."""
    size = min(max(FILTER_BITS[0], 1 << (FILTER_SHARE * rows).bit_length()), FILTER_BITS[1])
    bit = F.col("item_hash").bitwiseAND(size - 1)
    filled = prints.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(item_hash & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    return out.view(U64)


def _set_bits(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which fingerprints have their bit in the bitmap."""
    return (table[((h & U64(64 * len(table) - 1)) >> U64(6)).astype(np.int64)] >> (h & U64(63))) & U64(1) > 0


def _scan(window: int, k: int, lengths: list[int], bitmap, filler: bool):
    """Rows of fingerprints; what stands around them, for those of windows. For documents (filler) also one row each that
    matches nothing, so that none is lost."""
    width, reach = window - k + 1, window - 1
    total = 2 * reach + window

    def run(batches):
        for batch in batches:
            ids, texts, hashes = batch.column(0), batch.column(1), batch.column(2)
            for w in words(texts, WORD_BYTES):
                n_words = w.counts()
                found = [(*kept(w, k, width), window)]
                for n in lengths:
                    at, h = grams(w, n)
                    if not filler:  # of items, only those with no other word
                        whole = n_words[w.row[at]] == n
                        at, h = at[whole], h[whole]
                    found.append((at, mix(h ^ U64(n)), n))
                if bitmap is not None:
                    table = bitmap.value
                    found = [(at[hit], h[hit], n) for at, h, n in found for hit in [_set_bits(table, h)]]
                at = np.concatenate([x[0] for x in found])
                h = np.concatenate([x[1] for x in found])
                span = np.concatenate([np.full(len(x[0]), x[2], np.int32) for x in found])
                long = span == window
                around = _around(w, at[long], np.full(np.count_nonzero(long), k), reach, total)
                row, place = w.row[at], at - w.first[w.row[at]]
                if filler:
                    rows = np.arange(w.n_rows)
                    key = mix(np.arange(w.n_rows, dtype=U64) + U64(w.row0) * U64(7919) + w.hash.sum(dtype=U64))
                    row, place, h = np.concatenate([row, rows]), np.concatenate([place, np.zeros(w.n_rows, int)]), np.concatenate([h, key])
                    span = np.concatenate([span, np.zeros(w.n_rows, np.int32)])
                if not len(row):
                    continue
                take = pa.array(row + w.row0)
                lists = around.view(np.int64)
                used = np.where(span == window, total, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take),
                        hashes.take(take),
                        pa.array(n_words[row].astype(np.int32)),
                        pa.array(h.view(np.int64)),
                        pa.array(place.astype(np.int32)),
                        pa.array(span),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used)]).astype(np.int32)), pa.array(lists.ravel())),
                    ],
                    names=["key_id", "key_hash", "n_words", "hash", "at", "span", "around"],
                )

    return run


def _ranges(window: int) -> Column:
    """Word ranges of a joined row that really are equal: of a window's fingerprint the runs of equal words around it."""
    reach = window - 1
    whole = F.struct(F.col("at").alias("start"), (F.col("at") + F.col("span")).alias("end"))
    same = F.zip_with("around", "item_around", lambda x, y: (x == y) & (x != 0))
    begins = lambda equal: F.filter(F.sequence(F.lit(0), F.lit(2 * reach)), lambda j: F.forall(F.slice(equal, j + 1, window), lambda e: e))
    placed = F.transform(common.let(same, begins), lambda j: F.struct((F.col("at") + j - reach).alias("start"), (F.col("at") + j - reach + window).alias("end")))
    return F.when(F.col("items").isNotNull(), F.when(F.col("span") == window, placed).otherwise(F.array(whole)))


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, k: int = 7) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted list of item ids as strings) and hits (word ranges).

    A window is ``window`` consecutive words of an item; an item with fewer, but not none, is one window. A word of a
    document inside any occurrence of a window is hit. Ids are integers. Columns other than the named ones are ignored.
    A null or empty text has no words and no hits; an empty benchmark hits nothing; equal items are all reported. Rows
    that repeat id and text, or whose id is null, each get a row; an item with a null id counts for n_hit, but not in items.
    Texts of any length are taken whole, in slices of bounded size.
    """
    found = _contamination(docs, benchmark, doc_id, text, item_id, item_text, window, k)
    return found.select(*[c for c in found.columns if c not in ("key_hash", "rows")], F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row")).drop("_row")


def _contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, k: int = 7) -> DataFrame:
    """For each id and text: the columns of contamination, key_hash (xxhash64 of the text) and rows, how many there are."""
    spark = docs.sparkSession
    common.ship(spark)
    side = lambda df, i, t: df.select(F.col(i).cast("long").alias("i"), F.col(t).alias("t"), F.xxhash64(t).alias("h"))
    items = side(benchmark, item_id, item_text)
    all_lengths = list(range(1, window))
    cut = items.mapInArrow(_scan(window, k, all_lengths, None, False), _PRINT).select(F.col("key_id").alias("item"), F.col("hash").alias("item_hash"), F.col("span").alias("item_span"), F.col("around").alias("item_around"))
    prints, _ = common.saved(cut.groupBy("item_hash", "item_span", "item_around").agg(F.collect_set(F.col("item").cast("string")).alias("items")), "winnow-items")
    lengths = sorted(r[0] for r in prints.where(F.col("item_span") < window).select("item_span").distinct().collect())
    rows, size = prints.agg(F.count("*"), F.sum(48 + 8 * F.size("item_around") + 24 * F.size("items"))).first()
    bitmap = spark.sparkContext.broadcast(_bitmap(prints, rows))
    scanned = side(docs, doc_id, text).mapInArrow(_scan(window, k, lengths, bitmap, True), _PRINT)
    joined = scanned.join(common.maybe_broadcast(prints, size or 0, 1), (F.col("hash") == F.col("item_hash")) & (F.col("span") == F.col("item_span")), "left")
    runs = joined.select("key_id", "key_hash", "n_words", (F.col("span") == 0).alias("filler"), _ranges(window).alias("ranges"), "items").where(F.col("filler") | (F.size("ranges") > 0))
    covered = F.aggregate(
        F.col("hits"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("upto")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["upto"]))).cast("long").alias("n"), F.greatest(acc["upto"], x["end"]).alias("upto")),
        lambda acc: acc["n"],
    )
    return (
        runs.groupBy("key_id", "key_hash")
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.count_if("filler").alias("rows"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("ranges")))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .select(F.col("key_id").alias(doc_id), "key_hash", "n_words", covered.alias("n_hit"), "items", "hits", "rows")
    )


def is_contaminated(share: int = 20) -> Column:
    """Hit words are there and at least a ``share``-th of all words."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns, of any names; rows are told apart by id and text,
    and ids may be null."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    found = _contamination(docs, benchmark, **options).where(is_contaminated()).select(F.col(doc_id).alias("tainted"), F.col("key_hash").alias("hash"))
    found, _ = common.saved(found, "winnow-tainted")
    # the row is one column, so that no name of docs can clash with one of ours
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("own"))
    return packed.join(common.maybe_broadcast(found, found.count(), 24), F.col("id").eqNullSafe(F.col("tainted")) & (F.col("own") == F.col("hash")), "left_anti").select("row.*")
