"""Bounded samples of labelled texts, on which the classifiers of this subpackage are fitted."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled texts gathered for a fit, at most about half of them of each label, and their bytes. Documented bounds of both
#: classifiers: a text that doesn't fit in what is left of the bytes is passed over.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 32 << 20


def held_out(doc_id: Column) -> Column:
    """Rows that fits never see: crc32 of the id as text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, *, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, size: int | None = None) -> list[tuple[str, int, float]]:
    """About ``rows`` texts at most that aren't held out, and ``size`` bytes at most, as (text, label, weight); weights
    restore the labels' shares.

    Chosen by a hash of the id. Labels other than 0 and 1 and null ids or texts are left out; of an id with several labels
    the least counts, of one with several texts the one with the least hash.
    """
    size = SAMPLE_BYTES if size is None else size
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
    counts = {r["_label"]: r["n"] for r in usable.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, rows / 2 / n) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    limit = F.lit(0.0)
    for k, p in share.items():
        limit = F.when(F.col("_label") == k, p).otherwise(limit)
    chosen = F.broadcast(usable.where(draw < limit))  # bounded by rows
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    least = F.min(F.struct(F.xxhash64("_text").alias("hash"), F.octet_length("_text").alias("bytes"))).alias("x")
    there = texts.join(chosen, "_id").groupBy("_id", "_label").agg(least).select("_id", "_label", "x.*", F.xxhash64("_id", F.lit(4)).alias("place")).collect()
    picked, left = [], size
    for r in sorted(there, key=lambda r: (r["place"], r["_id"])):
        if r["bytes"] <= left:
            picked.append((r["_id"], r["hash"], r["_label"]))
            left -= r["bytes"]
    if not picked:
        return []
    met, used = Counter(r["_label"] for r in there), Counter(x[2] for x in picked)
    weight = {k: met[k] / used[k] / share[k] for k in used}
    kind = dict(texts.dtypes)["_id"]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(picked, f"_id {kind}, _hash long, _label int"))
    found = texts.withColumn("_hash", F.xxhash64("_text")).join(wanted, ["_id", "_hash"]).dropDuplicates(["_id"]).select("_id", "_text", "_label").collect()
    return [(r["_text"], r["_label"], weight[r["_label"]]) for r in sorted(found, key=lambda r: r["_id"])]
