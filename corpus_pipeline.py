"""A training corpus from raw documents: five stages, each by one operator of windrose.llm, each written and reread.

Every stage works on all rows that the one before kept, and all but the last return the columns of ``documents``.
Nulls, empty and repeated rows are treated as the operators' docstrings say; a stage of no rows gives no rows.
"""

from __future__ import annotations

import secrets
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.llm import common, parity_join, poisson_mix, surrogate, toxicity, winnow

#: Word shingles and similarity, in percent, at which documents are near duplicates.
SHINGLE, SIMILAR = 5, 80
#: The Spark setting that holds the key of surrogates, under a name that Spark redacts; the default is for local sessions.
KEY_SETTING, TEST_KEY = "spark.windrose.surrogateSecret", "not a secret"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that score 0.5 or more; the classifier is fitted on the labelled ones that aren't held out."""
    model = toxicity.fitted(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 keeps the one with the least id (null ids stay).

    Rows are told apart by id and text. Of rows that repeat both one stays; of linked texts of one id, the one with the
    least hash; texts that share an id but aren't linked are documents of their own.
    """
    groups = parity_join.grouped_rows(docs, k=SHINGLE, percent=SIMILAR).where("doc_id IS NOT NULL")
    rows = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id"), F.min("root").alias("root"))
    least = rows.where("root IS NOT NULL AND doc_id = component_id")
    shared = least.groupBy("root", "doc_id").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last")).where("first <> last")
    others = least.join(shared, ["root", "doc_id"]).where("text_hash <> first")
    copies = rows.where("doc_id <> component_id").select("doc_id", "text_hash").unionByName(others.select("doc_id", "text_hash"))
    copies = copies.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    # the row is one column, so that no name of docs can clash with one of ours
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    left = packed.join(common.maybe_broadcast(copies, copies.count(), 24), ["id", "hash"], "left_anti")
    repeated, _ = common.saved(rows.where("rows > 1 AND doc_id = component_id").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")), "repeated-rows")
    if not (many := repeated.count()):
        return left.select("row.*")
    twice = common.maybe_broadcast(repeated, many, 24)
    once = left.join(twice, ["id", "hash"], "left_semi").groupBy("id", "hash").agg(F.first("row").alias("row"))
    return left.join(twice, ["id", "hash"], "left_anti").select("row.*").unionByName(once.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents of whose words a twentieth or more stand in passages of benchmark items."""
    return winnow.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates and counts characters anew. On a cluster, where no key is set, surrogates are of
    a key drawn for the run and kept nowhere: nobody can tell what they stand for, and another run has others."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None and not spark.sparkContext.master.startswith("local"):
        warnings.warn(f"{KEY_SETTING} isn't set: surrogates are of a key that is drawn for this run", stacklevel=2)
        key = secrets.token_hex(32)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    done = surrogate.with_surrogates(packed, TEST_KEY if key is None else key)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_entities") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that all sources weigh the same, in random order; adds n_copies, copy and place."""
    return poisson_mix.mixed(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express the classifier's fit; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            common.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
