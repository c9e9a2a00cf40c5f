"""The operators of this subpackage as registered queries, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_planes, chat_tree, mil_quality, parity_join, periodic_runs, poisson_mix, redirects, sorted_projection, surrogate, token_rollup, toxicity, warc_zstd, winnow
from .common import remove, saved, shared_folder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


#: Where the public vocabularies stand on every machine.
TOKENIZERS = "/opt/tokenizers"


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents under a name of their own, renames the version by a revision and takes back and puts in again
    all rows; sends batches twice and compacts in between. What is left is each document once."""
    rollup = token_rollup.Rollup(spark, shared_folder(spark, "tokens"))
    counts, path = saved(token_rollup.counted(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "byte_bpe_50k"), "token-counts")
    first = counts.withColumn("tokenizer", F.lit("byte_bpe_50k-loading"))
    rollup.apply("load", token_rollup.inserts(first))
    rollup.apply("load", token_rollup.inserts(first))  # sent twice, counted once
    rollup.apply("rename", token_rollup.revisions(first, counts))
    rollup.apply("withdraw", token_rollup.deletes(counts))
    rollup.compact()
    rollup.apply("rename", token_rollup.revisions(first, counts))  # known to the compacted delta
    rollup.apply("again", token_rollup.inserts(counts))
    remove(spark, path)
    return rollup.totals()


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, role in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    found = chat_tree.formatted_branches(chat_tree.chains(rows))
    read = found.withColumns({"turns": chat_tree.parsed(F.col("formatted")), "loss": chat_tree.loss_text(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        winnow.is_contaminated().alias("contaminated"),
    )


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_groups(table(spark, sf_dir, "documents"))


def op5_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mil_quality.quality(docs, mil_quality.fitted(docs, table(spark, sf_dir, "labels")))


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    manifest = warc_zstd.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc_zstd.read_archives(spark, folder, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sorted_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_projection.similar_vectors(table(spark, sf_dir, "embeddings"))


#: A key for tests; production passes its own secret.
SURROGATE_KEY = "not a secret"


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.with_surrogates(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mixed(table(spark, sf_dir, "documents"))


def op11_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return bit_planes.hard_negatives(moved, F.col("vec_id") % 50 == 0)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts in which, for a tenth of the ids, the words from some place on repeat with a period of their own."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)})
    placed = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.repeats(with_planted_runs(table(spark, sf_dir, "documents")))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    longest = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("x.l")
    return told.select("doc_id", "n_runs", F.col("x.start").alias("start"), length.alias("length"), F.col("x.period").alias("period"), F.floor(length * 1000 / F.col("x.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Rules of the query on pages.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op13_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return redirects.judged(pages, URL_RULES, redirects.links_of(pages)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_rollup": op2_token_rollup,
    "op3_chat_tree": op3_chat_tree,
    "op4_winnowing": op4_winnowing,
    "op5_mil_quality": op5_mil_quality,
    "op6_warc_zstd": op6_warc_zstd,
    "op7_sorted_projection": op7_sorted_projection,
    "op8_surrogates": op8_surrogates,
    "op9_poisson_mix": op9_poisson_mix,
    "op10_parity_join": op10_parity_join,
    "op11_bit_planes": op11_bit_planes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_redirects": op13_redirects,
}
