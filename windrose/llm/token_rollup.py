"""Token counts in delta-maintained rollups (operator 2).

Changes of documents (inserts, deletes, and revisions that replace an old count by a new one) become signed rows, which
are summed by source, language and tokenizer version; the sums of a batch are one small delta table. A batch commits by
renaming its folder into place, once: a batch id that is there already changes nothing, however often it is sent again,
and a task or driver lost before the rename leaves nothing that is read. Totals are the sum of the committed deltas;
compaction replaces deltas by their sum, remembering the batch ids.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens", "chars"]
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long, chars long"
_BATCH = re.compile(r"[A-Za-z0-9_.-]{1,100}")

#: Fixed value: how the byte-level vocabularies split text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, vocabulary: str, version: str, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id, source, lang, tokenizer (``version``), tokens and chars of each row, under a byte-pair vocabulary file.

    The file is opened where tasks run: it must be at ``vocabulary`` on every executor. Null and empty texts have no
    tokens; strings that look like special tokens are ordinary text. Texts of any length are encoded whole. Rows that
    repeat and rows with null ids are counted like any other; other columns are ignored. An empty table gives an empty one.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        encode = _encoder(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in (x.as_py() for x in batch.column(3))]
            chars = pa.compute.fill_null(pa.compute.utf8_length(batch.column(3)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64()), chars], names=["doc_id", "source", "lang", "tokenizer", "tokens", "chars"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return plain.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long, chars long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("documents"), "tokens", "chars")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).alias("tokens"), (-F.col("chars")).alias("chars"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts before and after: a document may change its source, language or tokenizer version along with its counts."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _deltas(self) -> list[str]:
        fs, there = common.hadoop(self.spark, f"{self.folder}/deltas")
        return sorted(s.getPath().getName() for s in fs.listStatus(there)) if fs.exists(there) else []

    def committed(self, names: list[str] | None = None) -> set[str]:
        """Ids of the batches that count, of all deltas or of those listed."""
        out: set[str] = set()
        for name in self._deltas() if names is None else names:
            kind, _, rest = name.partition("=")
            if kind == "batch":
                out.add(rest)
            else:
                out |= {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/deltas/{name}/batches").collect()}
        return out

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits signed rows (see inserts, deletes, revisions) as a batch; False, and nothing done, if it is there already.

        Null keys are keys of their own. An empty batch commits an empty delta.
        """
        if not _BATCH.fullmatch(batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.committed():
            return False
        summed = changes.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS]).where(" OR ".join(f"{c} <> 0" for c in SUMS))
        staged = f"{self.folder}/staging/{batch}-{common.uuid.uuid4().hex}"
        summed.select(*KEYS, *SUMS).coalesce(1).write.parquet(f"{staged}/sums")
        return self._place(staged, f"batch={batch}")

    def _place(self, staged: str, name: str) -> bool:
        fs, there = common.hadoop(self.spark, staged)
        _, deltas = common.hadoop(self.spark, f"{self.folder}/deltas")
        _, final = common.hadoop(self.spark, f"{self.folder}/deltas/{name}")
        fs.mkdirs(deltas)
        if fs.exists(final) or not fs.rename(there, final):
            fs.delete(there, True)
            return False
        # where a rename onto a folder that has come up meanwhile moves into it, ours is inside and counts for nothing
        _, inside = common.hadoop(self.spark, f"{self.folder}/deltas/{name}/{there.getName()}")
        if fs.exists(inside):
            fs.delete(inside, True)
            return False
        return True

    def compact(self) -> None:
        """Replaces the deltas that are there by their sum; readers see the old deltas or the new one. A batch committed
        meanwhile is neither summed nor removed, as all steps go by one list. One compaction runs at a time."""
        names = self._deltas()
        if len(names) < 2:
            return
        staged = f"{self.folder}/staging/compact-{common.uuid.uuid4().hex}"
        self._summed(names).coalesce(1).write.parquet(f"{staged}/sums")
        self.spark.createDataFrame([(b,) for b in sorted(self.committed(names))], "batch string").coalesce(1).write.parquet(f"{staged}/batches")
        # a reader that lists while the old deltas go finds the marker and skips them
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.parquet(f"{staged}/replaces")
        self._place(staged, f"compacted={common.uuid.uuid4().hex}")
        common.remove(self.spark, *[f"{self.folder}/deltas/{n}" for n in names])

    def totals(self) -> DataFrame:
        """Totals by source, lang and tokenizer; keys whose documents, tokens and chars are all 0 are left out."""
        return self._summed(self._deltas())

    def _summed(self, names: list[str]) -> DataFrame:
        gone: set[str] = set()
        for n in names:
            if n.startswith("compacted="):
                gone |= {r[0] for r in self.spark.read.schema("name string").parquet(f"{self.folder}/deltas/{n}/replaces").collect()}
        paths = [f"{self.folder}/deltas/{n}/sums" for n in names if n not in gone]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS]).where(" OR ".join(f"{c} <> 0" for c in SUMS))
