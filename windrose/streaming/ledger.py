"""Accumulation by parts (months) until there is enough, resumed after a lost driver.

A part's rows are written to a folder of their own name; the part is finished by an entry in the ledger, a small file that
names that folder and holds the part's totals, made under another name and renamed in one step. Rows without an entry, as
a driver leaves them that was lost between the two, are not part of the data and are cleared by the next run. So a part is
there whole, once, or not at all, and a run that begins again goes on with the first part that isn't finished.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession


class Ledger:
    """The finished parts under a folder that all executors share: ``ledger/`` with an entry for each, ``data/``.

    One driver writes at a time; of two that finish the same part, the second's entry is refused and its rows are cleared.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        there = self._path(f"{self.folder}/{kind}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(there)) if self.fs.exists(there) else []

    def entries(self) -> dict[str, dict]:
        """part: {"data": folder, "totals": {name: number}} of each finished part."""
        found = {}
        for name in self._names("ledger"):
            if name.endswith(".json"):
                stream = self.fs.open(self._path(f"{self.folder}/ledger/{name}"))
                try:
                    found[name.removesuffix(".json")] = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
                finally:
                    stream.close()
        return found

    def clear(self) -> list[str]:
        """Removes rows and files that no entry names; what was removed."""
        kept = {e["data"] for e in self.entries().values()}
        gone = [f"data/{n}" for n in self._names("data") if n not in kept] + [f"ledger/{n}" for n in self._names("ledger") if not n.endswith(".json")]
        for name in gone:
            self.fs.delete(self._path(f"{self.folder}/{name}"), True)
        return gone

    def finish(self, part: str, rows: DataFrame, totals: dict[str, Column]) -> dict:
        """Writes a part's rows, adds them up, and makes its entry; the entry that stands, if it was finished meanwhile."""
        if "/" in part or part.startswith("."):
            raise ValueError(f"not a name: {part}")
        data = f"{part}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/data/{data}")
        there = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/data/{data}")
        sums = there.agg(*[c.alias(n) for n, c in totals.items()]).first().asDict() if totals else {}
        entry = {"data": data, "totals": {n: v if v is not None else 0 for n, v in sums.items()}}
        staged, target = self._path(f"{self.folder}/ledger/{data}.tmp"), self._path(f"{self.folder}/ledger/{part}.json")
        self.fs.mkdirs(target.getParent())
        out = self.fs.create(staged, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(target).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(staged), self.fs.makeQualified(target), none)  # fails if the entry is there
        except Exception:
            if not self.fs.exists(target):
                raise
            self.fs.delete(self._path(f"{self.folder}/data/{data}"), True)
            self.fs.delete(staged, False)
        return self.entries()[part]

    def rows(self, schema) -> DataFrame:
        """The rows of all finished parts."""
        found = [f"{self.folder}/data/{e['data']}" for e in self.entries().values()]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)


def accumulate(spark: SparkSession, folder: str, parts: Iterable[str], build: Callable[[str], DataFrame], *, totals: dict[str, Column], enough: Callable[[dict], bool]) -> tuple[dict, list[str]]:
    """Builds part after part until ``enough`` holds for the running totals; these totals, and the parts built by this run.

    ``totals`` are aggregates of a part's rows that add up. Finished parts, of any run, count from the start and aren't
    built again; nothing is built if they are enough. An error of ``build`` ends the run and leaves earlier parts.
    """
    ledger = Ledger(spark, folder)
    ledger.clear()
    there = ledger.entries()
    sums = {n: sum(e["totals"].get(n, 0) for e in there.values()) for n in totals}
    built = []
    for part in parts:
        if enough(sums):
            break
        if part in there:
            continue
        entry = ledger.finish(part, build(part), totals)
        sums = {n: sums[n] + entry["totals"].get(n, 0) for n in totals}
        built.append(part)
    return sums, built
