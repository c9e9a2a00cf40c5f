"""Streams: analyses as they land, six-hour windows, newest fix per storm."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landed(spark: SparkSession, folder: str, schema: str, *, most_files: int = 64) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def six_hour_counts(stream: DataFrame, *, ts: str, late: str = "72 hours", hours: int = 6, by: list[str] | None = None) -> DataFrame:
    """Rows by tumbling window; rows later than ``late`` are dropped once their window has gone out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, f"{hours} hours").alias("w"), *(by or [])).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *(by or []), "n")


def fresh(df: DataFrame, *, ts: str, now=None, hours: float = 72.0, future: float = 2.0) -> DataFrame:
    """Rows no older than ``hours`` and no more than ``future`` hours ahead, by the time of the batch (of the query, if it
    isn't a stream), or by ``now`` where a run is about a time of its own."""
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    age = (clock.cast("double") - F.col(ts).cast("timestamp").cast("double")) / 3600
    return df.where(age.between(-future, hours))


def newest_per_storm(stream: DataFrame, *, storm: str, ts: str, late: str = "72 hours", values: list[str]) -> DataFrame:
    """The newest fix of each storm, given out whenever a newer one comes. A state holds one row per storm and is dropped
    when nothing has come for ``late``."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = ", ".join(f"`{c}` {fields[c]}" for c in (storm, ts, *values))
    held = ", ".join(f"`{c}` {fields[c]}" for c in (ts, *values))
    wait = int(pd.Timedelta(late).total_seconds() * 1000)

    def newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = tuple(state.get) if state.exists else None
        changed = False
        for frame in frames:
            row = tuple(frame.sort_values([ts, *values]).iloc[-1][[ts, *values]])
            if best is None or row[0] > pd.Timestamp(best[0]):
                best, changed = row, True
        if changed:
            state.update(tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x for x in best))
        if best is not None:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(pd.Timestamp(best[0]).timestamp() * 1000)) + wait)
        if changed:
            yield pd.DataFrame([(*key, *best)], columns=[storm, ts, *values])

    return stream.withWatermark(ts, late).groupBy(storm).applyInPandasWithState(newest, out, held, "update", GroupStateTimeout.EventTimeTimeout)


def run_cycles(stream: DataFrame, cycle: Callable[[DataFrame, int], None], *, checkpoint: str, every: str | None = None):
    """Runs ``cycle`` on each batch, every so often, or once over all that has landed; its errors end the query, and a
    restart begins with the batch that failed."""
    w = stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
