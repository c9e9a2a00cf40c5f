"""Checks of stored inputs before a run."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.grid import channels

# Names under which the training data's product is recorded.
PRODUCTS = ["NCEP_NCAR", "NCEP_FNL", "FNL", "NCEP-FNL", "GDAS_FNL"]


def channel_names() -> list[str]:
    return [v if level is None else f"{v}_{int(level)}" for _, v, level in channels()]


def channel_list(stored: object, expected: list[str] | None = None) -> None:
    """ValueError with the first ten differences unless a stored list of channels is the expected one, in its order."""
    expected = channel_names() if expected is None else expected
    if not isinstance(stored, list):
        raise ValueError("not a list of channel names")
    wrong = [f"index {i}: expected {e}, found {a}" for i, (e, a) in enumerate(zip(expected, stored, strict=False)) if e != a][:10]
    if len(stored) != len(expected):
        wrong.append(f"{len(stored)} channels instead of {len(expected)}")
    if wrong:
        raise ValueError("; ".join(wrong))


def training_metadata(stored: object, *, patch: int, count: int = 137, allow_other: bool = False) -> bool:
    """Whether the data are of a known product; ValueError if channels or patch differ, or if not and it isn't allowed."""
    if not isinstance(stored, dict):
        raise ValueError("not a JSON object")
    for name, wanted in (("num_channels", count), ("patch_size", patch)):
        if int(stored.get(name, -1)) != wanted:
            raise ValueError(f"{name} is {stored.get(name)} instead of {wanted}")
    known = str(stored.get("dataset", "")).upper() in PRODUCTS
    if not known and not allow_other:
        raise ValueError(f"trained on {stored.get('dataset')!r}")
    return known


def inputs_there(spark: SparkSession, required: list[str], optional: list[str]) -> list[str]:
    """The optional paths that are missing; FileNotFoundError if a required one is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: (x := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(x)
    lacking = [p for p in required if not there(p)]
    if lacking:
        raise FileNotFoundError(", ".join(lacking))
    return [p for p in optional if not there(p)]


