"""Functions and models that travel to the workers once."""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_loaded: dict[str, object] = {}
#: Values that a worker keeps unpacked.
KEPT = 4


class Held:
    """A value, functions of any kind among them, as a broadcast that each worker process unpacks once."""

    def __init__(self, spark: SparkSession, value):
        self.name, self._packed = uuid.uuid4().hex, spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if self.name not in _loaded:
            while len(_loaded) >= KEPT:
                _loaded.pop(next(iter(_loaded)))
            _loaded[self.name] = cloudpickle.loads(self._packed.value)
        return _loaded[self.name]
