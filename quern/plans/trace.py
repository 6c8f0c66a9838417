"""What each step of a plan did, gathered while it ran: rows, characters and seconds, without further jobs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import written

_TEXTS = ("text", "compressed", "answer")


class Trace:
    """Takes the place of ``save`` in a plan: every step that is written is observed on its way.

    The counts are metrics of the very job that writes the step. Steps that are written under one name, as by two passes, are numbered.
    """

    def __init__(self, save=written):
        self.inner, self.steps, self.began = save, [], time.perf_counter()

    def __call__(self, df: DataFrame, name: str = "step") -> DataFrame:
        seen, start = Observation(), time.perf_counter()
        chars = [F.coalesce(F.sum(F.length(c)), F.lit(0)).alias(f"chars_{c}") for c in _TEXTS if dict(df.dtypes).get(c) == "string"]
        out = self.inner(df.observe(seen, F.count(F.lit(1)).alias("rows"), *chars))
        got = seen.get
        passes = sum(s["step"] == name for s in self.steps)
        self.steps.append({"no": len(self.steps) + 1, "step": name, "pass": passes + 1, "rows": got["rows"], "chars": {c: got[f"chars_{c}"] for c in _TEXTS if f"chars_{c}" in got}, "seconds": time.perf_counter() - start, "since_start": time.perf_counter() - self.began})
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        """(no, step, pass, rows, chars, seconds, since_start), a row for each step."""
        kinds = T.StructType.fromDDL("no int, step string, pass int, rows long, chars map<string,long>, seconds double, since_start double")
        return spark.createDataFrame([tuple(s[f.name] for f in kinds) for s in self.steps], kinds)

    def ratio(self, before: str = "picked", after: str = "compressed") -> float:
        """Characters after the second step for each one before it, over all passes; 1 where there were none."""
        total = lambda step, c: sum(s["chars"].get(c, 0) for s in self.steps if s["step"] == step)
        return total(after, "compressed") / total(before, "text") if total(before, "text") else 1.0
