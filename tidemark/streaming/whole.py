"""Running aggregates over a stream without a key, as many tasks' work.

Keyed state would hold all rows of such a stream in one task. Here each micro-batch is a table: its rows and those
that wait are cut along their order like any table's (`ordering.running`), and only the aggregate of all rows so
far is carried on. Rows wait, as files in the shared folder, until the watermark has passed them; rows behind it are
late and left out. A micro-batch that is repeated after a failure writes its own folders anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..flow import Flow
from ..ordering import running

KINDS = {"sum": (F.sum, lambda a, b: a + b), "count": (F.count, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def _joined(kind: str, a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(KINDS[kind][1](a, b))


@dataclass
class Running:
    """A function for foreachBatch: adds `name` to the rows of `stream`, and writes them to out/<number of the batch> below `at`."""

    stream: Flow
    kind: str
    value: Column
    at: str
    name: str = "scan"

    def __post_init__(self):
        s = self.stream
        if self.kind not in KINDS:
            raise ValueError(f"a stream without a key has no running {self.kind}; known: {', '.join(KINDS)}")
        if s.key or s.time is None or s.order[0] != s.time or "spark.watermarkDelayMs" not in s.df.schema[s.time].metadata:
            raise ValueError("this needs a stream without a key, ordered by a time with a watermark")
        self.delay_us = 1000 * s.df.schema[s.time].metadata["spark.watermarkDelayMs"]
        self.columns = s.df.columns

    def __call__(self, df: DataFrame, n: int) -> None:
        spark, us = df.sparkSession, F.unix_micros(F.col(self.stream.time).cast("timestamp"))
        read = lambda what: spark.read.parquet(f"{self.at}/{what}/{n - 1}")
        rows = df.select(*self.columns)
        before, passed = None, None
        if n:
            before = read("carried")  # one row
            passed = before.collect()[0]["_passed"]
            rows = rows.filter(us.isNull() | (us >= passed) if passed is not None else F.lit(True)).unionByName(read("waiting"))
        latest = rows.agg(F.max(us)).collect()[0][0]
        passed = max((x for x in (passed, latest - self.delay_us if latest is not None else None) if x is not None), default=None)
        ready = us.isNull() | (us < passed) if passed is not None else us.isNull()
        rows.filter(~ready).write.mode("overwrite").parquet(f"{self.at}/waiting/{n}")
        rows = rows.filter(ready)
        total = rows.agg(KINDS[self.kind][0](self.value).alias("_all"))
        made = running(rows, self.stream.order, {self.name: (self.kind, self.value)}, wide=True)
        if n:
            made = made.crossJoin(F.broadcast(before.select("_all"))).withColumn(self.name, _joined(self.kind, F.col("_all"), F.col(self.name))).drop("_all")
            total = total.withColumnRenamed("_all", "_new").crossJoin(F.broadcast(before.select("_all"))).select(_joined(self.kind, F.col("_all"), F.col("_new")).alias("_all"))
        made.write.mode("overwrite").parquet(f"{self.at}/out/{n}")
        total.withColumn("_passed", F.lit(passed).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/carried/{n}")

    def result(self) -> DataFrame:
        return self.stream.df.sparkSession.read.parquet(f"{self.at}/out/*")
