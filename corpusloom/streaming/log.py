"""Structured Streaming twins of the log operators."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators import ordered as O
from corpusloom.sources.tables import shared_folder, upsert

LATE = "1 hour"
#: A time beyond all others, at which a log is closed.
END = "9999-01-01 00:00:00"


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream of files, with an event time that watermarks take."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    folder, name = (path, "*.parquet") if files.getFileStatus(where).isDirectory() else path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def deduplicated(log: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Each key once; a repeated push within the watermark is a no-op."""
    return log.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def windows(log: DataFrame, width: str, step: str | None = None, late: str = LATE) -> DataFrame:
    w = F.window("at", width, step) if step else F.window("at", width)
    g = log.withWatermark("at", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(log: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """Sessions by user, each once the watermark has passed it, when its state goes; a closed log gives the last ones too."""
    log = log.withWatermark("at", late).where(F.col("at") < F.lit(END).cast("timestamp"))
    g = log.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def review_start() -> list:
    return [O.STABILITY_START, O.DIFFICULTY_START, 0, 0, 0]


def review_step(state: list, res: str, bf: float | None, clock: int) -> list:
    """One review of [stability, difficulty, reps, lapses, last], as the batch replay does it."""
    stab, diff, reps, lapses, _ = state
    grade = min(1.0, max(0.0, 1 - (0.5 if bf is None else bf)))
    harder = -O.EASE * (grade - O.PLAIN_GRADE) if res == "C" else O.HARDER_WRONG if res == "W" else O.HARDER_DEAD
    diff = min(O.DIFFICULTY_MOST, max(O.DIFFICULTY_LEAST, diff + harder))
    if res == "C":
        stab = min(O.STABILITY_MOST, stab * (1 + (11 - diff) / 10 * (O.PLAIN_GRADE + grade)))
    else:
        stab = max(O.STABILITY_LEAST, stab * O.FORGET)
    return [stab, diff, reps + 1, lapses + (res != "C"), clock]


class Ending:
    """A log that can be closed: a marker far ahead of all times moves the watermark past every open state."""

    def __init__(self, spark: SparkSession, log: DataFrame):
        self.spark, self.schema, self.folder = spark, log.schema, shared_folder(spark, "ending")
        spark.createDataFrame([], self.schema).write.parquet(self.folder)
        self.log = log.unionByName(spark.readStream.schema(self.schema).parquet(self.folder))

    def close(self) -> None:
        row = (F.lit(END if f.name == "at" else None).cast(f.dataType).alias(f.name) for f in self.schema.fields)
        self.spark.range(1).select(*row).write.mode("append").parquet(self.folder)


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start within keep their state in RocksDB, outside the heap, which timers and maps of state need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run(df: DataFrame, spark: SparkSession, mode: str = "append", ending: Ending | None = None) -> tuple[DataFrame, list]:
    """Drain a stream to the shared folder: its result as a table, and the progress of its batches.

    With an ``ending`` the drained log is then closed, and what was still open comes out.
    """
    at = shared_folder(spark, "stream")
    schema, progress = df.schema, []
    for last in (False, True) if ending else (True,):
        if ending and last:
            ending.close()
        writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
        if mode == "append":
            stream = writer.format("parquet").option("path", f"{at}/out").start()
        else:  # later batches hold newer states
            stream = writer.foreachBatch(lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{at}/out")).start()
            schema = StructType(list(df.schema.fields)).add("_batch", "long")
        stream.awaitTermination()
        progress += stream.recentProgress
    return spark.read.schema(schema).parquet(f"{at}/out"), progress


def drained(df: DataFrame, spark: SparkSession, mode: str = "append", ending: Ending | None = None) -> DataFrame:
    return run(df, spark, mode, ending)[0]


def latest(df: DataFrame, spark: SparkSession, keys: list[str]) -> DataFrame:
    """Run a stream in update mode, in which state behind the watermark is dropped, and keep each key's newest row."""
    return upsert(drained(df, spark, "update"), keys, [F.col("_batch")]).drop("_batch")
