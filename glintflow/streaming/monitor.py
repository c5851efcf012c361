"""Streams of diagnostics: windowed counts with watermarks, change-only output and a cache with a lifetime."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glintflow.schema import severity_rank


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A folder of parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(stream: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and severity; rows later than the watermark are passed over."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "severity").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "severity", "n")


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark: repeated deliveries are dropped and the state stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


class OnChange:
    """A sink for foreachBatch: hands a batch's result on only if it differs from the last one.

    The result is compared by a digest of all its rows, which is one number. With a folder (shared, like that of checkpoints) the last digest is
    kept in it, so that a restarted stream goes on where it was.
    """

    def __init__(self, make: Callable[[DataFrame], DataFrame], emit: Callable[[DataFrame, int], None], folder: str | None = None) -> None:
        self.make, self.emit, self.last, self.emitted, self.folder = make, emit, None, 0, folder

    def _known(self, spark: SparkSession) -> None:
        from pyspark.errors import AnalysisException

        if self.folder and self.last is None:
            try:
                r = spark.read.schema("number bigint, d string, n bigint").parquet(self.folder).orderBy(F.desc("number")).first()
                self.last = r and (r.d and Decimal(r.d), r.n)
            except AnalysisException:  # no folder yet
                self.last = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        self._known(batch.sparkSession)
        result = self.make(batch)
        digest = result.agg(F.sum(F.xxhash64(*result.columns).cast("decimal(38,0)")).alias("d"), F.count(F.lit(1)).alias("n")).first()
        if (digest.d, digest.n) != self.last:
            self.last = (digest.d, digest.n)
            self.emitted += 1
            self.emit(result, number)
            if self.folder:
                digest = None if self.last[0] is None else str(self.last[0])
                batch.sparkSession.createDataFrame([(number, digest, self.last[1])], "number bigint, d string, n bigint").coalesce(1).write.mode("append").parquet(self.folder)


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Each batch to all sinks; without an interval, what is there now and then the end."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for s in sinks:
                s(batch, number)
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if seconds is None else w.trigger(processingTime=f"{seconds} seconds")).start()


def subscribed(stream: DataFrame, query: Callable[[DataFrame], DataFrame], push: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """A query run anew on each batch, pushed when its answer changes."""
    return fan_out(stream, [OnChange(query, push)], checkpoint, seconds)


def changed_only(stream: DataFrame, seen: Callable[[], DataFrame], checkpoint: str, store: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Rows (file, hash, ...) whose file is new or has another hash than in ``seen``, batch by batch."""

    def keep(batch: DataFrame, number: int) -> None:
        known = seen().select("file", F.col("hash").alias("_h"))
        store(batch.join(known, "file", "left").where(F.col("_h").isNull() | (F.col("_h") != F.col("hash"))).drop("_h"), number)

    return fan_out(stream, [keep], checkpoint)


def worst(stream: DataFrame) -> DataFrame:
    """Errors and warnings of a stream."""
    return stream.where(severity_rank(F.col("severity")) <= 2)


def health_loop(stream: DataFrame, measured: Callable[[DataFrame], DataFrame], push: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """The health of components, worked out anew for each batch of their measurements: (component, score, status, issues, alerts)."""
    from glintflow.operators.health import alerts, component_scores

    def each(batch: DataFrame, number: int) -> None:
        m = measured(batch)
        raised = alerts(m).groupBy("component").agg(F.array_sort(F.collect_set("id")).alias("alerts"))  # one of four a component
        push(component_scores(m).join(raised, "component", "left"), number)

    return fan_out(stream, [each], checkpoint, seconds)
