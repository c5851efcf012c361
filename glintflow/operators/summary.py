"""Aggregates over diagnostics: summaries, percentiles, batches and process metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts_by(rows: DataFrame, key, name: str = "key", n: str = "n") -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias(n))


def summary(diagnostics: DataFrame) -> DataFrame:
    """Total, counts by severity, files and a map of counts by source.

    Two small partial results meet in one row; the map has an entry a distinct source.
    """
    n = lambda s: F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0))
    each = diagnostics.groupBy("file", "severity", "source").agg(F.count(F.lit(1)).alias("n"))
    by_source = each.groupBy("source").agg(F.sum("n").alias("n"), n("Error").alias("e"), n("Warning").alias("w"), n("Information").alias("i"), n("Hint").alias("h"))
    total = by_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"), F.coalesce(F.sum("i"), F.lit(0)).alias("infos"), F.coalesce(F.sum("h"), F.lit(0)).alias("hints"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("unknown")).alias("k"), F.col("n").alias("v"))))).alias("by_source"),
    )
    files = diagnostics.select(F.count_distinct("file").alias("files"))
    return total.withColumn("_k", F.lit(1)).join(files.withColumn("_k", F.lit(1)), "_k").drop("_k")


def positional_percentile(scores: DataFrame, value: str, key: str, shares: tuple[float, ...]) -> DataFrame:
    """Per key, the values at floor((n-1)·share) of the **descending** list; null values are passed over.

    Equal values are counted before anything is ordered: a key has a row a distinct value.
    """
    counted = scores.where(F.col(value).isNotNull()).groupBy(F.col(key), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(key)
    rows = counted.select(key, "_v", F.sum("_c").over(w.orderBy(F.desc("_v"))).alias("_upto"), F.sum("_c").over(w).alias("_n"))
    return rows.groupBy(key).agg(*(F.max(F.when(F.col("_upto") > F.floor((F.col("_n") - 1) * p), F.col("_v"))).alias(f"at_{int(p * 100)}") for p in shares))


def processing_metrics(records: DataFrame, now: int, seconds: int = 3600) -> DataFrame:
    """Hit rate, mean time, throughput and errors of the records (ts, hits, misses, millis, files, tasks, failed) of the last hour."""
    r = records.where((F.col("ts") >= now - seconds) & (F.col("ts") <= now))
    a = r.agg(F.count(F.lit(1)).alias("records"), F.sum("hits").alias("h"), F.sum("misses").alias("m"), F.avg("millis").alias("avg_millis"), F.sum("files").alias("files"), (F.max("ts") - F.min("ts")).alias("span"), F.avg("tasks").alias("tasks"), F.count_if("failed").alias("failed"))
    rate = F.coalesce(F.try_divide(F.col("files"), F.col("span")), F.lit(0.0))
    return a.select(
        "records", F.coalesce(F.try_divide(F.col("h"), F.col("h") + F.col("m")), F.lit(0.0)).alias("hit_rate"), F.coalesce("avg_millis", F.lit(0.0)).alias("avg_millis"), rate.alias("throughput"),
        F.when(F.col("tasks") > 1, rate / F.col("tasks")).when(F.col("records") > 0, 1.0).otherwise(0.0).alias("efficiency"), (F.col("failed") * (3600.0 / seconds)).alias("errors_per_hour"),
    )


def batch_stats(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(~F.col("failed")).alias("succeeded"), F.count_if("failed").alias("failed"), F.avg("millis").alias("avg_millis"))


def error_rate(times: DataFrame, now: int, seconds: int = 3600) -> DataFrame:
    """Errors a second over the last hour."""
    return times.agg((F.count_if((F.col("ts") > now - seconds) & (F.col("ts") <= now)) / float(seconds)).alias("errors_per_second"))


def memory_stats(runs: DataFrame) -> DataFrame:
    """Bytes freed in total and as a whole mean, mean time, and the last run's bytes."""
    return runs.agg(F.sum("bytes").alias("total_bytes"), F.floor(F.avg("bytes")).alias("avg_bytes"), F.avg("millis").alias("avg_millis"), F.max_by("bytes", F.struct("ts", "bytes")).alias("last_bytes"))


def main_language(files: DataFrame, key: str) -> DataFrame:
    """The language with most files of each key; ties go to the first name."""
    n = files.where("language <> 'unknown'").groupBy(key, "language").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min_by("language", F.struct(-F.col("n"), "language")).alias("main_language"), F.max("n").alias("files"))


def rate_limited(requests: DataFrame, most: int = 60, seconds: int = 60) -> DataFrame:
    """Whether each request (client, ts) is within the client's sliding window; a denied request counts as well.

    A client's requests are split by spans of ``seconds``; each is also context of the next span, so a busy client is many tasks.
    """
    span = F.expr(f"ts div {seconds}")
    w = Window.partitionBy("client", "_span").orderBy("ts").rangeBetween(-(seconds - 1), 0)
    rows = requests.withColumn("_own", span).withColumn("_span", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    return rows.withColumn("allowed", F.count(F.lit(1)).over(w) <= most).where("_span = _own").drop("_own", "_span")


def globally_limited(requests: DataFrame, most: int = 3000, seconds: int = 60) -> DataFrame:
    """Whether each request (id, ts) is let in by one limit over all: at most ``most`` that were let in within any ``seconds``; denied ones don't count.

    Each decision depends on the ones before, but only on their number by time: requests are counted by ts first, the fold runs over one
    row a tick in one task, and of the requests of a tick the first ones by id are let in.
    """
    from collections import deque
    from collections.abc import Iterator

    import pandas as pd

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: deque = deque()
        held = 0
        for b in batches:
            let = []
            for ts, n in zip(b["ts"].tolist(), b["n"].tolist(), strict=True):
                while recent and recent[0][0] <= ts - seconds:
                    held -= recent.popleft()[1]
                took = min(n, most - held)
                let.append(took)
                if took:
                    recent.append((ts, took))
                    held += took
            yield pd.DataFrame({"ts": b["ts"], "let": let})

    ticks = requests.where("ts IS NOT NULL").groupBy(F.col("ts").cast("bigint").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    let = ticks.repartition(1).sortWithinPartitions("ts").mapInPandas(fold, "ts bigint, let bigint")
    place = F.row_number().over(Window.partitionBy("ts").orderBy("id"))
    return requests.join(let, "ts").withColumn("allowed", place <= F.col("let")).drop("let")


def memory_pressure(used_bytes, most: int = 1 << 30):
    """Share of the memory that is used, at most 1."""
    return F.least(used_bytes / float(most), F.lit(1.0))


def moving_rate(outcomes: DataFrame, key: str, alpha: float = 0.1, start: float = 0.5) -> DataFrame:
    """Exponential moving average of outcomes (key, seq, success): a fold in order, in closed form.

    The weight of an outcome depends on how many follow it, so a number from the end and a sum replace the fold. Outcomes with a weight below
    what a double can show beside the others (1e-20) are left out before the shuffle, so that no key is ordered as a whole.
    """
    import math

    felt = math.ceil(math.log(1e-20) / math.log(1 - alpha))
    w = Window.partitionBy(key).orderBy(F.desc("seq"))
    rows = outcomes.select(key, F.row_number().over(w).alias("_i"), F.col("success").cast("double").alias("_s")).where(F.col("_i") <= felt)
    out = rows.groupBy(key).agg(F.sum(F.col("_s") * alpha * F.pow(F.lit(1 - alpha), F.col("_i") - 1)).alias("_e"), F.count(F.lit(1)).alias("_n"))
    return out.select(key, (F.col("_e") + start * F.pow(F.lit(1 - alpha), "_n")).alias("rate"))
