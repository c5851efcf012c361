"""Exports: lines are built by column expressions and written by the executors; documents of bounded size on the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = {"severity": ("severity_rank", "file", "line", "id"), "file": ("file", "line", "id"), "source": ("source", "severity_rank", "id"), "timestamp": ("id",)}


def ordered(diagnostics: DataFrame, by: str = "severity") -> DataFrame:
    return diagnostics.orderBy(*ORDERS[by])


def csv_cell(value: Column) -> Column:
    """A quoted cell where it holds a comma, quote or line feed; null is the text null."""
    v = F.coalesce(value.cast("string"), F.lit("null"))
    return F.when(v.rlike('[,"\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(",", *(csv_cell(F.col(f"`{c}`")) for c in rows.columns)).alias("line"))


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("line"))


def markdown_entry() -> Column:
    """A diagnostic as two lines, with positions from 1."""
    place = F.concat_ws(":", "file", F.col("line") + 1, F.col("column") + 1)
    code = F.when(F.col("code").isNotNull(), F.concat(F.lit(" ("), F.col("code"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("### "), place, F.lit("\n**"), F.coalesce("source", F.lit("")), code, F.lit("**: "), F.coalesce("message", F.lit("")))


def markdown(diagnostics: DataFrame, important_only: bool = False) -> DataFrame:
    """(severity, file, id, entry): entries to be written in order; ``important_only`` keeps errors and warnings."""
    rows = diagnostics.where("severity_rank <= 2") if important_only else diagnostics
    return rows.select("severity", "file", "id", markdown_entry().alias("entry"))


def table_cell(value: Column, width: int = 50) -> Column:
    v = F.coalesce(value.cast("string"), F.lit("null"))
    return F.when(F.length(v) > width, F.concat(F.substring(v, 1, width - 3), F.lit("..."))).otherwise(v)


def table_lines(rows: DataFrame, width: int = 50) -> DataFrame:
    return rows.select(F.concat_ws(" | ", *(F.rpad(table_cell(F.col(f"`{c}`"), width), width, " ") for c in rows.columns)).alias("line"))


def to_format(rows: DataFrame, form: str) -> DataFrame:
    """Lines in json, csv, table or markdown."""
    if form == "markdown":
        return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")), F.lit("|"), F.lit("\\|")) for c in rows.columns)), F.lit(" |")).alias("line"))
    return {"json": json_lines, "csv": csv_lines, "table": table_lines}[form](rows)


def written(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines as text files, one a partition."""
    lines.write.mode(mode).text(path)


def appended(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Rows added to a parquet table, in folders by a column where one is named."""
    w = rows.write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def summary_lines(diagnostics: DataFrame) -> DataFrame:
    """(section, key, n): what a report says before its entries: diagnostics by severity, source and project, and files."""
    from glintflow.functions.text import project_of

    part = lambda section, key: F.struct(F.lit(section).alias("section"), F.coalesce(key, F.lit("unknown")).alias("key"))
    each = F.explode(F.array(part("severity", F.col("severity")), part("source", F.col("source")), part("project", project_of(F.col("file")))))
    counts = diagnostics.select(each.alias("s")).groupBy("s.section", "s.key").agg(F.count(F.lit(1)).alias("n"))
    files = diagnostics.agg(F.count_distinct("file").alias("n")).select(F.lit("files").alias("section"), F.lit("files").alias("key"), "n")
    return counts.unionByName(files)


def share_chart(rows: DataFrame, key: str, title: str) -> DataFrame:
    """(name, value, share, title): the bars or slices of a chart of counts."""
    n = rows.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    whole = n.agg(F.sum("value").alias("_w"))  # one row
    return n.join(F.broadcast(whole)).select("name", "value", F.round(F.col("value") / F.col("_w"), 9).alias("share"), F.lit(title).alias("title"))


def scatter_chart(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n): the distinct points of two columns with their numbers; rows without either are passed over."""
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def series_chart(series: DataFrame, x: str, ys: list[str], title: str) -> DataFrame:
    """(name, points) of each line of a chart; a series has a point a bucket."""
    point = F.struct(F.col(x).cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    each = F.explode(F.array(*(F.struct(F.lit(y).alias("name"), F.col(y).cast("double").alias("y")) for y in ys)))
    return series.select(x, each.alias("s")).select(x, "s.*").groupBy("name").agg(F.array_sort(F.collect_list(point)).alias("points")).withColumn("title", F.lit(title))


def chart_document(chart: DataFrame, kind: str, wrapper: str = "plain", most: int = 10_000) -> str:
    """A chart as a document for a charting library: plain, plotly, chartjs, vega, d3 or html. Of at most ``most`` series."""
    rows = [r.asDict(True) for r in chart.limit(most).collect()]
    if wrapper == "plotly":
        return json.dumps({"data": [{"type": "scatter" if kind == "line" else kind, "name": r["name"], "x": [p["x"] for p in r["points"]], "y": [p["y"] for p in r["points"]]} for r in rows]})
    if wrapper == "chartjs":
        return json.dumps({"type": kind, "data": {"datasets": [{"label": r["name"], "data": r["points"]} for r in rows]}})
    if wrapper == "vega":
        return json.dumps({"mark": kind, "data": {"values": [{"series": r["name"], **p} for r in rows for p in r["points"]]}})
    if wrapper == "d3":
        return json.dumps([{"series": r["name"], **p} for r in rows for p in r["points"]])
    plain = json.dumps({"kind": kind, "series": rows})
    return f"<script type='application/json'>{plain.replace('</', '<\\/')}</script>" if wrapper == "html" else plain
