"""Audit rows, their JSON-lines sink and source, and the statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MaskError
from . import detect

FIELDS = ("ts", "rule_id", "kind", "subtype", "policy", "placeholder", "request_host", "action", "match_source", "confidence", "confidence_score", "decoded_depth", "entropy")
READ_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("ts", "rule_id", "kind", "request_host", "action")] + [T.StructField("_corrupt_record", T.StringType())])


def audit_rows(masked_rows: DataFrame, host: Column, at: Column, action: str = "redacted") -> DataFrame:
    """A row for each replacement; it never holds the value."""
    each = detect.each(masked_rows, "replacements", host.alias("request_host"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    return each.select(
        "ts", "f.rule_id", "f.kind", "f.subtype", "f.policy", "f.placeholder", "request_host", F.lit(action).alias("action"),
        F.col("f.source").alias("match_source"), "f.confidence", F.col("f.score").alias("confidence_score"), F.col("f.depth").alias("decoded_depth"), "f.entropy",
    )


def append(rows: DataFrame, path: str | None) -> None:
    """Append rows as JSON lines below path; nothing without a path."""
    if path:
        rows.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows of JSON lines; absent fields are empty, blank lines no rows, a missing path no rows, a malformed line an error."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(file):
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in READ_SCHEMA.names[:-1]))
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", T.StructType(READ_SCHEMA.fields[:-1]), {"mode": "FAILFAST"}).alias("x"))
    return parsed.select(*(F.coalesce(f"x.{n}", F.lit("")).alias(n) for n in READ_SCHEMA.names[:-1]))


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of the lines that are no JSON object, over all splits of all files.

    Lines are numbered within their split, and a running sum of the splits' lines, a row each, gives the lines before it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value").withColumn("at", F.monotonically_increasing_id())
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = counts.select("file", "split", "first", (F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")).alias("before"))
    parsed = F.from_json("value", READ_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    bad = lines.where((F.trim("value") != "") & parsed["_corrupt_record"].isNotNull())
    return bad.join(before, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def checked(spark: SparkSession, path: str) -> DataFrame:
    """read, after a pass that raises an error with file and line if a line is malformed."""
    rows = read(spark, path)
    if rows.inputFiles():
        first = malformed(spark, path).orderBy("file", "line").first()
        if first is not None:
            raise MaskError(f"{first.file}:{first.line}: not an audit record", "invalid_json")
    return rows


def redacted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("action") == "redacted")


def totals(rows: DataFrame) -> DataFrame:
    """total_redactions and latest_event (null if no row has a time)."""
    return redacted(rows).agg(F.count("*").alias("total_redactions"), F.max(F.nullif("ts", F.lit(""))).alias("latest_event"))


def ranked(rows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """name and count, most frequent first, then by name; empty names don't count. limit is raised to 1 at least."""
    counts = redacted(rows).where(F.col(column) != "").groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count"))
    ordered = counts.orderBy(F.desc("count"), "name")
    return ordered if limit is None else ordered.limit(max(limit, 1))


def ranked_all(rows: DataFrame) -> DataFrame:
    """list (kind, rule_id or request_host), name and count, in one pass and one shuffle."""
    stacked = redacted(rows).select(F.stack(F.lit(3), F.lit("kind"), F.col("kind"), F.lit("rule_id"), F.col("rule_id"), F.lit("request_host"), F.col("request_host")).alias("list", "name"))
    return stacked.where(F.col("name") != "").groupBy("list", "name").agg(F.count("*").alias("count"))


def render(rows: DataFrame, path: str, limit: int = 5) -> str:
    """The report, as text."""
    total = totals(rows).first()
    out = [f"{total.total_redactions} masked values in {path}"]
    if total.latest_event:
        out.append(f"last at {total.latest_event}")
    for title, column in (("by kind", "kind"), ("by rule", "rule_id"), ("by host", "request_host")):
        top = ranked(rows, column, limit).collect()
        out += [title, *([f"  {r['count']} {r['name']}" for r in top] or ["  nothing"])]
    return "\n".join(out) + "\n"
