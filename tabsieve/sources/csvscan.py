"""CSV scan that splits files whose quoted fields hold line breaks.

Spark reads such a file in one task (``multiLine``), because a byte range alone
does not tell whether it begins inside a quoted field. Here the lines are read
in ordinary splits, and three small steps find that out:

1. one aggregate counts, per split, the lines with an odd number of quotes;
2. a running sum over the splits of a file gives the parity at every split's
   start (one row a split);
3. a line that begins at even parity begins a record. Splits at even parity
   without odd lines are records line by line and move nowhere. Only the lines
   of the other splits are shuffled, by split, for the parity inside it, and
   only the lines of records that span several are put together.

Fields must be quoted as RFC 4180 says: a quote stands only around a field or
doubled inside one. A file with an open quote at its end is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.plans.lineage import materialize
from tabsieve.plans.ranking import cumulative_before

BROADCAST_SPLITS = 100_000  # rows of about 200 bytes (path, offset, three numbers)


class UnclosedQuoteError(ValueError):
    """A quoted field that the file never closes."""


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, split, line, value, odd``; line ids rise within a split."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"), "value")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return raw.withColumn("odd", (quotes % 2).cast("int"))


def _splits(lines: DataFrame) -> DataFrame:
    """Per split: its first line, odd lines and the odd lines before it."""
    totals = lines.groupBy("file", "split").agg(F.min("line").alias("first"), F.sum("odd").alias("odds"))
    ranked = materialize(cumulative_before(totals, [F.col("split")], ["file"], "odds"))
    open_file = ranked.where(F.col("group_total") % 2 == 1).select("file").first()
    if open_file:
        raise UnclosedQuoteError(f"a quoted field is not closed in {open_file['file']}")
    out = ranked.select("file", "split", "first", F.col("cum_before").alias("odd_before"),
                        ((F.col("odds") > 0) | (F.col("cum_before") % 2 == 1)).alias("mixed"))
    return F.broadcast(out) if ranked.count() <= BROADCAST_SPLITS else out


def _joined_lines(mixed: DataFrame) -> DataFrame:
    """Records of splits where some line begins inside a quoted field."""
    order = Window.partitionBy("file", "split").orderBy("line")
    seen = F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = (F.col("odd_before") + seen) % 2 == 1
    lines = mixed.withColumn("inside", inside)
    begin = F.last(F.when(~F.col("inside"), F.col("line")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = lines.withColumn("begin", begin)
    # a split that starts inside a record continues the last one begun before it: one row a split
    last = lines.groupBy("file", "split").agg(F.max(F.when(~F.col("inside"), F.col("line"))).alias("last_begin"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "split", F.last("last_begin", ignorenulls=True).over(earlier).alias("carried"))
    lines = lines.join(carried, ["file", "split"]).withColumn("begin", F.coalesce("begin", "carried"))
    whole = lines.where(~F.col("inside") & (F.col("odd") == 0)).select("line", "first", "split", "value")
    parts = lines.where(F.col("inside") | (F.col("odd") == 1)).groupBy("file", "begin").agg(
        F.array_sort(F.collect_list(F.struct("split", "line", "value"))).alias("parts"),
        F.min(F.struct("split", "first")).alias("at"))
    spanning = parts.select(F.col("begin").alias("line"), F.col("at.first").alias("first"), F.col("at.split").alias("split"),
                            F.array_join(F.col("parts.value"), "\n").alias("value"))
    return whole.union(spanning)


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value``: every record of the files under ``path`` as text, line breaks
    of quoted fields included, without each file's header and blank lines."""
    lines = _lines(spark, path)
    marked = lines.join(_splits(lines), ["file", "split"])
    plain = marked.where(~F.col("mixed")).select("line", "first", "split", "value")
    records = plain.union(_joined_lines(marked.where("mixed")))
    header = (F.col("split") == 0) & (F.col("line") == F.col("first"))
    value = F.regexp_replace("value", "\\r\\z", "")
    return records.where(~header).select(value.alias("value")).where(F.trim("value") != "")


def scan_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """The table under ``path``, every column text unless ``schema`` is given
    (columns by position). A record with fewer fields ends in nulls, further
    fields are dropped, as in Spark's reader. Files without a header are empty."""
    options = {"escape": '"', "header": "true", "multiLine": "true"}
    reader = spark.read.options(**options)
    if schema is None:  # reads the first record of one file
        schema = reader.csv(path).schema
        if not schema.fields:
            return reader.csv(path)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    records = csv_records(spark, path)
    text = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = records.select(F.from_csv("value", F.lit(text), {"escape": '"'}).alias("r"))
    return parsed.select(*[F.col("r").getField(f.name).alias(f.name) for f in schema.fields])
