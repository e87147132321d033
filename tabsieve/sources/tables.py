"""Scans, sinks and content fingerprints."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.canonical import cell_text, has_map, with_row_halves
from tabsieve.functions.columns import is_text_type, quoted, to_number
from tabsieve.operators.valuecounts import row_key
from tabsieve.plans.columnwise import count_if, count_present, per_column
from tabsieve.sources.csvscan import scan_csv

# --- fixed values -----------------------------------------------------------
# Tokens a pandas CSV reader turns into missing values by default.
CSV_NA_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
SUPPORTED_EXTENSIONS: tuple[str, ...] = (".csv", ".parquet")
BOOLEAN_TEXT: tuple[str, ...] = ("True", "False", "TRUE", "FALSE", "true", "false")
# ---------------------------------------------------------------------------


class UnsupportedFileTypeError(ValueError):
    """Raised for a path whose extension has no reader."""


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = hadoop_path(spark, path)
    return bool(fs.exists(hpath))


def _extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def normalize_csv_nulls(df: DataFrame, tokens=CSV_NA_TOKENS) -> DataFrame:
    """Exact NA tokens -> null on text columns (decision D8)."""
    return df.select(*[
        F.when(quoted(f.name).isin(*tokens), F.lit(None).cast(f.dataType)).otherwise(quoted(f.name)).alias(f.name)
        if is_text_type(f.dataType) else quoted(f.name)
        for f in df.schema.fields
    ])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns whose non-null values all parse as long, double or
    boolean. One aggregate pass; one row per text column reaches the driver."""
    text = [f.name for f in df.schema.fields if is_text_type(f.dataType)]
    if not text:
        return df
    stats = {r["column"]: r for r in per_column(df, text, {
        "n": count_present(lambda c, dt: quoted(c)),
        "longs": count_present(lambda c, dt: quoted(c).try_cast("long")),
        "doubles": count_present(lambda c, dt: to_number(c)),
        "bools": count_if(lambda c, dt: quoted(c).isin(*BOOLEAN_TEXT)),
    }).collect()}  # one row per text column
    casts = {}
    for c in text:
        r = stats[c]
        if r["n"] == 0:
            continue
        if r["longs"] == r["n"]:
            casts[c] = quoted(c).cast("long")
        elif r["doubles"] == r["n"]:
            casts[c] = quoted(c).cast("double")
        elif r["bools"] == r["n"]:
            casts[c] = F.lower(quoted(c)) == F.lit("true")
    return df.select(*[casts.get(c, quoted(c)).alias(c) for c in df.columns])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               multi_line: bool | None = None) -> DataFrame:
    """Dispatch by extension; CSV gets pandas-like NA handling and type
    inference unless an explicit schema is given. A path written by
    ``versions.publish_table`` gives its current version.

    CSV files are split among tasks even where quoted fields hold line breaks
    (``csvscan``). ``multi_line=True`` is Spark's own reader with one task a
    file (it also bears quotes inside unquoted fields), ``multi_line=False``
    takes every line as a record."""
    ext = _extension(path)
    if ext not in SUPPORTED_EXTENSIONS:
        raise UnsupportedFileTypeError(f"Unsupported file type: {ext or '(none)'}")
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    from tabsieve.sources.versions import current_version
    return read_files(spark, current_version(spark, path) or path, ext, schema, multi_line)


def read_files(spark: SparkSession, paths: str | list[str], ext: str, schema: T.StructType | str | None = None,
               multi_line: bool | None = None) -> DataFrame:
    """Files or folders of one format as a table."""
    if ext == ".parquet":
        return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if multi_line is None:
        raw = scan_csv(spark, paths, schema)
    else:
        reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        raw = (reader if schema is None else reader.schema(schema)).csv(paths)
    raw = normalize_csv_nulls(raw)
    return infer_types(raw) if schema is None else raw


def save_files(df: DataFrame, path: str, fmt: str) -> None:
    """Writes a new folder of files."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        # Spark's CSV writer trims values by default; keep them as they are.
        writer = (writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
                  .option("ignoreTrailingWhiteSpace", False))
    writer.format(fmt).save(path)


def write_table_atomic(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """S3 for a plain target folder: write to a staging directory next to it,
    then swap it in by two renames, between which the target is missing for a
    moment (``versions.publish_table`` has no such gap).

    A failed write leaves the previous output untouched; the write itself
    uses Spark's job commit protocol, so partial task output never shows.
    """
    spark = df.sparkSession
    target = path.rstrip("/")
    staging = f"{target}.__staging_{uuid.uuid4().hex}"
    backup = f"{target}.__previous_{uuid.uuid4().hex}"
    try:
        save_files(df, staging, fmt)
    except Exception:
        fs, st = hadoop_path(spark, staging)
        if fs.exists(st):
            fs.delete(st, True)
        raise
    fs, tgt = hadoop_path(spark, target)
    _, st = hadoop_path(spark, staging)
    _, bk = hadoop_path(spark, backup)
    had_old = fs.exists(tgt)
    if had_old and not fs.rename(tgt, bk):
        fs.delete(st, True)
        raise OSError(f"could not move previous output {target} aside")
    try:
        published = fs.rename(st, tgt)
    except Exception:
        if had_old:
            fs.rename(bk, tgt)
        raise
    if not published:
        if had_old:
            fs.rename(bk, tgt)
        raise OSError(f"could not publish {staging} as {target}")
    if had_old:
        fs.delete(bk, True)
    return target


def shared_output_dir(spark: SparkSession) -> str:
    """A folder every executor and the driver can see: the cluster's
    checkpoint folder (``spark.checkpoint.dir``), else the SQL warehouse."""
    from tabsieve.plans.lineage import checkpoint_dir
    return (checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


HALVES = ("__fingerprint_low", "__fingerprint_high")


def fingerprint_aggregates() -> list[Column]:
    """``rows, low, high`` of a table with its row halves: row count and the
    sums of both halves of every row's 128-bit key (see ``functions.canonical``)."""
    zero = F.lit(0).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(half), zero).alias(name)
                                               for name, half in zip(("low", "high"), HALVES, strict=True)]]


def _fingerprint_text(df: DataFrame) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Content fingerprint that neither the order nor the partitioning of
    the rows changes: SHA-256 of the schema, the row count and two sums modulo
    2**64 over the MD5 halves of each row's canonical text. Any engine with
    MD5 can repeat it; rows are folded on the executors, MAP columns included."""
    folded = with_row_halves(df, *HALVES).agg(*fingerprint_aggregates())
    wrap = F.lit(str(1 << 64)).cast("decimal(38,0)")
    return folded.select(F.col("rows").alias("row_count"), F.sha2(F.concat_ws(
        "|", F.lit(_fingerprint_text(df)), F.col("rows").cast("string"), (F.col("low") % wrap).cast("string"),
        (F.col("high") % wrap).cast("string")), 256).alias("fingerprint"))


def fingerprint_value(df: DataFrame) -> str:
    return content_fingerprint(df).first()["fingerprint"]


class StaleDatasetError(ValueError):
    """The data no longer matches the fingerprint recorded for it."""


def pinned_files(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int, int]]:
    """``path, length, modification time`` of files, from their store."""
    out = []
    for path in paths:
        fs, hpath = hadoop_path(spark, path)
        status = fs.getFileStatus(hpath)
        out.append((path, status.getLen(), status.getModificationTime()))
    return out


class VerifiedScan:
    """A table read once, whose content is checked by the reading itself.

    The file list is pinned when the scan is made; files that come later are
    not read. ``frame`` folds the content fingerprint while its rows go by
    (``DataFrame.observe``), so whatever was read is what was checked."""

    def __init__(self, spark: SparkSession, path: str, expected_fingerprint: str):
        self.spark, self.path, self.expected = spark, path, expected_fingerprint
        listed = read_table(spark, path)
        self.files = pinned_files(spark, sorted(listed.inputFiles()))
        names = [f for f, _, _ in self.files]
        self.plain = read_files(spark, names, _extension(path), listed.schema) if names else listed
        self.observed = Observation(f"scan-{uuid.uuid4().hex}")
        self.frame = with_row_halves(self.plain, *HALVES).observe(
            self.observed, *fingerprint_aggregates()).select(*map(quoted, self.plain.columns))

    def run(self, action: Callable[[DataFrame], Any]) -> Any:
        """Runs ``action`` on ``frame``, which must read all its rows (a write,
        a full aggregate), and returns its result if the content was the
        expected one. Publish a result only after this has returned."""
        result = action(self.frame)
        seen = self.observed.get
        text = "|".join([_fingerprint_text(self.plain), str(seen["rows"]), str(int(seen["low"]) % (1 << 64)),
                         str(int(seen["high"]) % (1 << 64))])
        if hashlib.sha256(text.encode()).hexdigest() != self.expected and not self._unchanged():
            raise StaleDatasetError(f"{self.path} does not hold the content of fingerprint {self.expected}")
        return result

    def _unchanged(self) -> bool:
        """A task that ran twice is counted twice in an observation: if the
        files are the pinned ones, a scan of its own decides."""
        return (pinned_files(self.spark, [f for f, _, _ in self.files]) == self.files
                and fingerprint_value(self.plain) == self.expected)


def read_verified(spark: SparkSession, path: str, expected_fingerprint: str) -> DataFrame:
    """Refuse to hand out a table whose content changed. One scan checks
    the pinned files that the returned frame reads; use :class:`VerifiedScan`
    where the check has to be part of the reading."""
    scan = VerifiedScan(spark, path, expected_fingerprint)
    actual = fingerprint_value(scan.plain)
    if actual != expected_fingerprint:
        raise StaleDatasetError(f"Dataset fingerprint mismatch for {path}: {actual} != {expected_fingerprint}")
    return scan.plain


def dataset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset comparison, dtype-insensitive (right is cast to left; a
    value that cannot be cast equals none).

    Returns one row: left_only, right_only (row counts) and equal.
    """
    if sorted(left.columns) != sorted(right.columns) or len(left.columns) != len(right.columns):
        spark = left.sparkSession
        return spark.createDataFrame([(None, None, False)], "left_only long, right_only long, equal boolean")
    # One aggregate instead of two EXCEPT ALL (each a union plus an aggregate
    # of both tables): per distinct row, its multiplicity on each side. Rows
    # are grouped by a 128-bit key, so no cell is shuffled; nulls are part of
    # it like in EXCEPT ALL, and a row repeated many times collapses in the
    # map-side partial aggregate.
    kinds = {f.name: f.dataType for f in right.schema.fields}
    ours: list[Column] = []
    theirs: list[Column] = []
    for f in left.schema.fields:
        c, kind = quoted(f.name), kinds[f.name]
        if kind == f.dataType and not has_map(kind):
            ours.append(c)
            theirs.append(c)
        elif isinstance(kind, T.AtomicType) and isinstance(f.dataType, T.AtomicType):
            # a cell that does not become the left type is told apart by its text
            cast = c.try_cast(f.dataType)
            ours += [c, F.lit(None).cast("string")]
            theirs += [cast, F.when(cast.isNull(), c.cast("string"))]
        else:
            ours.append(cell_text(c, f.dataType))
            theirs.append(cell_text(c, kind))
    tagged = left.select(row_key(ours).alias("_row"), F.lit(1).alias("_in_left")).unionByName(
        right.select(row_key(theirs).alias("_row"), F.lit(0).alias("_in_left")))
    per_row = tagged.groupBy("_row").agg(F.sum("_in_left").alias("_nl"), F.count(F.lit(1)).alias("_n"))
    surplus = F.col("_nl") - (F.col("_n") - F.col("_nl"))
    both = per_row.agg(
        F.coalesce(F.sum(F.greatest(surplus, F.lit(0))), F.lit(0)).cast("long").alias("left_only"),
        F.coalesce(F.sum(F.greatest(-surplus, F.lit(0))), F.lit(0)).cast("long").alias("right_only"))
    return both.select(
        "left_only", "right_only",
        ((F.col("left_only") == 0) & (F.col("right_only") == 0)).alias("equal"))


def datasets_equal(left: DataFrame, right: DataFrame) -> bool:
    return bool(dataset_difference(left, right).first()["equal"])


def evidence_fingerprint(issues: DataFrame) -> DataFrame:
    """SHA-256 over the canonical JSON of every issue, ordered by id.

    The issue table is bounded by (#columns x #detectors), so the ordered
    fold of its rows is bounded by the schema, not by the data size.
    """
    line = F.to_json(F.struct(*[quoted(c) for c in sorted(issues.columns)]), {"ignoreNullFields": "false"})
    return issues.agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("issue_id"), line.alias("j")))),
                                        lambda s: s["j"]), "\n"), 256).alias("fingerprint"),
        F.count(F.lit(1)).alias("issue_count"),
    )
