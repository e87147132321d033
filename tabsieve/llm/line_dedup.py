"""Lines that many documents share, dropped from all but one of them.

Lines are exploded with a normalised key, keys are hashed, and documents are
counted per hash (map-side combined, so a line that every document holds is
one row per task). Only the hashes over the threshold go on; joined back with
the exploded lines they give each text the positions it loses. The remaining
positions, in order, pick the lines of the text's own array, so the work is
linear in the lines. The text itself is never exploded into a shuffle: what
moves is a hash and a position per long line, and each text once for the last
join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.common import lower_ascii
from tabsieve.plans.lineage import materialize

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Line without the six ASCII white-space characters at its ends, A-Z folded."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _hash(line: Column, min_chars: int) -> Column:
    """128-bit key of a line; null for a key too short to count."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key.cast("binary"))))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _mark(text: Column) -> Column:
    """128 bits that stand for a whole text."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b"))


def shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``key, keeper``: hash of every line key held by ``min_docs`` documents
    or more, with the largest doc_id that holds it. Rows with one doc_id are
    one document; the null id is one document too, smaller than any other."""
    keys = F.filter(F.transform(_lines(F.col("text")), lambda x: _hash(x, min_chars)), lambda h: h.isNotNull())
    lines = docs.select("doc_id", F.explode(F.array_distinct(keys)).alias("key"))
    per_doc = lines.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    return (per_doc.groupBy("key").agg(F.count("one").alias("n"), F.max("doc_id").alias("keeper"))
            .where(F.col("n") >= min_docs).select("key", "keeper"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All columns of ``docs`` as struct ``row``, with ``n_lines``,
    ``n_dropped`` and the remaining ``kept`` text, one row per document.

    A null or empty text is one empty line. Repeated rows lose and keep the
    same lines. Other columns are carried along untouched inside ``row``. A
    text is one row however long; the positions it loses are one array."""
    shared = materialize(shared_lines(docs, min_chars, min_docs))
    placed = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("at"), _hash(x, min_chars).alias("key")))
    held = docs.select("doc_id", _mark(F.col("text")).alias("mark"), F.explode(
        F.filter(placed, lambda p: p["key"].isNotNull())).alias("p")).select("doc_id", "mark", "p.at", "p.key")
    lost = held.join(shared, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # texts that come twice under one id have one array of positions
    lost = materialize(lost.groupBy("doc_id", "mark").agg(F.collect_set("at").alias("lost")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _mark(F.col("text")).alias("m"))
    joined = rows.join(lost, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark")), "left")

    def keep(lines: Column) -> Column:
        """Lines at the positions that are left (a hash set, order kept)."""
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    text = F.coalesce(F.col("row.text"), F.lit(""))
    n = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    # the one-element array binds the lines, so that the text is cut once
    kept = F.get(F.transform(F.array(_lines(F.col("row.text"))), keep), F.lit(0))
    return joined.select("row", n.alias("n_lines"), F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
                         F.when(F.col("lost").isNull(), text).otherwise(kept).alias("kept"))


def line_report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` per document."""
    return dedup_lines(docs, min_chars, min_docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


REPORT_SQL = """
with lines as (
  select doc_id, n as row_no, unnest(string_split(t, chr(10))) as line,
         generate_subscripts(string_split(t, chr(10)), 1) as pos
  from (select doc_id, row_number() over () as n, coalesce(text, '') as t from documents)
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), shared as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20
  group by key having count(distinct doc_id) + max(case when doc_id is null then 1 else 0 end) >= 3
), marked as (
  select k.*, s.key is not null and k.doc_id is distinct from s.keeper as lost
  from keyed k left join shared s on k.key = s.key
)
select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256
from marked group by doc_id, row_no
"""
