"""Mixing sources to target weights by systematic sampling.

Targets are water-filled in closed form: with sources in the order of
cap / weight, the first one that its share does not fill marks the level, and
prefix sums say how much the filled ones took. Within a source every word is
expected equally often, so each document expects target / source size copies;
prefix sums of the expected copies plus one random offset give a document one
copy per integer boundary crossed. Documents are laid out by size, so any run
of boundaries meets long and short ones alike and the words taken stay near
the target. The prefix sums come from a range-partitioned rank, never from
one task per source; what moves is ids and sizes, not text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.llm.common import WORD
from tabsieve.plans.lineage import materialize
from tabsieve.plans.ranking import cumulative_before

WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_ratio: int = 3) -> DataFrame:
    """``source, size`` rows -> one row per source: ``place`` (0-based, by code
    point, null last), ``source_size``, ``target``. A source of size zero has
    target zero. The windows run over one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("place", (F.row_number().over(by_name) - 1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_ratio).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    filled = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("level", (total - filled) / open_weight).withColumn("at", F.row_number().over(by_cap))
    stops = F.col("cap") / F.col("weight") >= F.col("level")
    per = per.withColumn("found", F.min(F.when(stops, F.struct("at", "level"))).over(Window.partitionBy()))
    return per.select("source", "place", "source_size", F.least(
        "cap", F.col("weight") * F.col("found.level")).alias("target"))


def _copies(docs: DataFrame, weights: Sequence[float], max_ratio: int) -> DataFrame:
    """``doc_id, source, size`` -> plus ``source_size, target, copies``."""
    # one row per source: bounded by the mix that the caller configures
    targets = materialize(source_targets(docs, weights, max_ratio))
    targets = targets.select(F.col("source").alias("_s"), "place", "source_size", "target")
    rows = docs.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("mark", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    # the row tag tells repeated rows apart, so that a crowd of them is no single slice
    rows = rows.withColumn("tag", F.monotonically_increasing_id())
    ranked = cumulative_before(rows, [F.col("size").desc(), F.col("mark"), F.col("doc_id"), F.col("tag")], ["place"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit("")).cast("binary")), 1, 8), 16, 10)
    offset = start.cast("double") / F.lit(4294967296.0)
    part = F.col("rate") - F.floor("rate")
    until = lambda n: F.floor(n.cast("double") * part + F.col("offset"))
    return ranked.withColumn("rate", rate).withColumn("offset", offset).withColumn(
        "copies", F.floor("rate") + until(F.col("cum_before") + 1) - until(F.col("cum_before")))


def sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"))


def mix_report(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_ratio: int = 3) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per document (plus
    ``copies``). A null or blank text has size zero and takes nothing; a null
    source is a source of its own; repeated rows are documents of their own;
    a null doc_id stays. The offset is a hash of the source's name and ties
    in size go by a hash of the id, so reruns agree."""
    out = _copies(materialize(sizes(docs)), weights, max_ratio)
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_ratio: int = 3) -> DataFrame:
    """The mixed documents: every row as often as it has copies, all columns
    unchanged. Rows that share a doc_id, source and size share out the copies
    dealt to them together (they differ by one copy at most), so the copies
    add up to those of :func:`mix_report`."""
    keys = ("doc_id", "source", "size")
    dealt = _copies(materialize(sizes(docs)), weights, max_ratio)
    dealt = dealt.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    dealt = materialize(dealt.where("copies > 0").withColumn("key", F.monotonically_increasing_id()))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("size", F.coalesce(F.regexp_count(F.col("row.text"), F.lit(WORD)), F.lit(0)).cast("long"))

    def met(part: DataFrame) -> DataFrame:
        same = [F.col(f"row.{c}").eqNullSafe(F.col(f"d.{c}")) for c in keys[:2]]
        found = rows.join(part.alias("d"), same[0] & same[1] & (rows["size"] == F.col("d.size")))
        return found.select("row", *[f"d.{c}" for c in part.columns if c not in keys])

    even = F.col("copies") % F.col("rows") == 0
    out = met(dealt.where(even)).select("row", (F.col("copies") / F.col("rows")).cast("long").alias("copies"))
    odd = dealt.where(~even)
    if odd.limit(1).count():  # repeated rows that differ in their copies are numbered
        # one rank over all of them, less the rows of the keys before: no key is a group
        odd = cumulative_before(odd, [F.col("key")], weight="rows").withColumnRenamed("cum_before", "earlier")
        tagged = materialize(met(odd.drop("group_total")).withColumn("tag", F.monotonically_increasing_id()))
        number = cumulative_before(tagged, [F.col("key"), F.col("tag")])
        until = lambda n: F.floor(n * F.col("copies") / F.col("rows"))
        at = (F.col("cum_before") - F.col("earlier")).cast("long")
        out = out.union(number.select("row", (until(at + 1) - until(at)).alias("copies")).where("copies > 0"))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return out.select("row", times.alias("copy")).select("row.*")


REPORT_SQL = """
with sized as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size
  from documents
), per as (
  select source, sum(size)::bigint as source_size,
         row_number() over (order by source asc nulls last) - 1 as place
  from sized group by source
), capped as (
  select *, case place % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
         (source_size * 3)::double as cap
  from per
), levels as (
  select *, row_number() over w as pos,
         (sum(source_size) over ()::double - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (w rows between current row and unbounded following) as level
  from capped window w as (order by cap / weight, place)
), targets as (
  select source, place, source_size,
         least(cap, weight * (select level from levels where cap / weight >= level order by pos limit 1)) as target
  from levels
), ranked as (
  select s.doc_id, s.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
         ('0x' || substr(md5(coalesce(s.source, '')), 1, 8))::bigint / 4294967296.0::double as start,
         row_number() over (partition by t.place order by s.size desc, md5(coalesce(s.doc_id::varchar, '')), s.doc_id) as n
  from sized s join targets t on s.source is not distinct from t.source
), dealt as (
  select *, (floor(rate) + floor(n::double * (rate - floor(rate)) + start)
             - floor((n - 1)::double * (rate - floor(rate)) + start))::bigint as copies
  from ranked
)
select doc_id, size::bigint as size, source_size, target, copies * size::bigint as taken, copies from dealt
"""
