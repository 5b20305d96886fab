"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A document's copies depend on its own row and one plan row of its source, so mixing neither sorts nor shuffles texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Sources in code point order, null last, have these weights in turn.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: The plan is broadcast up to so many sources, else joined.
BROADCAST_SOURCES = 100_000
#: Hexadecimal digits of a document's key that name its bucket: 4,096 buckets for each source.
BUCKET = 3


def words(text: Column) -> Column:
    """Number of words of the text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's place in its source's random order: 32 hexadecimal digits of (seed, id, text)."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), part(doc_id), F.md5(part(text))))


def turn_weights(sources: DataFrame, source: str = "source", weights=WEIGHTS) -> DataFrame:
    """sources (one row each) with a column weight: the given ones in turn, by code point, null last.

    The ranks need one order of all sources, so this window has one partition: a row for each source, no documents.
    """
    at = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    listed = F.array(*(F.lit(float(w)) for w in weights))
    return sources.withColumn("weight", F.get(listed, (at % len(weights)).cast("int")))


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS, total: float | None = None) -> DataFrame:
    """sources (source_size, weight, ...) with a column target; the targets sum to `total` (null: to all sizes).

    A source gets weight * level, at most max_epochs * source_size. Each round counts what the clamped sources take and
    raises the level of the others in proportion to their weights, until no further source is above its clamp; where
    all are clamped, the targets are the clamps. A round is one aggregation to one row, so any number of sources will do.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    first = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    want = float(total if total is not None else first[0] or 0)
    clamped, weight, level = 0.0, float(first[1] or 0), None
    while weight > 0:
        level = (want - clamped, weight)
        above = F.col("weight") * F.lit(level[0]) > cap * F.lit(level[1])
        row = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if (row[0] or 0.0) == clamped:
            break
        clamped, weight = float(row[0]), float(row[1] or 0)
    if weight <= 0 or level is None:
        return sources.withColumn("target", cap)
    above = F.col("weight") * F.lit(level[0]) > cap * F.lit(level[1])
    return sources.withColumn("target", F.when(above, cap).otherwise(F.col("weight") * F.lit(level[0]) / F.lit(level[1])))


def mix_plan(sized: DataFrame, max_epochs: float = MAX_EPOCHS, weigh=turn_weights) -> DataFrame:
    """One row for each source: source, source_size, target, whole, cut_key.

    sized has source, size, key. A document is taken `whole` times, and once more if its key is at most cut_key. The cut
    is where the sizes, summed in order of key, come nearest to target - whole * source_size. Bucket sums find the one
    bucket of each source that holds the cut; only that bucket's rows are sorted.
    """
    bucket = F.substring("key", 1, BUCKET).alias("bucket")
    sums = cut(sized.groupBy("source", bucket).agg(F.sum("size").alias("bucket_size")))
    sources = cut(weigh(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))))
    plan = water_fill(sources, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = cut(plan.withColumn("more", F.col("target") - F.col("whole") * F.col("source_size")).select("source", "source_size", "target", "whole", "more"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)))
    want = plan.select(F.col("source").alias("__source"), "more")
    at = sums.join(want, sums["source"].eqNullSafe(want["__source"])).where("before < more and more <= before + bucket_size").select("__source", F.col("bucket").alias("__bucket"), "before", "more")
    rows = sized.join(at, sized["source"].eqNullSafe(at["__source"]) & (F.substring("key", 1, BUCKET) == at["__bucket"]))
    own = rows.groupBy("__source", "__bucket", "before", "more", "key").agg(F.sum("size").alias("size"))
    inside = Window.partitionBy("__source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cuts = own.groupBy("__source").agg(F.coalesce(F.max(F.when(F.col("at") + F.col("size") / 2 <= F.col("more"), F.col("key"))), F.min("__bucket")).alias("cut_key"))
    return cut(plan.join(cuts, plan["source"].eqNullSafe(cuts["__source"]), "left").select("source", "source_size", "target", "whole", F.coalesce("cut_key", F.lit("")).alias("cut_key")))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    named = plan.select(F.col("source").alias("__source"), *(F.col(c).alias(f"__{c}") for c in ("source_size", "target", "whole", "cut_key")))
    few = plan.count() <= BROADCAST_SOURCES  # then neither texts nor a large source's rows move
    return rows.join(F.broadcast(named) if few else named, rows["source"].eqNullSafe(named["__source"]), "left")


def _copies() -> Column:
    return F.col("__whole") + (F.col("key") <= F.col("__cut_key")).cast("long")


def mix_report(docs: DataFrame, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: the words that the mix takes from it, repeats counted.

    Null and empty texts have size 0 and nothing to take. A null source is a source. Rows alike in id and text share one
    key: all or none of them get the fractional copy. An empty table has an empty report.
    """
    sized = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size"), draw_key(F.col("doc_id"), F.col("text"), seed).alias("key")))
    rows = _with_plan(sized, mix_plan(sized, max_epochs))
    return rows.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * _copies()).alias("taken"))


def mix_documents(docs: DataFrame, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns kept."""
    key = draw_key(F.col("doc_id"), F.col("text"), seed).alias("key")
    sized = cut(docs.select("source", words(F.col("text")).alias("size"), key))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "source", key)
    rows = _with_plan(rows, mix_plan(sized, max_epochs)).withColumn("__n", _copies().cast("int")).where("__n > 0")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return rows.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))


ORACLE = r"""
with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5('17:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key from documents),
src as (select source, sum(size)::bigint as source_size from s group by source),
w as (select *, ([5.0, 2.0, 1.0])[1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight from src),
o as (select *, row_number() over (order by 3.0 * source_size / weight, source nulls last) as i from w),
c as (select *, (select sum(source_size) from src)::double - coalesce(sum(3 * source_size) over (order by i rows between unbounded preceding and 1 preceding), 0)::double as rest, sum(weight) over (order by i rows between current row and unbounded following)::double as wrest from o),
l as (select rest, wrest from c where not (weight * rest > 3.0 * source_size * wrest) order by i limit 1),
t as (select source, source_size, case when weight * l.rest > 3.0 * source_size * l.wrest then 3.0 * source_size else weight * l.rest / l.wrest end::double as target from c, l),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole, target - case when source_size > 0 then floor(target / source_size) else 0 end::bigint * source_size as more from t),
d as (select s.*, p.source_size, p.target, p.whole, p.more, coalesce(sum(s.size) over (partition by s.source order by key rows between unbounded preceding and 1 preceding), 0) as upto from s join p on s.source is not distinct from p.source)
select doc_id, size, source_size, target, (size * (whole + case when more > 0 and upto + size / 2.0 <= more then 1 else 0 end))::bigint as taken from d
"""
