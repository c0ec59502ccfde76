"""Mix sources to target weights by hash thresholds found in nested histograms.

Every row has a hash. Words are summed by source and leading digits of the hash;
the bucket in which a source's budget runs out is summed again by further
digits, until it holds one hash. Rows are then filtered against their source's
threshold; nothing is sorted, and a rerun takes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.tables import stash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: Fixed value: words are runs of anything but these characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits by which a histogram is finer than the one before: 4,096 buckets a source.
DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """32 hex digits from id and text."""
    return F.md5(F.concat_ws(":", doc_id.cast("string"), text))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each of ``docs`` (doc_id, text, source).

    ``taken`` is 0, size, ... up to ``repeats`` times size. Null text has size 0;
    a null source is a source of its own, the last one. Rows equal in id and text
    share their hash and are taken together. No rows in, no rows out.
    """
    rows = _sized(docs)
    rows = stash(rows.select("doc_id", "source", "size", "key"), "mix-rows")
    limits = thresholds(rows, weights, share, repeats)
    return _taken(rows, limits).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``docs`` as the mix takes them: left out, once, or up to ``repeats`` times. Texts without words are never taken."""
    names = docs.columns
    limits = thresholds(stash(_sized(docs).select("source", "size", "key"), "mix-rows"), weights, share, repeats)
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    sized = docs.select(whole, "source", words(F.col("text")).alias("size"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    taken = _taken(sized, limits).where("taken > 0")
    times = F.sequence(F.lit(1).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("long"))
    return taken.select("row", F.explode(times)).select("row.*")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), row_key(F.col("doc_id"), F.col("text")).alias("key"))


def _taken(rows: DataFrame, limits: DataFrame) -> DataFrame:
    limits = limits.withColumnRenamed("source", "of_source")
    copies = F.col("copies") + F.when(F.col("key") < F.col("limit"), 1).otherwise(0)
    return rows.join(limits, rows["source"].eqNullSafe(limits["of_source"])).withColumn("taken", F.col("size") * copies)


def thresholds(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target, copies, limit): all rows ``copies`` times, those with key < limit once more.

    ``rows`` has source, size and key. The row at which a budget runs out is
    taken if that comes nearer to the budget.
    """
    state = _targets(rows, weights, share, repeats)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = state.withColumn("copies", copies)
    state = state.withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    full = stash(state, "mix-sources")
    open_, done = full.select("source", "need", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below")), None
    digits = 0
    while True:
        at = open_.select(F.col("source").alias("of_source"), "need", "prefix", "below")
        inside = rows.join(at, rows["source"].eqNullSafe(at["of_source"]) & (F.substring("key", 1, digits) == at["prefix"]))
        digits += DIGITS
        bucket = F.substring("key", 1, digits).alias("bucket")
        sums = inside.groupBy("source", "need", "below", bucket).agg(F.sum("size").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        order = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.col("below") + F.sum("n").over(order)).withColumn("before", F.col("upto") - F.col("n"))
        edge = stash(sums.where("before <= need and need < upto"), "mix-edge")
        one = edge.where("low = high")
        nearer = F.col("before") + F.col("upto") < 2 * F.col("need")
        # "~" sorts after every hex digit, so the row itself is below the limit.
        ended = one.select("source", F.when(nearer, F.concat("low", F.lit("~"))).otherwise(F.col("low")).alias("limit"))
        done = ended if done is None else done.union(ended)
        open_ = edge.where("low < high").select("source", "need", F.col("bucket").alias("prefix"), F.col("before").alias("below"))
        if open_.isEmpty():
            break
    done = done.select(F.col("source").alias("of_source"), "limit")
    limits = full.join(done, full["source"].eqNullSafe(done["of_source"]), "left")
    return stash(limits.select("source", "source_size", "target", "copies", F.coalesce("limit", F.lit("")).alias("limit")), "mix-limits")


def _targets(rows: DataFrame, weights, share: float, repeats: int) -> DataFrame:
    """(source, source_size, weight, target). Only sums over the sources reach the driver, once a round of resharing."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    placed = stash(by_source.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-order")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row for each shuffle partition.
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = placed.join(starts, "part").withColumn("place", place)
    ranked = ranked.select("source", "source_size", F.element_at(table, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"))
    ranked = stash(ranked, "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped_before = 0.0, -1
    capped = F.lit(False)
    while True:
        left, weight, n = ranked.agg(
            F.lit(share * total) - F.coalesce(F.sum(F.when(capped, repeats * F.col("source_size"))), F.lit(0)),
            F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped),
        ).first()
        if n == capped_before or not weight:
            break
        level, capped_before = left / weight, n
        capped = F.col("weight") * F.lit(level) > repeats * F.col("source_size")
    most = (repeats * F.col("source_size")).cast("double")
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), most) if weight else most)


#: What ``mix`` returns with its defaults, for tables with a source; the sums run over rows sorted by the same hash.
SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  md5(concat_ws(':', doc_id::varchar, text)) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0, 1.0, 2.0][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::double as weight from s),
r as (select *, 2.0 * source_size / weight as ratio, sum(source_size) over () as total, sum(weight) over () as all_weight from w),
p as (select *, (1.5 * total - 2 * coalesce(sum(source_size) over b, 0))::double / (all_weight - coalesce(sum(weight) over b, 0))::double as level
      from r window b as (order by ratio, source rows between unbounded preceding and 1 preceding)),
l as (select min_by(level, ratio) as level from p where level <= ratio),
t as (select source, source_size, least(coalesce(weight * l.level, 2.0 * source_size), 2.0 * source_size)::double as target from w, l),
c as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as copies from t),
x as (select d.*, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size as need,
             sum(d.size) over (partition by d.source order by d.k range between unbounded preceding and current row) as upto,
             sum(d.size) over (partition by d.source, d.k) as own
      from d join c on d.source is not distinct from c.source)
select doc_id, size, source_size, target, (size * (copies + case when 2 * upto - own < 2 * need then 1 else 0 end))::bigint as taken from x
"""
