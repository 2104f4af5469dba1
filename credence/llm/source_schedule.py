"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of equal token counts are dealt to sources: slot ``i`` takes the golden-ratio
point ``frac(i * 0.618...)`` to the source in whose share of the cumulative targets
it falls, so every stretch of the schedule is mixed in proportion. The slots of a
source are ranked, and rank ``r`` takes the source's block ``r`` of equal tokens,
round and round, from its documents in shuffled order. A source's last slot ends
where its target does; what the points' small discrepancy leaves is added in closing
slots.

A source may hold a third of all documents: running sums go through hash buckets,
ranks through stretches of the schedule, so no window holds a whole source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import WORD, durable

#: Slots of a schedule: their number is fixed, so their size follows the corpus.
SLOTS = 1 << 18
#: Slots ranked in one window; cells that the unit interval is cut into to find the
#: source of a point; times a source may be repeated.
STRETCH, CELLS, MOST_EPOCHS = 4096, 4096, 3
GOLDEN = 0.6180339887498949


def words_in(text: Column) -> Column:
    """Words of a text, null counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (of the source, null apart from empty), size and the
    shuffled order of each document."""
    return docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
                       words_in(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("turn"))


def targets(rows: DataFrame) -> DataFrame:
    """key, number (by code point, null last), source_size, weight, target and wanted
    (its whole tokens) of every source: one row per source, whatever its size.

    Weights are 1, 2, 3, repeating. Sources whose target would exceed three times
    their size stop there, in the order of size over weight; the rest share what is
    left by weight."""
    sizes = rows.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    every = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("number", F.row_number().over(every)).withColumn("weight", (F.col("number") - 1) % 3 + 1)
    ratio = Window.orderBy((F.col("source_size") * MOST_EPOCHS / F.col("weight")), "number")
    before, whole = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * MOST_EPOCHS
    left = ranked.select("*", F.sum("source_size").over(whole).alias("total"), F.sum("weight").over(whole).alias("weights"),
                         F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"))
    stops = cap * (F.col("weights") - F.col("weight_before")) <= F.col("weight") * (F.col("total") - F.col("cap_before"))
    marked = left.withColumn("stops", stops)
    shared = marked.select("*", F.sum(F.when(F.col("stops"), cap).otherwise(0)).over(whole).alias("capped"), F.sum(F.when(F.col("stops"), F.col("weight")).otherwise(0)).over(whole).alias("capped_weight"))
    target = F.when(F.col("stops"), cap.cast("double")).otherwise((F.col("total") - F.col("capped")).cast("double") * F.col("weight") / (F.col("weights") - F.col("capped_weight")))
    return shared.select("key", "number", "source_size", "weight", target.alias("target"), F.floor(target + 0.5).cast("long").alias("wanted"), "total")


def schedule(sources: DataFrame, block: int, slots: int = SLOTS) -> DataFrame:
    """slot, key, rank, block (number) and words of every slot; closing slots have
    numbers from ``slots`` on. ``sources`` is the table of targets."""
    spark = sources.sparkSession
    live = sources.where("wanted > 0")
    order = Window.orderBy("number")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    high = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("target").over(whole)
    shares = live.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    shares = shares.withColumn("high", F.when(F.lead("number").over(order).isNull(), 2.0).otherwise(F.col("high")))
    cells = shares.select("key", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("int"), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)).alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    dealt = points.join(cells, "cell").where("point >= low and point < high").select("slot", "key", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    counts = dealt.groupBy("key", "stretch").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("key", "stretch").orderBy("slot"))
    ranked = dealt.withColumn("place", place).join(offsets, ["key", "stretch"]).select("slot", "key", (F.col("base") + F.col("place") - 1).alias("rank"))

    blocks = F.ceil(F.col("source_size") / block)
    needed = F.floor(F.col("wanted") / F.col("source_size")) * blocks + F.ceil((F.col("wanted") % F.col("source_size")) / block)
    sizes = live.select("key", "source_size", "wanted", blocks.alias("blocks"), needed.alias("needed"))
    given = counts.groupBy("key").agg(F.sum("n").alias("given"))
    short = sizes.join(given, "key", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < needed")
    closing = short.select(F.explode(F.sequence("given", F.col("needed") - 1)).alias("rank"), "key").select((F.col("rank") + slots).alias("slot"), "key", "rank")
    number = F.col("rank") % F.col("blocks")
    start = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + number * block
    words = F.least(F.lit(block), F.col("source_size") - number * block, F.col("wanted") - start)
    return ranked.unionByName(closing).join(sizes, "key").select("slot", "key", "rank", number.alias("block"), words.cast("long").alias("words")).where("words > 0")


def mixed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target (its source's)
    and taken: the tokens of it that the schedule takes, repeats counted, at most
    three times its size.

    Null sources are one source, the last; null and empty texts have size 0 and are
    never taken; a null id shuffles like an empty one. Repeated rows have turns of
    their own. The order of rows and partitions changes nothing."""
    rows = durable(measured(docs))
    sources = durable(targets(rows))
    total = sources.agg(F.max("total")).first()[0] or 0
    block = max(1, -(-total // slots))
    few = max(1, -(-total // block))
    slices = schedule(sources, block, few)
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    full = F.col("words") == length
    takes = (slices.join(sources.select("key", "source_size"), "key").groupBy("key", "block")
             .agg(F.sum(F.when(full, 1).otherwise(0)).alias("times"), F.sum(F.when(full, 0).otherwise(F.col("words"))).alias("part")))

    bucket = F.substring("turn", 1, 3)
    sums = rows.where("size > 0").groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "bucket").orderBy("turn", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.where("size > 0").withColumn("bucket", bucket).withColumn("end", F.sum("size").over(within))
              .join(bases, ["key", "bucket"]).withColumn("start", F.col("base") + F.col("end") - F.col("size")))
    pieces = placed.select("doc_id", "source", "key", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    first = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    last = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    words = F.coalesce(F.col("times") * (last - first) + F.greatest(F.least(last, F.col("part")) - first, F.lit(0)), F.lit(0))
    taken = (pieces.join(takes, ["key", "block"], "left").withColumn("words", words)
             .groupBy("doc_id", "source", "key", "size", "start").agg(F.sum("words").alias("taken")).drop("start"))
    blank = rows.where("size = 0").select("doc_id", "source", "key", "size", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(blank).join(sources.select("key", "source_size", "target"), "key").select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The documents of the mix, all columns: each stands as often as the schedule
    takes it, to the nearest whole document. Rows alike in id, source and size share
    what they take."""
    takes = mixed(docs).where("size > 0").groupBy("doc_id", "source", "size").agg(F.floor(F.sum("taken") / (F.count(F.lit(1)) * F.col("size")) + 0.5).cast("int").alias("times")).where("times > 0").alias("t")
    rows = docs.withColumn("__size", words_in(F.col("text"))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.__size") == F.col("t.size"))
    return rows.join(takes, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("t.times")))).select("d.*").drop("__size")


#: The same in SQL, by arithmetic on each source's repeated stream.
SQL = r"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM s0),
s2 AS (SELECT *, (number - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM s1),
s3 AS (SELECT *, sum(weight) OVER () AS weights,
              coalesce(sum(3 * source_size) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
       FROM s2 WINDOW w AS (ORDER BY source_size * 3 / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, 3 * source_size * (weights - weight_before) <= weight * (total - cap_before) AS stops FROM s3),
s5 AS (SELECT *, CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE)
                 ELSE CAST(total - sum(CASE WHEN stops THEN 3 * source_size ELSE 0 END) OVER () AS DOUBLE) * weight / (weights - sum(CASE WHEN stops THEN weight ELSE 0 END) OVER ()) END AS target FROM s4),
s AS (SELECT source, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS wanted FROM s5),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY turn, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM d)
SELECT doc_id, p.source, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (wanted // source_size) * size + greatest(least(start + size, wanted % source_size) - start, 0) END AS BIGINT) AS taken
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source
"""
