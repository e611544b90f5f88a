"""Mixing sources to target weights by capped water-filling, in DataFrame functions.

Every source gets its weight's share of the total, but at most `most` times its own size; what a capped source leaves
is shared among the others by weight until none is above its cap. A source's documents are then taken as many whole
times as fit, and the rest of the target is a seeded sample of whole documents: those that come first in the order of
a seeded hash. The cut in that order is found from sums by source and hash bucket, and key by key in one bucket alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_PATTERN, written

EPOCHS, SEED = 3, 42

#: Key bits below a bucket's: keys have 60 bits, so there are 4,096 buckets a source.
BUCKET_SHIFT = 48

#: Sources that are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """docs with `size`, its number of words (null text: 0). docs must not have a column of that name."""
    if "size" in docs.columns:
        raise ValueError("docs already has ['size']")
    return docs.withColumn("size", F.coalesce(F.expr(f"regexp_count(text, r'{WORD_PATTERN}')"), F.lit(0)).cast("long"))


def keyed(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows with `_key`: 60 bits of the md5 of the seed, doc_id and size."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    return rows.withColumn("_key", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = EPOCHS) -> DataFrame:
    """source, source_size, target for sizes(source, source_size), a row a source.

    Sources in code-point order, null last, weigh `weights` in turn. A total of 0 makes all targets 0.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = sizes.withColumn("_w", w.cast("long"))
    x = x.withColumns({"_i": F.row_number().over(order), "_full": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)), "_used": F.coalesce(F.sum("_w").over(before), F.lit(0)), "_all": F.sum("source_size").over(everything), "_weights": F.sum("_w").over(everything)})
    x = x.withColumn("_level", (F.col("_all") - F.col("_full")) / (F.col("_weights") - F.col("_used")))
    x = x.withColumn("_fits", F.col("_w") * F.col("_level") <= most * F.col("source_size"))
    x = x.withColumn("_cut", F.min(F.when(F.col("_fits"), F.struct("_i", "_level"))).over(everything))
    return x.select("source", "source_size", F.when(F.col("_i") < F.col("_cut._i"), (most * F.col("source_size")).cast("double")).otherwise(F.col("_w") * F.col("_cut._level")).alias("target"))


def mix(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """rows with source_size, target, times (how often the mix takes the row) and taken (its words so taken).

    Needs doc_id, source and size (not null, 0 or more); rows must not have the columns that are added. What the cut needs
    of all rows is written first, as a narrow table, so a pass over rows and one more give the result. Rows equal in
    source, doc_id and size share a place in the order; where the cut falls among them, as many of them are taken as come
    nearest to the target, whatever their number. A source of size 0 has target 0 and its rows are taken 0 times. The words
    taken from a source miss its target by at most half of one document. No rows: no rows.
    """
    spark = rows.sparkSession
    own = rows.columns
    if clash := {"source_size", "target", "times", "taken", "_key", "_bucket", "_whole", "_last", "_more", "_many", "_part", "_rank"} & set(own):
        raise ValueError(f"rows already has {sorted(clash)}")
    keys = keyed(rows, seed)
    narrow = written(keys.select("source", "size", "_key"), "keys").withColumn("_bucket", F.shiftright("_key", BUCKET_SHIFT))
    buckets = narrow.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
    sizes = buckets.groupBy("source").agg(F.sum("_n").alias("source_size"))
    goal = targets(sizes, weights, most).withColumn("_whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("int"))
    goal = written(goal.withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size")), "goals")
    sources = goal.count()
    same = F.col("k.source").eqNullSafe(F.col("g.source"))
    over = Window.partitionBy("k.source").orderBy("_bucket")
    within = (F.col("_before") < F.col("_part")) & (F.col("_before") + F.col("_n") >= F.col("_part"))  # the cut falls here
    edge = buckets.alias("k").join(_small(goal, sources).alias("g"), same).withColumn("_before", F.sum("_n").over(over) - F.col("_n"))
    edge = edge.where(within).select(F.col("k.source"), "_bucket", "_before", "_part")
    inside = narrow.alias("k").join(_small(edge, sources).alias("g"), same & (F.col("k._bucket") == F.col("g._bucket")))
    inside = inside.groupBy(F.col("k.source").alias("source"), "_key", "_before", "_part").agg(F.sum("size").alias("_n"), F.count(F.lit(1)).alias("_many"))
    inside = inside.withColumn("_before", F.col("_before") + F.sum("_n").over(Window.partitionBy("source").orderBy("_key")) - F.col("_n")).where(within)
    more = F.least(F.floor((F.col("_part") - F.col("_before")) / (F.col("_n") / F.col("_many")) + 0.5), F.col("_many")).cast("long")
    cut = inside.select("source", F.col("_key").alias("_last"), more.alias("_more"), "_many")
    plan = goal.alias("k").join(_small(cut, sources).alias("g"), same, "left").select("k.*", "_last", "_more", "_many").drop("_part")
    plan = written(plan, "plan")
    out = keys.alias("k").join(_small(plan, sources).alias("g"), same, "left").select("k.*", "source_size", "target", "_whole", "_last", "_more", "_many")
    names = [F.col(f"`{c}`") for c in own]
    result = [*names, "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken")]
    whole = F.coalesce((F.col("_key") < F.col("_last")) | (F.col("_key") == F.col("_last")) & (F.col("_more") > 0), F.lit(False))
    decided = out.withColumn("times", F.col("_whole") + whole.cast("int"))
    if not plan.where("0 < _more and _more < _many").take(1):
        return decided.select(*result)
    split = F.coalesce((F.col("_key") == F.col("_last")) & (F.col("_more") > 0) & (F.col("_more") < F.col("_many")), F.lit(False))
    # Of the rows that the cut falls among, those with the first ranks are taken: ranks within parts, after the parts before.
    rest = written(out.where(split).withColumn("_part", F.spark_partition_id()), "cut")
    parts = rest.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("_part")) - F.col("_n")).drop("_n")
    ranked = rest.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "_part").orderBy("_key"))).alias("k")
    ranked = ranked.join(parts.alias("g"), same & (F.col("k._part") == F.col("g._part"))).select("k.*", "_before")
    taken = ranked.withColumn("times", F.col("_whole") + (F.col("_before") + F.col("_rank") <= F.col("_more")).cast("int"))
    return decided.where(~split).select(*result).unionByName(taken.select(*result))


def _small(df: DataFrame, sources: int) -> DataFrame:
    """For a table of at most a row a source."""
    return F.broadcast(df) if sources <= BROADCAST_SOURCES else df
