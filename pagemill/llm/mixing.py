"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. Native plans only.

A source's documents, in a seeded order, form an endless stream of words (the order repeats). The stream is
dealt in blocks of block_words words; sources get blocks by highest quotients target / (2 k + 1), and the
sequence of awards is cut into shards, so each shard has an integer quota from each source. Only the awards
near each cut are worked out, so the cost follows the number of sources, not that of blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

CELL_ROWS = 100_000


def targets(sources: DataFrame, weights: tuple[float, ...], most: float = 3.0) -> DataFrame:
    """sources (source, source_size) with place, weight and target; all sizes are shared out by weight.

    No target is above most times its source's size: what is over is shared among the others by weight, until
    none is above. That is the level at which the sum of min(weight * level, most * size) is the sum of sizes;
    one pass in the order of most * size / weight finds it. Sources weigh by code point, null last.
    """
    # One row for each source: a table of the sources, not of the documents.
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    w = sources.withColumn("place", place).withColumn("weight", weight)
    w = w.withColumns({"cap": most * F.col("source_size"), "all": F.sum("source_size").over(Window.partitionBy())})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    here = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"capped": F.coalesce(F.sum("cap").over(here), F.lit(0.0)), "lighter": F.coalesce(F.sum("weight").over(here), F.lit(0.0)), "heavy": F.sum("weight").over(Window.partitionBy())})
    # The level if this source and all later ones stay below their caps.
    level = (F.col("all") - F.col("capped")) / (F.col("heavy") - F.col("lighter"))
    w = w.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    w = w.withColumn("level", F.first("level", ignorenulls=True).over(Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap")))
    # Whole words in all targets together: a sum of whole numbers, the same in any order.
    total = F.least(F.col("all"), F.sum(F.floor("cap")).over(Window.partitionBy()))
    return w.select("source", "source_size", "place", "weight", F.coalesce(share, F.lit(0.0)).alias("target"), total.cast("long").alias("all_words"))


def quotas(goals: DataFrame, block_words: int, shards: int) -> DataFrame:
    """place, shard (from 0) and total: blocks awarded to the source in all shards up to this one, by highest quotients.

    With time t, a source has had floor(t * target + 1/2) awards, award k coming at (k + 1/2) / target. For each
    cut, t is set to what would be right without rounding; the awards within the rounding error of it are sorted,
    and as many as are missing (or too many) are added (or taken back).
    """
    every = Window.partitionBy()
    live = goals.where("target > 0").select("place", "target", F.col("all_words").alias("all"), F.count("*").over(every).alias("sources"))
    blocks = F.floor(F.col("all") / block_words + 0.5)
    near = live.withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("seats", F.floor(blocks * F.col("cut") / shards))
    near = near.withColumn("at", F.floor(F.col("seats") / F.col("all") * F.col("target") + 0.5))
    per_cut = Window.partitionBy("cut")
    near = near.withColumn("missing", F.col("seats") - F.sum("at").over(per_cut))
    span = F.ceil((1.5 * F.col("sources") + 2) * F.col("target") / F.col("all")) + 1
    award = near.withColumn("k", F.explode(F.sequence(F.greatest(F.col("at") - span, F.lit(0)), F.col("at") + span)))
    award = award.withColumns({"when": (2 * F.col("k") + 1) / (2 * F.col("target")), "later": F.col("k") >= F.col("at")})
    turn = Window.partitionBy("cut", "later").orderBy(F.when(F.col("later"), F.col("when")).otherwise(-F.col("when")), F.when(F.col("later"), F.col("place")).otherwise(-F.col("place")))
    award = award.withColumn("turn", F.row_number().over(turn))
    change = F.sum(F.when(F.col("later") & (F.col("turn") <= F.col("missing")), 1).when(~F.col("later") & (F.col("turn") <= -F.col("missing")), -1).otherwise(0))
    found = award.groupBy("place", "cut").agg((F.first("at") + change).cast("long").alias("total"))
    return found.select("place", (F.col("cut") - 1).cast("int").alias("shard"), "total")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, block_words: int = 8, shards: int = 16, seed: str = "mix", row_id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, quotas): for each row of docs what the mix takes of it, and each shard's quota of blocks from each source.

    rows: row_id, source, size, key, source_size, target, taken (words, repeats counted), stream_from (where
    the row begins in its source's stream) and shards (an array: shard, and the words that it takes of the row). Null sources form one source; null, empty and blank texts have size
    0 and nothing is taken; very long ones are counted whole, and may be taken in part; repeated rows are rows of their own; rows
    alike in id and text are in any order, as what is taken of them is alike; an empty table gives empty results. Other columns
    are ignored, whatever they are called.
    """
    rows = docs.select(F.col(row_id).alias("row_id"), F.col(source).cast("string").alias("source"), shared.words_of(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("content"))
    rows = shared.cut(rows.withColumn("key", shared.seeded_key(seed, F.col("row_id"), F.col("content"))), "mix")
    rows = rows.withColumns({"s": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
    sources = rows.groupBy("s", "none").agg(F.sum("size").alias("source_size")).withColumn("source", F.when(~F.col("none"), F.col("s")))
    goals = shared.cut(targets(sources.select("source", "source_size"), weights, most), "mix-goals")
    shares = quotas(goals, block_words, shards)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("shard", "total"))), lambda x: x["total"] * block_words)
    # One number for each shard: an array of fixed length.
    got = shares.groupBy("place").agg((F.max("total") * block_words).alias("got"), listed.alias("ends"))
    plan = goals.join(got, "place", "left").withColumn("got", F.least(F.coalesce("got", F.lit(0)), most * F.col("source_size")))
    plan = plan.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "source_size", "target", "got", "ends")
    cells = max(256, rows.count() // CELL_ROWS)
    rows = rows.withColumn("bucket", shared.key_bucket(F.col("key"), cells))
    placed = shared.prefix_within(rows, ["s", "none"], "bucket", ["key", "row_id", "size"], "size").join(plan, ["s", "none"])
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("got") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("got") - turns * F.col("source_size")
    taken = turns * F.col("size") + F.greatest(F.least(F.col("before") + F.col("size"), rest) - F.col("before"), F.lit(0))
    # What shard i takes of a row: the parts of the row's turns that lie between the ends of shards i - 1 and i.
    first = lambda t: F.col("before") + t * F.col("source_size")
    part = lambda t, lo, hi: F.greatest(F.least(first(t) + F.col("size"), hi, F.col("got")) - F.greatest(first(t), lo), F.lit(0))
    words = lambda lo, hi: F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long")), F.lit(0).cast("long"), lambda a, t: a + part(t, lo, hi).cast("long"))
    each = F.transform("ends", lambda hi, i: F.struct(i.cast("int").alias("shard"), words(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at("ends", F.greatest(i, F.lit(1)))), hi).alias("words")))
    shards_ = F.when(F.col("size") > 0, F.filter(each, lambda x: x["words"] > 0))
    out = placed.select(F.col("row_id").alias(row_id), "source", "size", "key", F.col("source_size").cast("long"), "target", taken.cast("long").alias("taken"), F.col("before").alias("stream_from"), F.coalesce(shards_, F.array().cast("array<struct<shard:int,words:bigint>>")).alias("shards"))
    return out, goals.join(shares, "place").select("source", "shard", "total")
