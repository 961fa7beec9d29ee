"""Merkle manifest of a table: a digest for each row, a tree for each group, a tree over the groups, a proof for each row.

The trees are built bottom-up: a level's nodes are grouped in runs of FANOUT, and each level is written to the shared
folder. Proofs are pushed top-down: a run joins what its parent inherited, and each child puts its siblings before
that. Runs are keyed by (group, place), so no key has more than FANOUT rows, however large a group is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

FANOUT = 16
#: Rows in a range of the sorted table, about; never more ranges than MOST.
RANGE_ROWS = 100_000
LEAST, MOST = 8, 65_536
#: Bits that Spark's increasing ids keep for the place of a row in its partition.
PLACE_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as its bytes' count, a colon and its value, or `-` for null."""
    return digest(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (x.cast("string") for x in fields)])


def fold(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, start, lambda h, x: digest(x["left"], h, x["right"]))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(proof, lambda x: F.concat(x["left"], x["right"]))), 256)


def _placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows (from written files) with i, the place in their group from 0, and n, the group's rows.

    Rows are sorted in ranges over all groups; a group takes part of a range or several, and its places in each begin
    where the earlier ranges end.
    """
    ranges = min(MOST, max(LEAST, rows.count() // RANGE_ROWS))
    ordered = rows.repartitionByRange(ranges, *group, *order).sortWithinPartitions(*group, *order)
    ordered = shared.cut(ordered.withColumn("at", F.monotonically_increasing_id()), "ranges").withColumn("range", F.shiftright("at", PLACE_BITS))
    whole, earlier = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cells = ordered.groupBy(*group, "range").agg(F.count("*").alias("own"), F.min("at").alias("first"))
    cells = cells.select(*group, "range", "first", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"), F.sum("own").over(whole).alias("n"))
    return ordered.join(cells, [*group, "range"]).withColumn("i", F.col("before") + F.col("at") - F.col("first")).drop("at", "range", "first", "before")


def _parents(n: str = "n") -> Column:
    return F.ceil(F.col(n) / FANOUT).cast("long")


def _runs(nodes: DataFrame, group: list[str], also: list[str]) -> DataFrame:
    """Runs of FANOUT nodes (group, i, n, h): their place j, kids in order, and the parent's digest h (a lone node's own)."""
    kids = F.sort_array(F.collect_list(F.struct("i", "h", *also)))
    runs = nodes.groupBy(*group, "n", F.floor(F.col("i") / FANOUT).cast("long").alias("j")).agg(kids.alias("kids"))
    return runs.withColumn("h", F.when(F.col("n") == 1, F.col("kids")[0]["h"]).otherwise(F.sha2(F.concat_ws("", F.col("kids")["h"]), 256)))


def _levels(nodes: DataFrame, group: list[str], also: list[str], name: str) -> list[DataFrame]:
    """Written runs of each level, from the leaves up; a group's last level is that with one run."""
    levels = [shared.cut(_runs(nodes, group, also), f"{name}-0")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while (most := -(-most // FANOUT)) > 1:
        above = levels[-1].where(_parents() > 1).select(*group, F.col("j").alias("i"), _parents().alias("n"), "h")
        levels.append(shared.cut(_runs(above, group, []), f"{name}-{len(levels)}"))
    return levels


def _tops(levels: list[DataFrame], group: list[str], name: str) -> DataFrame:
    """Each group's uppermost node."""
    tops = [x.where(_parents() == 1).select(*group, F.col("h").alias(name)) for x in levels]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _pushed(levels: list[DataFrame], group: list[str], heads: DataFrame, carried: list[str]) -> DataFrame:
    """A row for each leaf: group, kid and its proof; heads has, by group, the proof of its uppermost node and carried columns."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        runs = levels[k].select(*group, "j", "n", "kids")
        met = runs.where(_parents() == 1).join(heads, group)
        if above is not None:
            met = met.unionByName(runs.where(_parents() > 1).join(above, [*group, "j"]))
        each = met.select("*", F.posexplode("kids").alias("p", "kid"))
        side = lambda at, count: F.concat_ws("", F.slice(F.col("kids")["h"], at, count))
        own = F.struct(side(F.lit(1), F.col("p")).alias("left"), side(F.col("p") + 2, F.lit(FANOUT)).alias("right"))
        each = each.withColumn("proof", F.when(F.col("n") == 1, F.col("proof")).otherwise(F.concat(F.array(own), F.col("proof"))))
        above = each.select(*group, F.col("kid.i").alias("j"), *carried, "proof", *(["kid"] if k == 0 else []))
    return above


@dataclass
class Manifest:
    """root: the digest of the whole table, None if it has no rows. rows: one for each row, with its proof."""

    root: str | None
    rows: DataFrame


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", row_id: str = "doc_id", also: dict[str, Column] | None = None) -> Manifest:
    """Row id, group, leaf, subroot, proof (a list of left and right siblings' digests, from the leaf up) and the columns in also.

    Leaves of a group are in ascending order of row_id, nulls first; repeated ids follow each other by leaf, and whole
    repeated rows keep a leaf each. A null group is a group of its own, before all others. Null fields are `-`, which no
    value is; empty texts are `0:`; very long ones are digested whole. An empty table has no rows and the root None.
    Columns of docs that are not named here are ignored, whatever they are called. also: further columns, worked out from docs.
    """
    cols = {c: F.col(f"`{c}`") for c in (*fields, group, row_id)}
    names = list(also or {})
    rows = docs.select(cols[row_id].alias("row_id"), F.coalesce(cols[group].cast("string"), F.lit("")).alias("name"), cols[group].isNotNull().alias("named"), leaf(*[cols[f] for f in fields]).alias("h"), *[c.alias(f"also_{k}") for k, c in (also or {}).items()])
    # Rows alike in all else are told apart by where they were first met, once and for all as this is written.
    rows = shared.cut(rows.withColumn("turn", F.monotonically_increasing_id()), "leaves")
    own, kept = ["named", "name"], ["row_id", *[f"also_{k}" for k in names]]
    levels = _levels(_placed(rows, own, ["row_id", "h", "turn"]).drop("turn"), own, kept, "manifest")
    tops = shared.cut(_tops(levels, own, "subroot"), "subroots")
    upper = _levels(_placed(tops.withColumn("whole", F.lit(1)), ["whole"], own).withColumn("h", F.col("subroot")), ["whole"], own, "groups")
    root = _tops(upper, ["whole"], "root").first()
    head = upper[-1].select("whole").distinct().withColumn("proof", F.array().cast("array<struct<left:string,right:string>>"))
    heads = _pushed(upper, ["whole"], head, []).select("kid.named", "kid.name", F.col("kid.h").alias("subroot"), "proof")
    out = _pushed(levels, own, heads, ["subroot"])
    group_value = F.when(F.col("named"), F.col("name")).alias(group if group != row_id else "group")
    return Manifest(root["root"] if root else None, out.select(F.col("kid.row_id").alias(row_id), group_value, F.col("kid.h").alias("leaf"), "subroot", "proof", *[F.col(f"kid.also_{k}").alias(k) for k in names]))
