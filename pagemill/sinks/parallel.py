"""Single files of any size: lines are rendered and sorted by all tasks into numbered parts, which the file system joins.

The bytes are those of export.export. The driver sees a row for each category and the names of the parts; where the file
system has no concat, the parts are copied one after another through a buffer.
"""

from __future__ import annotations

import csv
import html
import io

import pandas as pd
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import storage
from . import export

#: Rows in a part, about.
PART_ROWS = 200_000
FORMATS = ("csv", "json", "markdown", "md", "txt", "html")


@F.pandas_udf(StringType())
def _csv_line(cells: pd.Series) -> pd.Series:
    out = []
    for row in cells:
        line = io.StringIO()
        csv.writer(line, lineterminator="").writerow(row)
        out.append(line.getvalue())
    return pd.Series(out, dtype=object)


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _grouped(rows: DataFrame, facts: DataFrame, head: Column, line: Column, end: str | None) -> DataFrame:
    """Lines (first, kind, id, line): of each category a heading, its rows and, if it has one, an end."""
    none = F.lit(None).cast("long")
    out = facts.select("first", F.lit(0).alias("kind"), none.alias("id"), head.alias("line"))
    out = out.unionByName(rows.join(facts, "category").select("first", F.lit(1).alias("kind"), F.col("id").cast("long"), line.alias("line")))
    return out if end is None else out.unionByName(facts.select("first", F.lit(2).alias("kind"), none.alias("id"), F.lit(end).alias("line")))


def rendered(records: DataFrame, categories: DataFrame, kind: str, title: str = "All Records") -> tuple[str, DataFrame, list[str], str, str]:
    """What stands before the lines, the lines and the columns that they are ordered by, what ends a line, what stands after them."""
    names = export.fields(records)
    columns = [*names, "category", "source_page"]
    rows = export.shaped(records, categories, names, export.NONE)
    facts = rows.groupBy("category").agg(F.count("*").alias("n"), F.min("id").cast("long").alias("first"))
    if kind == "csv":
        buffer = io.StringIO()
        csv.writer(buffer).writerow([*map(export.heading, names), "Category", "Source Page"])
        shown = F.when(F.col("category") == export.NONE, "").otherwise(F.col("category"))
        cells = F.array(*[F.col(f"`{n}`") for n in names], shown, F.col("source_page"))
        return "﻿" + buffer.getvalue(), rows.select("id", _csv_line(cells).alias("line")), ["id"], "\r\n", ""
    if kind == "json":
        first = rows.agg(F.min("id")).first()[0]
        line = F.concat(F.when(F.col("id") == F.lit(first), "").otherwise(", "), F.col("json"))
        return export.json_head(records, facts, names, title), export.json_rows(records, categories).select("id", line.alias("line")), ["id"], "\n", "]}"
    order, n = ["first", "kind", "id"], F.col("n").cast("string")
    if kind in ("markdown", "md"):
        safe = [F.replace(F.replace(F.col(f"`{c}`"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in columns]
        table = f"| {' | '.join([*names, 'Category', 'Source Page'])} |\n| {' | '.join(['---'] * len(columns))} |"
        head = F.concat(F.lit("\n## "), "category", F.lit("\n_"), n, F.lit(f" records_\n\n{table}"))
        return export.markdown_head(facts, title), _grouped(rows, facts, head, F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |")), None), order, "\n", ""
    if kind == "txt":
        heads = [*names, "Category", "Source Page"]
        wide = rows.groupBy("category").agg(*[F.greatest(F.max(F.length(f"`{c}`")), F.lit(len(h))).alias(f"w{i}") for i, (c, h) in enumerate(zip(columns, heads, strict=True))])
        facts = facts.join(wide, "category")
        padded = lambda cells: F.concat_ws(" | ", *[F.rpad(c, F.col(f"w{i}"), F.lit(" ")) for i, c in enumerate(cells)])
        rule = F.concat_ws("-+-", *[F.repeat(F.lit("-"), F.col(f"w{i}")) for i in range(len(heads))])
        under = F.repeat(F.lit("-"), F.length("category") + F.length(n) + 11)
        head = F.concat("category", F.lit(" ("), n, F.lit(" records)\n"), under, F.lit("\n\n"), padded([F.lit(h) for h in heads]), F.lit("\n"), rule)
        return f"{title}\n{'=' * len(title)}\n\n", _grouped(rows, facts, head, padded([F.col(f"`{c}`") for c in columns]), "\n"), order, "\n", ""
    heads = "".join(f"<th>{html.escape(h)}</th>" for h in [*map(export.heading, names), "Category", "Source Page"])
    head = F.concat(F.lit("<h2>"), _escaped(F.col("category")), F.lit(f"</h2><table><thead><tr>{heads}</tr></thead><tbody>"))
    line = F.concat(F.lit("<tr>"), *[x for c in columns for x in (F.lit("<td>"), _escaped(F.col(f"`{c}`")), F.lit("</td>"))], F.lit("</tr>"))
    return export.html_head(title), _grouped(rows, facts, head, line, "</tbody></table>"), order, "\n", export.HTML_TAIL


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, maker = storage.filesystem(spark, path)
    out = fs.create(maker(path), True)
    out.write(bytearray(text.encode()))
    out.close()


def joined(spark: SparkSession, parts: list[str], path: str) -> None:
    """One file of the parts in their order; the parts go."""
    fs, maker = storage.filesystem(spark, path)
    gateway = spark.sparkContext._gateway
    own = [p for p in parts if fs.getFileStatus(maker(p)).getLen() > 0]
    try:
        rest = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Path, len(own) - 1)
        for i, p in enumerate(own[1:]):
            rest[i] = maker(p)
        fs.concat(maker(own[0]), rest)
        fs.delete(maker(path), False)
        if not fs.rename(maker(own[0]), maker(path)):
            raise OSError(f"cannot name {path}")
    except UnsupportedOperationException:
        out = fs.create(maker(path), True)
        for p in own:
            source = fs.open(maker(p))
            gateway.jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
        out.close()


def write(records: DataFrame, categories: DataFrame, path: str, kind: str, title: str = "All Records") -> str:
    """The file of export.export, at a path that driver and executors share."""
    if kind.lower() not in FORMATS:
        raise ValueError(f"no format {kind!r} of lines: {FORMATS}")
    spark = records.sparkSession
    head, lines, order, end, tail = rendered(records, categories, kind.lower(), title)
    at = storage.scratch(spark, "lines")
    n = max(1, records.count() // PART_ROWS)
    lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select("line").write.option("lineSep", end).text(f"{at}/body")
    _put(spark, f"{at}/head", head)
    _put(spark, f"{at}/tail", tail)
    fs, maker = storage.filesystem(spark, at)
    body = sorted(f.getPath().toString() for f in fs.listStatus(maker(f"{at}/body")) if f.getPath().getName().startswith("part-"))
    joined(spark, [f"{at}/head", *body, f"{at}/tail"], path)
    storage.remove(spark, at)
    return path
