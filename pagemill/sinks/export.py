"""Column selection, value shaping and writers."""

from __future__ import annotations

import csv
import html
import json
import zipfile
from collections.abc import Callable, Iterator
from itertools import groupby
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational

#: Keys that come first, in this order, and their headings.
CANONICAL = {
    "serial_no": "Serial No (क्र. सं.)", "voter_id": "Voter ID / EPIC", "epic_no": "EPIC No.", "name": "Name (नाम)", "relation_name": "Father / Relative Name (पिता/सम्बन्धी का नाम)",
    "relation_type": "Relation (संबंध)", "father_name": "Father's Name (पिता का नाम)", "husband_name": "Husband's Name (पति का नाम)", "house_no": "House No / Village (मकान/ग्राम)",
    "village": "Village (ग्राम)", "address": "Address (पता)", "age": "Age (उम्र)", "gender": "Gender (लिंग)", "roll_no": "Roll No", "class": "Class", "section": "Section",
}
NONE = "Uncategorized"


def field_table(records: DataFrame, order: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """field, n and position of the keys worth a column, of all records or of each group: counted in one pass, noise and rare keys left out."""
    keys = records.select(*by, F.col(order).alias("o"), F.posexplode(F.map_keys("data")).alias("k", "field"))
    seen = keys.groupBy(*by, "field").agg(F.count("*").alias("n"), F.min(F.struct("o", "k")).alias("first"))
    bare = F.trim("field")
    good = (bare != "") & ~bare.rlike(r"(?U)^[\d\s[^\p{L}\p{N}_]_]+$") & ((F.length(bare) > 1) | bare.rlike("[ऀ-ॿ]"))
    place = F.array_position(F.array(*[F.lit(c) for c in CANONICAL]), F.col("field"))
    total = records.groupBy(*by).agg(F.count("*").alias("total"))
    # seen has one row for each key (of each group), total one for each group.
    out = seen.where(good).withColumn("place", F.when(place > 0, place).otherwise(99))
    out = out.join(total, list(by)) if by else out.join(F.broadcast(total))
    known = F.min("place").over(Window.partitionBy(*by)) < 99
    enough = (F.col("total") < 10) | ~known | (F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("total") / 10)))
    out = out.withColumn("keep", enough).where("keep")
    return out.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("place", "first"))).select(*by, "field", "n", "position")


def fields(records: DataFrame, order: str = "id") -> list[str]:
    return [r.field for r in field_table(records, order).orderBy("position").collect()]


def heading(key: str) -> str:
    return CANONICAL.get(key) or key.replace("_", " ").strip().title()


def shaped(records: DataFrame, categories: DataFrame, names: list[str], default: str = "") -> DataFrame:
    """id, one column for each field ('' where missing), category and source_page."""
    cells = [F.coalesce(F.col("data")[n], F.lit("")).alias(n) for n in names]
    page = F.when(F.coalesce("page_number", F.lit(0)) != 0, F.col("page_number").cast("string")).otherwise("").alias("source_page")
    return relational.with_category(records, categories, default).select("id", *cells, F.col("category_name").alias("category"), page)


def scoped(records: DataFrame, scope: str = "all", category_id=None, ids: list | None = None, hits: DataFrame | None = None, document_id=None) -> DataFrame:
    """Records of an export's scope: all, category, selected or search."""
    if document_id is not None:
        records = records.where(F.col("document_id") == document_id)
    if scope == "all":
        return records
    if scope == "category" and category_id is not None:
        return records.where(F.col("category_id") == category_id)
    if scope == "selected" and ids:
        return relational.by_ids(records, ids)
    if scope == "search" and hits is not None:
        return records.join(hits.where("record_id IS NOT NULL").select(F.col("record_id").alias("id")), "id", "left_semi")
    raise ValueError(f"scope {scope!r} is unknown or lacks its argument")


def json_rows(records: DataFrame, categories: DataFrame) -> DataFrame:
    """One JSON object for each record: all of its data, its category and page."""
    named = relational.with_category(records, categories)
    page = F.create_map(F.lit("category"), F.col("category_name"), F.lit("source_page"), F.coalesce(F.col("page_number").cast("string"), F.lit("")))
    data = F.map_filter(F.coalesce("data", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("category", "source_page"))
    return named.select("id", F.to_json(F.map_concat(data, page)).alias("json"))


def markdown_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return rows.select("id", "category", F.concat(F.lit("| "), F.concat_ws(" | ", *[safe(c) for c in [*names, "category", "source_page"]]), F.lit(" |")).alias("line"))


def widths(rows: DataFrame, names: list[str]) -> DataFrame:
    """The widest cell (or heading) of each column and category."""
    return rows.groupBy("category").agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(c) for c in [*names, "category", "source_page"] if c != "category"], F.greatest(F.max(F.length("category")), F.lit(8)).alias("category_width"))


def source_pages(records: DataFrame, *by: str) -> DataFrame:
    """Number of different pages that records come from."""
    return records.groupBy(*by).agg(F.count_distinct("page_number").alias("pages"))


def slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


# ---------------------------------------------------------------- single files, streamed from the rows


def _grouped(rows: DataFrame) -> Iterator[tuple[str, int, Iterator[Row]]]:
    """(category, number of rows, rows) by first appearance; rows stream by, none are held."""
    facts = rows.groupBy("category").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    counts = {r.category: r.n for r in facts.collect()}  # a row for each category
    stream = rows.join(facts.drop("n"), "category").orderBy("first", "id").drop("first").toLocalIterator()
    for name, own in groupby(stream, key=lambda r: r.category):
        yield name, counts[name], own


def _csv(path: Path, rows: DataFrame, names: list[str], title: str, records: DataFrame, categories: DataFrame) -> None:
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow([*map(heading, names), "Category", "Source Page"])
        for r in rows.orderBy("id").toLocalIterator():
            out.writerow([*[r[n] for n in names], "" if r.category == NONE else r.category, r.source_page])


def _by_first(facts: DataFrame) -> list[Row]:
    """Categories (category, n, first) by first appearance: a row for each."""
    return facts.orderBy("first").collect()


def json_head(records: DataFrame, facts: DataFrame, names: list[str], title: str) -> str:
    head = {"name": title, "total_records": records.count(), "categories": [r.category for r in _by_first(facts) if r.category != NONE]}
    return '{"document": ' + json.dumps(head, ensure_ascii=False) + ', "fields": ' + json.dumps([*names, "category", "source_page"], ensure_ascii=False) + ', "records": [\n'


def markdown_head(facts: DataFrame, title: str) -> str:
    counts = _by_first(facts)
    contents = "".join(f"- [{c.category}](#{c.category.lower().replace(' ', '-')})\n" for c in counts)
    return f"# {title}\n\n## Summary\n- **Total Records:** {sum(c.n for c in counts)}\n- **Total Categories:** {len(counts)}\n\n## Table of Contents\n{contents}"


def html_head(title: str) -> str:
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><input placeholder="Filter" oninput="keep(this.value)">\n'


def _facts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def _json(path: Path, rows: DataFrame, names: list[str], title: str, records: DataFrame, categories: DataFrame) -> None:
    with path.open("w", encoding="utf-8") as f:
        f.write(json_head(records, _facts(rows), names, title))
        for i, r in enumerate(json_rows(records, categories).orderBy("id").toLocalIterator()):
            f.write(", " * bool(i) + r.json + "\n")
        f.write("]}")


def _markdown(path: Path, rows: DataFrame, names: list[str], title: str, records: DataFrame, categories: DataFrame) -> None:
    columns = [*names, "category", "source_page"]
    with path.open("w", encoding="utf-8") as f:
        f.write(markdown_head(_facts(rows), title))
        for name, n, own in _grouped(rows):
            f.write(f"\n## {name}\n_{n} records_\n\n| {' | '.join([*names, 'Category', 'Source Page'])} |\n| {' | '.join(['---'] * len(columns))} |\n")
            f.writelines("| " + " | ".join(r[c].replace("|", "\\|").replace("\n", " ") for c in columns) + " |\n" for r in own)


def _txt(path: Path, rows: DataFrame, names: list[str], title: str, records: DataFrame, categories: DataFrame) -> None:
    columns, heads = [*names, "category", "source_page"], [*names, "Category", "Source Page"]
    with path.open("w", encoding="utf-8") as f:
        f.write(f"{title}\n{'=' * len(title)}\n\n")
        longest = rows.groupBy("category").agg(*[F.max(F.length(c)).alias(f"w{i}") for i, c in enumerate(columns)]).collect()  # a row for each category
        widths_ = {r.category: [max(len(h), r[f"w{i}"] or 0) for i, h in enumerate(heads)] for r in longest}
        for name, n, own in _grouped(rows):
            wide = widths_[name]
            f.write(f"{name} ({n} records)\n{'-' * (len(name) + len(str(n)) + 11)}\n\n")
            f.write(" | ".join(h.ljust(w) for h, w in zip(heads, wide, strict=True)) + "\n" + "-+-".join("-" * w for w in wide) + "\n")
            f.writelines(" | ".join(r[c].ljust(w) for c, w in zip(columns, wide, strict=True)) + "\n" for r in own)
            f.write("\n\n")


#: Filters the rows of all tables by what is typed, and sorts a table by the heading that is clicked, numbers as numbers.
_SCRIPT = """<script>
function keep(t){t=t.toLowerCase();for(const r of document.querySelectorAll('tbody tr'))r.hidden=!r.textContent.toLowerCase().includes(t)}
document.addEventListener('click',e=>{const h=e.target.closest('th');if(!h)return;const body=h.closest('table').tBodies[0],i=h.cellIndex,up=h.dataset.up!=='1';
h.dataset.up=up?'1':'0';const v=r=>r.cells[i].textContent,n=x=>x.trim()!==''&&!isNaN(x);
const rows=[...body.rows].sort((a,b)=>{const x=v(a),y=v(b);return n(x)&&n(y)?x-y:x.localeCompare(y)});for(const r of up?rows:rows.reverse())body.append(r)})
</script>"""


HTML_TAIL = _SCRIPT + "</body></html>"


def _html(path: Path, rows: DataFrame, names: list[str], title: str, records: DataFrame, categories: DataFrame) -> None:
    columns, heads = [*names, "category", "source_page"], [*map(heading, names), "Category", "Source Page"]
    with path.open("w", encoding="utf-8") as f:
        f.write(html_head(title))
        for name, _, own in _grouped(rows):
            f.write(f"<h2>{html.escape(name)}</h2><table><thead><tr>{''.join(f'<th>{html.escape(h)}</th>' for h in heads)}</tr></thead><tbody>\n")
            f.writelines("<tr>" + "".join(f"<td>{html.escape(r[c])}</td>" for c in columns) + "</tr>\n" for r in own)
            f.write("</tbody></table>\n")
        f.write(HTML_TAIL)


def sheet_names(names: list[str]) -> list[str]:
    """At most 31 characters, without []:*?/\\, each once (in any case): repeats get _n after 28 characters."""
    out: list[str] = []
    for n in names:
        base = "".join(c for c in n if c not in "[]:*?/\\")[:31] or "Sheet"
        new, k = base, 1
        while new.lower() in (x.lower() for x in out):
            new, k = f"{base[:28]}_{k}", k + 1
        out.append(new)
    return out


def _cell(v: str) -> str:
    if v.replace(".", "", 1).isdigit() and v.isascii():
        return f"<c><v>{float(v) if '.' in v else int(v)}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{html.escape(v)}</t></is></c>'


_NS = "http://schemas.openxmlformats.org"


def _xlsx(path: Path, rows: DataFrame, names: list[str], title: str, records: DataFrame, categories: DataFrame) -> None:
    """A sheet of all records, then one for each category with the fields that its own records are worth."""
    named = relational.with_category(records, categories, NONE)
    own_fields: dict[str, list[str]] = {}
    for r in field_table(named, by=("category_name",)).orderBy("category_name", "position").collect():  # a row for each category and column
        own_fields.setdefault(r.category_name, []).append(r.field)
    every = list(dict.fromkeys([*names, *[n for ns in own_fields.values() for n in ns]]))
    rows = shaped(records, categories, every, NONE)
    cats = [c.category for c in rows.groupBy("category").agg(F.min("id").alias("first")).orderBy("first").collect()]  # a row for each category
    sheets = sheet_names(["All Records", *cats])

    def sheet(z: zipfile.ZipFile, number: int, fields_: list[str], own: Iterator[Row]) -> None:
        columns = [*fields_, "category", "source_page"]
        with z.open(f"xl/worksheets/sheet{number}.xml", "w") as f:
            f.write(f'<worksheet xmlns="{_NS}/spreadsheetml/2006/main"><sheetData><row>'.encode() + "".join(map(_cell, [*map(heading, fields_), "Category", "Source Page"])).encode() + b"</row>")
            for r in own:
                f.write(("<row>" + "".join(_cell(r[c]) for c in columns) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_NS}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="r1" Type="{_NS}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS}/spreadsheetml/2006/main" xmlns:r="{_NS}/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{html.escape(s)}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, s in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_NS}/package/2006/relationships">' + "".join(f'<Relationship Id="r{i + 1}" Type="{_NS}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        sheet(z, 1, names, rows.orderBy("id").toLocalIterator())
        # One pass for all categories, in the order of their sheets.
        for i, (name, _, own) in enumerate(_grouped(rows)):
            sheet(z, i + 2, own_fields.get(name, []), own)


def _docx(path: Path, rows: DataFrame, names: list[str], title: str, records: DataFrame, categories: DataFrame) -> None:
    columns, heads = [*names, "category", "source_page"], [*map(heading, names), "Category", "Source Page"]
    para = lambda t: f"<w:p><w:r><w:t xml:space=\"preserve\">{html.escape(t)}</w:t></w:r></w:p>"
    row = lambda cells: "<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in cells) + "</w:tr>"
    facts = rows.agg(F.count("*"), F.count_distinct("category"), F.count_distinct(F.when(F.col("source_page") != "", F.col("source_page")))).first()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_NS}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="r1" Type="{_NS}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        with z.open("word/document.xml", "w") as f:
            f.write((f'<w:document xmlns:w="{_NS}/wordprocessingml/2006/main"><w:body>' + para(title)).encode())
            for name, _, own in _grouped(rows):
                f.write((para(name) + "<w:tbl>" + row(heads)).encode())
                for r in own:
                    f.write(row([r[c] for c in columns]).encode())
                f.write(b"</w:tbl>")
            f.write("".join(map(para, (f"Total Records: {facts[0]}", f"Total Categories: {facts[1]}", f"Source Pages: {facts[2]}"))).encode() + b"</w:body></w:document>")


FORMATS: dict[str, Callable] = {"csv": _csv, "json": _json, "markdown": _markdown, "md": _markdown, "txt": _txt, "html": _html, "xlsx": _xlsx, "docx": _docx}


def export(records: DataFrame, categories: DataFrame, path: str, kind: str, title: str = "All Records") -> str:
    """One file on the driver, streamed; parallel.write() has the executors write the same file."""
    if kind.lower() not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    names = fields(records)
    FORMATS[kind.lower()](Path(path), shaped(records, categories, names, NONE), names, title, records, categories)
    return path


def scope_counts(records: DataFrame, categories: DataFrame) -> DataFrame:
    return relational.category_counts(categories, records).select("id", "name", "record_count")


