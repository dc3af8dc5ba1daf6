"""Export: column order and names, shapes, exact CSV lines, JSON envelopes, spreadsheets."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterable, Sequence
from itertools import chain, islice
from xml.sax.saxutils import escape as xml_escape

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise

BOM = "﻿"


def cell_text(value: Column, data_type: T.DataType) -> Column:
    """Text of a cell: null as '', numbers and booleans as JSON writes them, arrays and structs as JSON."""
    if isinstance(data_type, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(value)
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        text = F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def quoted(cell: Column) -> Column:
    """Quotes only where a quote, comma or line break asks for them."""
    return F.when(cell.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def csv_line(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The row as one line of CSV."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.concat_ws(",", *[quoted(cell_text(F.col(f"`{c}`"), kinds[c])) for c in columns or df.columns])


def csv_header(columns: Sequence[str]) -> str:
    return BOM + ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in columns)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Parts of CRLF lines in one folder; the header is a part of its own that sorts first. No row passes the driver."""
    lines = (df.orderBy(*order) if order else df).select(csv_line(df).alias("value"))
    lines.write.mode("append").option("lineSep", "\r\n").text(path)
    header = df.sparkSession.createDataFrame([(csv_header(df.columns),)], "value string").coalesce(1)
    header.write.mode("append").option("lineSep", "\r\n").text(f"{path}/header")


def export_shape(df: DataFrame, variant_mode: str) -> str:
    """Rows with a product key take the dataset's variant shape, others are flat. Asked of the schema first, then of at
    most one row."""
    if "_product_key" not in df.columns or df.where(F.col("_product_key").isNotNull()).limit(1).isEmpty():
        return "flat"
    return "nested" if variant_mode == "nested" else "row_per_variant"


def unique_names(names: Iterable[str]) -> list[str]:
    """Later repeats of a name become ``name (2)``, ``name (3)``."""
    used: set[str] = set()
    out = []
    for name in names:
        n, candidate = 2, name
        while candidate in used:
            candidate, n = f"{name} ({n})", n + 1
        used.add(candidate)
        out.append(candidate)
    return out


def seen_keys(rows: DataFrame, key_lists: str, order: Sequence[str]) -> DataFrame:
    """Keys found in rows (an array column of key names, in row order) with their first place: key, first."""
    seen = rows.select(*order, F.posexplode(key_lists).alias("_pos", "key"))
    return seen.groupBy("key").agg(F.min(F.struct(*order, "_pos")).alias("first"))


def derive_columns(declared: Sequence[str], seen: DataFrame) -> list[str]:
    """Declared columns, then keys found in data that are not declared, in first-seen order. Key names are metadata:
    as many as the table has columns."""
    extra = seen.where(~F.col("key").startswith("_")).orderBy("first").select("key").collect()
    return list(dict.fromkeys([*declared, *[r["key"] for r in extra]]))


def rekey(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under their display names; undeclared columns go, bookkeeping columns (``_...``) stay."""
    shown = unique_names(names.values())
    return df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(names, shown)], *[F.col(c) for c in df.columns if c.startswith("_")])


def row_per_variant(df: DataFrame, product: dict[str, str], axes: dict[str, str], member: dict[str, str]) -> DataFrame:
    """Product fields, axes, member fields, then product_key and variant_key; customer names keep the plain form."""
    keys = [*product, *axes, *member, "_product_key", "_variant_key"]
    names = unique_names([*product.values(), *axes.values(), *member.values(), "product_key", "variant_key"])
    return df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)])


def assemble(rows: DataFrame, fields: Sequence[dict], variant_mode: str, order: Sequence[str]) -> tuple[str, DataFrame]:
    """The rows of a run as a customer gets them, with their shape. ``fields`` are dicts of key, name, type and level
    (product, axis or variant). Flat rows keep bookkeeping columns; variant rows have their keys at the end; nested rows
    are one a product, members joined in ``order``. Column names are those of the fields, repeats numbered."""
    from .variants import nested_rows

    shape = export_shape(rows, variant_mode)
    names = {f["key"]: f["name"] for f in fields}
    of = lambda *levels: {f["key"]: f["name"] for f in fields if f.get("level", "product") in levels}
    if shape == "flat":
        lacking = [k for k in names if k not in rows.columns]
        return shape, rekey(rows.withColumns({k: F.lit(None).cast("string") for k in lacking}), names)
    if shape == "row_per_variant":
        return shape, row_per_variant(rows, of("product"), of("axis"), of("variant"))
    product, member = of("product"), of("axis", "variant")
    nested = nested_rows(rows, "_product_key", order, list(product), list(member))
    shown = unique_names([*product.values(), *member.values(), "product_key"])
    return shape, nested.select(*[F.col(f"`{k}`").alias(n) for k, n in zip([*product, *member, "_product_key"], shown)])


def merge_row(inputs: Column, listing: Column, detail: Column, url: Column, page: Column, origins: dict[str, tuple[str, str]]) -> list[Column]:
    """Columns of one row from three struct sources. ``origins`` maps name to (origin, source column)."""
    sources = {"input": inputs, "listing": listing, "detail": detail}
    return [*[sources[o][c].alias(name) for name, (o, c) in origins.items()], url.alias("_url"), page.alias("_page_number")]


def partition_by_origin(fields: Sequence[dict]) -> dict[str, list[str]]:
    """Enabled fields by origin; unknown origins count as detail."""
    out: dict[str, list[str]] = {"input": [], "listing": [], "detail": []}
    for field in fields:
        if field.get("enabled", True):
            out[field.get("origin") if field.get("origin") in out else "detail"].append(field["name"])
    return out


def filename(slug: Column, run_id: Column, date: Column, extension: str, nested: bool = False) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.lower(slug), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    suffix = "" if not nested else "-variants-nested" if extension == "json" else "-variants-joined"
    parts = [F.coalesce(name, F.lit("run")), F.lit("-"), F.substring(run_id, 1, 8), F.lit("-"), F.date_format(date, "yyyy-MM-dd")]
    return F.concat(*parts, F.lit(f"{suffix}.{extension}"))


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text, nulls kept."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def write_json_envelope(df: DataFrame, path: str, run: dict, source: dict | None, order: Sequence[str] = ()) -> None:
    """The envelope {run, source, fields, rows}, indented by two blanks, as text parts in one folder: ``head``, the rows'
    parts and ``tail``, which make the document one after another. No row passes the driver. Rows are numbered where
    they are stored, so that only the last goes without a comma."""

    @F.pandas_udf("string")
    def indented(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: "    " + json.dumps(json.loads(row), indent=2, ensure_ascii=False).replace("\n", "\n    "))

    spark = df.sparkSession
    numbered = json_rows(df.orderBy(*order) if order else df).withColumn("n", F.monotonically_increasing_id())
    stored = materialise(numbered, "envelope")
    last = stored.agg(F.max("n")).first()[0]
    comma = F.when(F.col("n") == F.lit(last), F.lit("")).otherwise(F.lit(","))
    stored.orderBy("n").select(F.concat(indented(F.col("value")), comma).alias("value")).write.mode("append").text(path)
    head = json.dumps({"run": run, "source": source, "fields": df.columns}, indent=2, ensure_ascii=False)[:-2] + ',\n  "rows": ['
    for name, line in (("head", head), ("tail", "  ]\n}")):
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{path}/{name}")


def _sheet_cell(value, numeric: bool) -> str:
    if value is None or value == "":
        return "<c/>"
    if numeric:
        try:
            return f"<c><v>{float(value)!r}</v></c>"
        except ValueError:
            pass
    return f'<c t="inlineStr"><is><t xml:space="preserve">{xml_escape(str(value))}</t></is></c>'


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_XML = '<?xml version="1.0" encoding="UTF-8"?>'
# The parts that a workbook of one sheet must have.
_WORKBOOK = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_SHEET_TYPE}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_SHEET_TYPE}.worksheet+xml"/>'
    f'<Override PartName="/xl/styles.xml" ContentType="{_SHEET_TYPE}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/>'
    f'<Relationship Id="r2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
}


def _workbook(rows: Iterable[str], columns: Sequence[str], out) -> None:
    head = "".join(f'<c s="1" t="inlineStr"><is><t>{xml_escape(c)}</t></is></c>' for c in columns)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _WORKBOOK.items():
            book.writestr(name, _XML + text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
            sheet.write(f'{_XML}<worksheet xmlns="{_MAIN}">{pane}<sheetData><row>{head}</row>'.encode())
            for row in rows:
                sheet.write(row.encode())
            sheet.write(b"</sheetData></worksheet>")


def write_xlsx(df: DataFrame, folder: str, types: dict[str, str] | None = None, most_rows: int = 1_048_575) -> int:
    """Workbooks with one sheet ``Data`` in a folder (a path or address that all executors reach): bold frozen header,
    number and money columns as numbers. Each task writes its own rows, a new workbook after ``most_rows``, first
    under a name of the attempt, then by renaming. Returns the number of rows; an empty table is one empty workbook."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = df.columns
    numeric = [(types or {}).get(c) in ("number", "money") for c in columns]
    texts = df.select(*[cell_text(F.col(f"`{c}`"), kinds[c]).alias(f"c{n}") for n, c in enumerate(columns)])

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        place, target = FileSystem.from_uri(folder)
        lines = ("<row>" + "".join(map(_sheet_cell, values, numeric)) + "</row>" for batch in batches for values in zip(*[c.to_pylist() for c in batch.columns]))
        written = books = 0
        while (first := next(lines, None)) is not None:
            counted = 0

            def some(first=first):
                nonlocal counted
                for line in chain([first], islice(lines, most_rows - 1)):
                    counted += 1
                    yield line

            name = f"{target}/part-{task.partitionId():05d}-{books:03d}.xlsx"
            attempt = f"{target}/_{task.taskAttemptId()}-{books:03d}.tmp"
            with place.open_output_stream(attempt) as out:
                _workbook(some(), columns, out)
            place.move(attempt, name)
            written, books = written + counted, books + 1
        yield pa.RecordBatch.from_pydict({"rows": pa.array([written], pa.int64())})

    place, target = FileSystem.from_uri(folder)
    place.create_dir(target, recursive=True)
    total = texts.mapInArrow(write, "rows long").agg(F.sum("rows")).first()[0] or 0
    if total == 0:
        with place.open_output_stream(f"{target}/part-00000-000.xlsx") as out:
            _workbook([], columns, out)
    return total


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows by key, the highest version of either side standing; equal versions go to the change. The result is a new
    table: parquet has no merge."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    best = F.max_by(F.struct(*current.columns), F.struct(version, "_new"))
    return both.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(best.alias("r")).select("r.*")


def insert_missing(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``current`` and those of ``changes`` whose key it lacks."""
    return current.unionByName(changes.join(current.select(*keys), list(keys), "left_anti"))
