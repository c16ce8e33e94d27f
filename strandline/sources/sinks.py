"""Result sinks: single files for people, Parquet for the cluster."""

from __future__ import annotations

import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from ..plans.planner import FORMATS, FRAME_FORMATS

DEFAULT_NAME = "search_results"


def output_path(name: str, output_format: str) -> str:
    """The name with its extension, added unless there in any case."""
    name = str(name or DEFAULT_NAME)
    return name if name.lower().endswith(f".{output_format}") else f"{name}.{output_format}"


def as_frame(df: DataFrame, output_format: str):
    """The Spark DataFrame itself, or a pandas or polars frame."""
    if output_format == "pandas":
        try:
            return df.toPandas()
        except ModuleNotFoundError as e:
            raise ImportError("output_format='pandas' requires pandas.") from e
    if output_format == "polars":
        try:
            import polars
        except ImportError:  # without polars the engine's own frame is the result
            return df
        return polars.from_arrow(df.toArrow())
    return df


def write_single(df: DataFrame, output_format: str, name: str) -> str:
    """Write one file.  Delimited rows stream through the driver; a workbook is built there."""
    if output_format not in set(FORMATS) - FRAME_FORMATS:
        raise ValueError(f"Invalid output format. Choose from: {FORMATS}")
    path = output_path(name, output_format)
    if output_format in ("csv", "tsv"):
        import csv

        with open(path, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, delimiter="," if output_format == "csv" else "\t", lineterminator="\n")
            out.writerow(df.columns)
            for row in df.toLocalIterator():
                out.writerow(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row])
    elif output_format == "json":
        with open(path, "w", encoding="utf-8") as f:
            f.write("[")
            for i, row in enumerate(_json_rows(df)):
                f.write(("," if i else "") + row)
            f.write("]")
    else:
        write_workbook(path, df.columns, [list(r) for r in df.collect()])
    return path


def _json_rows(df: DataFrame):
    import json

    for row in df.toLocalIterator():
        yield json.dumps(row.asDict(), ensure_ascii=False)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The distributed sink; any number of rows."""
    df.write.mode(mode).parquet(path)


# Parts of a minimal workbook in the Office Open XML format.
_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    "</Types>"
)
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_REL = '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'
_BOOK = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
)


def write_workbook(path: str, columns: list[str], rows: list[list]) -> None:
    """A one-sheet .xlsx with the standard library."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [columns, *rows])
    with zipfile.ZipFile(Path(path), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS.format(_REL.format("officeDocument", "xl/workbook.xml")))
        z.writestr("xl/workbook.xml", _BOOK)
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format(_REL.format("worksheet", "worksheets/sheet1.xml")))
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>',
        )
