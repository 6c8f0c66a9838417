"""Files to texts: recursive scan, type by extension, extraction by type with errors as rows, HTML to Markdown."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import source_id

# Extensions and the types they stand for.
TYPES = {"md": "markdown", "markdown": "markdown", "txt": "text", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "xls": "xlsx", "pptx": "pptx", "html": "html", "htm": "html", "csv": "csv"}
#: Readers that need a library; register one with register_reader.
READERS: dict[str, Callable[[bytes], str]] = {}


def register_reader(file_type: str, reader: Callable[[bytes], str]) -> None:
    """reader: bytes to text, for pdf, docx, xlsx or pptx."""
    READERS[file_type] = reader


def file_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in TYPES.items() for x in p)), ext), F.lit("unknown"))


def supported(path: Column) -> Column:
    return file_type(path).isin("markdown", "text", "html", "csv", *READERS)


class _Markdown(HTMLParser):
    """Headings, paragraphs, list items and table rows as Markdown lines; scripts and styles are dropped."""

    BLOCKS = {"p", "div", "br", "li", "tr", "section", "article", "header", "footer", "nav", "ul", "ol", "table", "title", "body", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCKS or len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(" ".join(data.split()) + (" " if data[-1:].isspace() else "") if data.strip() else " ")


def html_to_markdown(html: str | None) -> str:
    p = _Markdown()
    p.feed(html or "")
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
    return "\n".join(x for x in lines if x and x not in ("#", "-"))


def convert_html(rows: DataFrame, column: str = "html") -> DataFrame:
    """rows with the column ``text``: Markdown of an HTML column. Clean rows and broken markup alike give a text."""
    rows = rows.drop("text")

    def of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([html_to_markdown(x) for x in b.column(column).to_pylist()], pa.string())], names=[*b.schema.names, "text"])

    return rows.mapInArrow(of, StructType([*rows.schema.fields, *StructType.fromDDL("text string").fields]))


def csv_to_markdown(text: str) -> str:
    import csv
    import io

    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join(lines[:1] + ["|" + " --- |" * len(rows[0])] + lines[1:]) if rows else ""


def _text_of(kind: str, data: bytes) -> str:
    if kind in READERS:
        return READERS[kind](data)
    text = data.decode("utf-8", "replace")
    return html_to_markdown(text) if kind == "html" else csv_to_markdown(text) if kind == "csv" else text


def extract(files: DataFrame) -> DataFrame:
    """(path, content) to (path, file_type, text, error_stage, error_reason): a row for every file, errors in it."""
    schema = StructType.fromDDL("path string, file_type string, text string, error_stage string, error_reason string")

    def of(batches):
        for b in batches:
            rows = []
            for path, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text, stage, why = None, None, None
                if not path:
                    stage, why = "validate", "path is empty"
                elif kind not in {"markdown", "text", "html", "csv", *READERS}:
                    stage, why = "validate", f"unsupported file type {kind}"
                else:
                    try:
                        text = _text_of(kind, data or b"")
                        if not text.strip():
                            text, stage, why = None, "extract", "extracted text is empty"
                    except Exception as e:  # one bad file must not stop the others
                        stage, why = "extract", f"{type(e).__name__}: {e}"
                rows.append((path, kind, text, stage, why))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], names=schema.names)

    return files.select("path", file_type(F.col("path")).alias("kind"), "content").mapInArrow(of, schema)


def listing(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, length, modified) of all files below root, or of those with one of the extensions, by path. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    return _wanted(found, extensions).orderBy("path")


def _wanted(rows: DataFrame, extensions: list[str] | None) -> DataFrame:
    if extensions is None:
        return rows
    return rows.where(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))


def read_folder(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """All files below root, or those with one of the extensions, as (path, content)."""
    return _wanted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content"), extensions)


def documents(extracted: DataFrame, workspace_id: str = "default") -> DataFrame:
    """Extracted rows without errors as documents: document_id is derived from the path."""
    ok = extracted.where("error_stage is null")
    return ok.select(source_id(F.col("path")).alias("document_id"), F.lit(workspace_id).alias("workspace_id"), F.lit("documents").alias("source_type"), F.regexp_extract("path", r"([^/]+)$", 1).alias("title"), F.col("path").alias("url"), "file_type", "text")


def summary(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy(F.coalesce("error_stage", F.lit("ok")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
