"""Document corpora as tables: one row for each file, its sections read where the bytes are."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import page_sections

# The suffixes of corpus files.
SUFFIXES = ("md", "txt", "rst", "csv", "json", "jsonl", "pdf", "docx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def corpus_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(file, suffix, content, length, digest) of the files under root, without those in hidden folders."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    file = F.regexp_replace("path", rf"^(?:[a-z0-9]+:)?/*{re.escape(base.lstrip('/'))}/", "")
    out = rows.withColumn("file", file).withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return out.where(F.col("suffix").isin(*suffixes) & ~F.col("file").rlike(r"(^|/)\.")).select("file", "suffix", "content", "length", F.sha2("content", 256).alias("digest"))


def docx_text(data: bytes) -> str:
    """Paragraphs and tables of a word document in the order of its body; table rows as cells between bars."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out = []
    for block in root.find(f"{_W}body"):
        if block.tag == f"{_W}p":
            out.append(text(block))
        elif block.tag == f"{_W}tbl":
            out += [" | ".join(text(c) for c in row.iter(f"{_W}tc")) for row in block.iter(f"{_W}tr")]
    return "\n\n".join(x for x in out if x.strip())


def xlsx_rows(data: bytes, sheet: int = 1) -> list[list[str]]:
    """Cell texts of one sheet of a workbook."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    out = []
    for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{_S}row"):
        cells: list[str] = []
        for c in row.iter(f"{_S}c"):
            at = 0
            for ch in re.match(r"[A-Z]*", c.get("r", "")).group():
                at = at * 26 + ord(ch) - 64
            cells += [""] * (at - 1 - len(cells))
            v, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
            if c.get("t") == "s" and v is not None:
                cells.append(shared[int(v.text)])
            elif inline is not None:
                cells.append("".join(t.text or "" for t in inline.iter(f"{_S}t")))
            else:
                cells.append(v.text or "" if v is not None else "")
        out.append(cells)
    return out


def read_sections(data: bytes, suffix: str) -> list[tuple[str, str]]:
    """(location, text) of one file."""
    if suffix == "docx":
        return [("text", docx_text(data))]
    if suffix == "pdf":
        try:
            import pdfplumber  # an optional plug-in
        except ImportError as e:
            raise ValueError("PDF files need the optional library pdfplumber") from e
        with pdfplumber.open(io.BytesIO(data)) as book:
            return [(f"page {n}", p.extract_text() or "") for n, p in enumerate(book.pages, 1)]
    text = data.decode("utf-8-sig")
    if suffix == "md":
        return page_sections(text)
    if suffix == "csv":
        return [("text", "\n\n".join(" | ".join(r) for r in csv.reader(io.StringIO(text, newline=""))))]
    if suffix == "json":
        return [("text", json.dumps(json.loads(text), ensure_ascii=False, indent=2))]
    return [("text", text)]


def corpus_sections(files: DataFrame) -> DataFrame:
    """(file, section_no, location, text, error): a file that can't be read has one row with its error and stops nothing."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, s, data in zip(b["file"], b["suffix"], b["content"]):
                try:
                    rows += [(f, n, where, text, None) for n, (where, text) in enumerate(read_sections(bytes(data), s), 1)]
                except Exception as e:  # any broken file
                    rows.append((f, 0, None, None, f"{type(e).__name__}: {e}"[:240]))
            yield pd.DataFrame(rows, columns=["file", "section_no", "location", "text", "error"])

    return files.select("file", "suffix", "content").mapInPandas(read, "file string, section_no int, location string, text string, error string")
