"""Files to text. One function for a (name, bytes) table; office formats are read with the standard library."""

from __future__ import annotations

import codecs
import io
import json
import zipfile
from collections.abc import Callable
from contextlib import suppress
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings by the way they are read.
PLAIN = ("txt", "md", "log", "rst", "csv", "tsv")
HTML = ("html", "htm")
HIDDEN = ("script", "style", "template")
NS = {
    "w": "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}",
    "a": "{http://schemas.openxmlformats.org/drawingml/2006/main}",
    "s": "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}",
}


#: How a file may be encoded, by the byte-order mark that it begins with.
UNMARKED = ("utf-8", "utf-16-le")
MARKS = {codecs.BOM_UTF8: "utf-8-sig", codecs.BOM_UTF16_LE: "utf-16", codecs.BOM_UTF16_BE: "utf-16"}


def decoded(raw: bytes) -> str:
    """By its byte-order mark; without one the first of UTF-8, UTF-16 and Latin-1 under which the bytes are valid."""
    marked = next((name for mark, name in MARKS.items() if raw.startswith(mark)), None)
    if marked:
        return raw.decode(marked, "replace")
    for name in UNMARKED:
        with suppress(UnicodeDecodeError):
            return raw.decode(name)
    return raw.decode("latin-1")


class _Text(HTMLParser):
    """Text nodes in order; comments, doctypes and the bodies of hidden elements are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def html_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.found).strip()


def json_text(raw: str) -> str:
    try:
        return json.dumps(json.loads(raw), indent=2, ensure_ascii=False)
    except ValueError:
        return raw


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def docx_text(raw: bytes) -> str:
    w = NS["w"]
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = _xml(z, "word/document.xml").find(f"{w}body")
    lines = [text(p) for p in body.findall(f"{w}p")]
    rows = [" | ".join(text(c) for c in r.findall(f"{w}tc")) for t in body.findall(f"{w}tbl") for r in t.findall(f"{w}tr")]
    return "\n".join([x for x in lines if x.strip()] + rows)


def pptx_text(raw: bytes) -> str:
    a = NS["a"]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(filter(str.isdigit, n))))
        lines = ["".join(t.text or "" for t in p.iter(f"{a}t")) for n in slides for p in _xml(z, n).iter(f"{a}p")]
    return "\n".join(x for x in lines if x.strip())


def xlsx_text(raw: bytes) -> str:
    s = NS["s"]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = ["".join(t.text or "" for t in i.iter(f"{s}t")) for i in _xml(z, "xl/sharedStrings.xml").findall(f"{s}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        out = []
        for n, sheet in enumerate(_xml(z, "xl/workbook.xml").iter(f"{s}sheet"), 1):
            out.append(f"# {sheet.get('name')}")
            for row in _xml(z, f"xl/worksheets/sheet{n}.xml").iter(f"{s}row"):
                cells = []
                for c in row.findall(f"{s}c"):
                    v = c.find(f"{s}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{s}t"))
                    value = inline if inline else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                    if value is not None:
                        cells.append(value)
                if cells:
                    out.append(" | ".join(cells))
    return "\n".join(out)


def extract(name: str, raw: bytes, pdf: Callable[[bytes], str] | None = None, image: Callable[[bytes], str] | None = None) -> str:
    """The text of a file by its ending. pdf and image: readers that this library has no own ones for.

    Unknown endings are decoded. ValueError if nothing is left.
    """
    ending = name.rpartition(".")[2].lower()
    if ending == "json":
        text = json_text(decoded(raw))
    elif ending in HTML:
        text = html_text(decoded(raw))
    elif ending in ("docx", "pptx", "xlsx"):
        text = {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text}[ending](raw)
    elif ending == "pdf" or ending in ("png", "jpg", "jpeg", "webp"):
        reader = pdf if ending == "pdf" else image
        if reader is None:
            raise ValueError(f"no reader for .{ending} files is configured")
        text = reader(raw)
    else:
        text = decoded(raw)
    if not text.strip():
        raise ValueError("no text found in the file")
    return text.strip()


def extracted(files: DataFrame, name_col: str = "path", bytes_col: str = "content", pdf=None, image=None) -> DataFrame:
    """files with text and error (at most 500 characters); a file that can't be read is a row with an error."""

    @F.pandas_udf("text string, error string")
    def run(names: pd.Series, raws: pd.Series) -> pd.DataFrame:
        out = []
        for n, r in zip(names, raws, strict=True):
            try:
                out.append((extract(n or "", bytes(r or b""), pdf, image), None))
            except MemoryError:  # says nothing about the file: the task fails and is tried again
                raise
            except Exception as e:  # any broken file
                out.append((None, str(e)[:500]))
        return pd.DataFrame(out, columns=["text", "error"])

    return files.withColumn("_x", run(F.col(name_col), F.col(bytes_col))).select(*files.columns, "_x.text", "_x.error")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return extracted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def text_of_html(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: html_text(p) if p else "")

    return run(html)


def pretty_json(raw: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json_text(t) if t is not None else None)

    return run(raw)


