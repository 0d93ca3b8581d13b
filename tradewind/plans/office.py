"""Texts as office files, the fixture of the readers: just the parts that hold text."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from tradewind.sources.readers import NS


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def _lines(text: str) -> list[str]:
    return [escape(line) for line in text.split("\n")]


def docx(text: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in _lines(text))
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{NS["w"][1:-1]}"><w:body>{body}</w:body></w:document>'})


def pptx(text: str) -> bytes:
    body = "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in _lines(text))
    return _zipped({"ppt/slides/slide1.xml": f'<p xmlns:a="{NS["a"][1:-1]}">{body}</p>'})


def xlsx(text: str) -> bytes:
    rows = "".join(f'<row><c t="inlineStr"><is><t>{x}</t></is></c></row>' for x in _lines(text) if x.strip())
    space = f'xmlns="{NS["s"][1:-1]}"'
    return _zipped({"xl/workbook.xml": f'<workbook {space}><sheets><sheet name="S"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f"<worksheet {space}><sheetData>{rows}</sheetData></worksheet>"})


OFFICE = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "dat": str.encode}
