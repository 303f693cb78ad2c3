"""Documents in containers: DOCX and UDF packages and HTML pages as blocks, with the standard library only.

Packages are read from (path, content) rows, as spark.read.format("binaryFile") gives them. A package that breaks a guard or
can't be parsed yields one row with its error and no blocks; others are not touched by it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Guards: entries, bytes of an entry, ratio of compression, bytes of a package, depth of XML (fixed values).
ENTRIES, ENTRY_BYTES, RATIO, PACKAGE_BYTES, DEPTH = 4096, 96 << 20, 512, 128 << 20, 256
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCK_ROWS = "path string, block_index bigint, kind string, style string, text string, error string"


class Broken(ValueError):
    pass


def entry(content: bytes, name: str) -> bytes | None:
    """Bytes of an entry; None if there is none of that name."""
    if len(content) > PACKAGE_BYTES:
        raise Broken("package too large")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        if len(infos) > ENTRIES:
            raise Broken("too many entries")
        for i in infos:
            if i.file_size > ENTRY_BYTES or i.file_size > RATIO * max(1, i.compress_size) or i.filename.startswith(("/", "..")) or "/../" in i.filename:
                raise Broken(f"entry {i.filename}")
        return z.read(name) if name in z.namelist() else None


def parse_xml(raw: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in raw[:4096]:
        raise Broken("document type declared")
    depth = 0
    root = None
    for event, node in ElementTree.iterparse(io.BytesIO(raw.removeprefix(b"\xef\xbb\xbf")), ("start", "end")):
        depth += 1 if event == "start" else -1
        root = node if root is None else root
        if depth > DEPTH:
            raise Broken("nested too deep")
    return root


def style_chain(styles: ElementTree.Element | None) -> dict[str, dict[str, str]]:
    """Resolved font and size of each style: its own, else its ancestors' (16 hops at most)."""
    if styles is None:
        return {}
    own, parent = {}, {}
    for s in styles.iter(W + "style"):
        key = s.get(W + "styleId", "")
        fonts, size, base = s.find(f".//{W}rFonts"), s.find(f".//{W}sz"), s.find(W + "basedOn")
        own[key] = {k: v for k, v in (("font", fonts.get(W + "ascii") if fonts is not None else None), ("size", size.get(W + "val") if size is not None else None)) if v}
        parent[key] = base.get(W + "val") if base is not None else None
    out = {}
    for key in own:
        made, at, hops = {}, key, 0
        while at in own and hops <= 16:
            made = {**own[at], **made}
            at, hops = parent[at], hops + 1
        out[key] = made
    return out


def docx_blocks(content: bytes) -> Iterator[tuple[str, str, str]]:
    """kind (paragraph, table_cell), style and text of each paragraph; deleted text is left out, tabs and breaks are kept."""
    body = entry(content, "word/document.xml")
    if body is None:
        raise Broken("no document")
    root = parse_xml(body)
    cells = {p for t in root.iter(W + "tbl") for p in t.iter(W + "p")}
    for p in root.iter(W + "p"):
        deleted = {n for x in p.iter(W + "del") for n in x.iter()}
        text = "".join(
            (n.text or "") if n.tag == W + "t" else "\t" if n.tag == W + "tab" and n not in tabs else "\n" if n.tag == W + "br" else ""
            for tabs in [{x for pr in p.iter(W + "pPr") for x in pr.iter()}]
            for n in p.iter()
            if n not in deleted
        )
        style = p.find(f"{W}pPr/{W}pStyle")
        yield "table_cell" if p in cells else "paragraph", "" if style is None else style.get(W + "val", ""), text


def utf16_slice(text: str, start: int, length: int) -> str:
    """A slice by UTF-16 units, as spans of the container count."""
    raw = text.encode("utf-16-le", "surrogatepass")
    return raw[2 * start : 2 * (start + length)].decode("utf-16-le", "replace")


def udf_blocks(content: bytes) -> Iterator[tuple[str, str, str]]:
    """Paragraphs of a text buffer by its spans; the buffer's lines where the tree of spans can't be used."""
    raw = entry(content, "content.xml")
    if raw is None:
        raise Broken("no content")
    root = parse_xml(raw)
    buffer = next((n.text or "" for n in root.iter("content") if n.get("startOffset") is None), "")
    found = False
    for p in root.iter("paragraph"):
        spans = [(int(c.get("startOffset", -1)), int(c.get("length", 0))) for c in p.iter() if c.get("startOffset") is not None]
        if spans and min(s for s, _ in spans) >= 0:
            found = True
            begin, end = min(s for s, _ in spans), max(s + n for s, n in spans)
            yield "paragraph", p.get("Alignment", ""), utf16_slice(buffer, begin, end - begin).rstrip("\n")
    if not found:
        for line in buffer.split("\n"):
            yield "paragraph", "", line


def read_packages(files: DataFrame) -> DataFrame:
    """Blocks of DOCX and UDF packages, by the extension of path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                reader = {"docx": docx_blocks, "udf": udf_blocks}.get(path.lower().rpartition(".")[2])
                try:
                    blocks = list(reader(bytes(content))) if reader else []
                    if not any(t.strip() for *_, t in blocks):
                        raise Broken("no text" if reader else "unknown format")
                    rows += [(path, i, k, s, t, None) for i, (k, s, t) in enumerate(blocks)]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, None, str(e)[:200] or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "block_index", "kind", "style", "text", "error"]).astype({"block_index": "Int64"})

    return files.select("path", "content").mapInPandas(run, BLOCK_ROWS)


class Entries(HTMLParser):
    """Paragraphs, headings, list items with their ordinals and levels, and table rows with all their cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int, int, str]] = []
        self.open, self.text, self.cells, self.lists, self.skip = "", [], None, [], 0

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif tag in ("ol", "ul"):
            self.flush()
            start = attrs.get("start", "1")
            self.lists.append([tag, int(start) if start.lstrip("-").isdigit() else 1])
        elif tag == "li":
            self.flush()
            if self.lists and (attrs.get("value") or "").isdigit():
                self.lists[-1][1] = int(attrs["value"])
            self.open = "li"
        elif tag == "tr":
            self.flush()
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.text = []
        elif tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            if self.cells is None:
                if not (tag == "p" and self.open == "li" and not "".join(self.text).strip()):
                    self.flush()
                    self.open = tag
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(" ".join("".join(self.text).split()))
            self.text = []
        elif tag == "tr" and self.cells is not None:
            if any(self.cells):
                self.out.append(("tr", 0, 0, " | ".join(self.cells)))
            self.cells = None
        elif tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()
        elif tag in ("ol", "ul") and self.lists:
            self.flush()
            self.lists.pop()

    def handle_data(self, data):
        if not self.skip and (self.open or self.cells is not None):
            self.text.append(data)

    def flush(self):
        if self.cells is not None:
            return
        text = " ".join("".join(self.text).split())
        if self.open and text:
            ordinal = 0
            if self.open == "li" and self.lists:
                ordinal = self.lists[-1][1] if self.lists[-1][0] == "ol" else 0
                self.lists[-1][1] += 1
            self.out.append((self.open, ordinal, len(self.lists) if self.open == "li" else 0, text))
        self.open, self.text = "", []


def html_entries(html: str) -> list[tuple[str, int, int, str]]:
    parser = Entries()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.out


def read_html(pages: DataFrame) -> DataFrame:
    """page_id, entry_index, tag, ordinal, level and text of each entry of a page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, *e) for i, h in zip(frame["page_id"], frame["html"], strict=True) for k, e in enumerate(html_entries(h or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "entry_index", "tag", "ordinal", "level", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, entry_index bigint, tag string, ordinal bigint, level bigint, text string")


def make_package(entries: dict[str, str]) -> bytes:
    """A small package, for tests and examples."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def sample_packages(spark: SparkSession) -> DataFrame:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = make_package({
        "word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>GİRİŞ</w:t></w:r></w:p><w:p><w:r><w:t>Bu bu</w:t><w:tab/><w:t>metin</w:t></w:r><w:del><w:r><w:t>silinen</w:t></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>hücre</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
        "word/styles.xml": f'<w:styles {w}><w:style w:styleId="Base"><w:rPr><w:rFonts w:ascii="Times"/></w:rPr></w:style><w:style w:styleId="Heading1"><w:basedOn w:val="Base"/><w:rPr><w:sz w:val="32"/></w:rPr></w:style></w:styles>',
    })
    udf = make_package({"content.xml": "<template><content><![CDATA[İlk satır\n𝒳 ikinci\n]]></content><elements><paragraph Alignment='0'><content startOffset='0' length='10'/></paragraph><paragraph Alignment='1'><content startOffset='10' length='10'/></paragraph></elements></template>"})
    rows = [("a/ornek.docx", bytearray(docx)), ("b/belge.udf", bytearray(udf)), ("c/bozuk.docx", bytearray(b"not a zip")), ("d/not.txt", bytearray(b"x"))]
    return spark.createDataFrame(rows, "path string, content binary")
