"""HTML, EPUB and DOCX to blocks: headings, parts and paragraphs; PDF and pictures through hooks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.batches import bounded
from ..operators import chunker
from . import pdf

SKIPPED = {"head", "script", "style", "nav", "template", "noscript", "svg", "math", "iframe", "rt", "rp"}
BLOCKS = {
    "p", "div", "section", "article", "main", "header", "footer", "aside", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "caption", "pre",
    "blockquote", "figure", "figcaption", "address", "h1", "h2", "h3", "h4", "h5", "h6", "body", "form", "fieldset", "details", "summary",
}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}


def collapse(text: str) -> str:
    return " ".join(text.split())


def is_note_mark(text: str) -> bool:
    mark = text.strip().strip("[]()")
    return bool(re.fullmatch(r"[0-9]{1,3}|[*†‡§]+", mark))


def same_title(entry: str, heading: str) -> bool:
    h = collapse(heading).lower()
    return bool(h) and collapse(entry).lower() == h


class PageReader(HTMLParser):
    """One page to blocks; `anchors` maps element ids to the contents path that begins there."""

    def __init__(self, anchors: dict[str, list[str]] | None = None, headings: bool = True, path: list[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.anchors, self.use_headings, self.path = anchors or {}, headings, list(path or [])
        self.blocks: list[dict] = []
        self.title = ""
        self.buffer = ""
        self.open: list[str] = []
        self.skip: int | None = None
        self.level: int | None = None
        self.pre = 0
        self.in_title = False
        self.link: tuple[int, int] | None = None

    def flush(self) -> None:
        lines = [x for x in map(collapse, self.buffer.split("\n")) if x]
        self.buffer = ""
        if lines:
            self.blocks.append({"kind": "paragraph", "level": 0, "path": [], "text": "\n".join(lines)})

    def _heading(self) -> None:
        text, self.buffer = collapse(self.buffer), ""
        if self.use_headings:
            if text:
                self.blocks.append({"kind": "heading", "level": self.level, "path": [], "text": text})
        elif not (self.path and same_title(self.path[-1], text)):
            self.buffer = text
            self.flush()
        self.level = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "title":
            self.in_title = not self.title
        if tag not in _VOID:
            self.open.append(tag)
        if self.skip is not None:
            return
        note = "noteref" in (a.get("epub:type") or a.get("type") or "").split() or "doc-noteref" in (a.get("role") or "").split()
        if (tag in SKIPPED or note) and tag not in _VOID:
            self.skip = len(self.open)
            return
        if a.get("id") in self.anchors:
            self.flush()
            self.path = self.anchors[a["id"]]
            self.blocks.append({"kind": "part", "level": 0, "path": list(self.path), "text": ""})
        if tag in BLOCKS or tag == "hr":
            self.flush()
        if tag == "pre":
            self.pre += 1
        elif re.fullmatch("h[1-6]", tag):
            self.level = int(tag[1])
        elif tag in ("td", "th") and self.buffer.strip():
            self.buffer += " · "
        elif tag == "br":
            self.buffer += "\n"
        elif tag == "a" and self.link is None and "#" in (a.get("href") or ""):
            self.link = (len(self.open), len(self.buffer))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in _VOID or tag not in self.open:
            return
        depth = len(self.open) - self.open[::-1].index(tag)
        del self.open[depth - 1 :]
        if self.skip is not None:
            if depth <= self.skip:
                self.skip = None
            return
        if tag == "pre":
            self.pre = max(0, self.pre - 1)
        if self.link and self.link[0] >= depth:
            if is_note_mark(self.buffer[self.link[1] :]):
                self.buffer = self.buffer[: self.link[1]]
            self.link = None
        if self.level and re.fullmatch("h[1-6]", tag):
            self._heading()
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif self.skip is None:
            self.buffer += data if self.pre else re.sub(r"\s+", " ", data)


def read_html(html: str, anchors=None, headings: bool = True, path=None) -> tuple[str, list[dict], list[str]]:
    """Title, blocks, and the contents path in force at the end."""
    reader = PageReader(anchors, headings, path)
    reader.feed(html)
    reader.close()
    reader.flush()
    return collapse(reader.title), reader.blocks, reader.path


def resolve(base: str, href: str) -> str:
    """A path inside an archive from a relative reference, without its fragment."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.split("#")[0]))).lstrip("/")


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _contents(archive: zipfile.ZipFile, manifest: dict, base: str) -> list[tuple[str, str, list[str]]]:
    """(file, fragment, path of titles) from the navigation document or the NCX."""
    out: list[tuple[str, str, list[str]]] = []
    nav = next((h for h, (_, props) in manifest.items() if "nav" in props.split()), None)
    ncx = next((h for h, (kind, _) in manifest.items() if kind == "application/x-dtbncx+xml"), None)
    if nav:
        root = ET.fromstring(archive.read(nav))

        def walk(ol, above):
            for li in ol:
                a = next((x for x in li if _local(x) in ("a", "span")), None)
                title = collapse("".join(a.itertext())) if a is not None else ""
                here = [*above, title] if title else above
                if a is not None and a.get("href"):
                    out.append((resolve(nav, a.get("href")), a.get("href").partition("#")[2], here))
                for sub in li:
                    if _local(sub) == "ol":
                        walk(sub, here)

        found = [n for n in root.iter() if _local(n) == "nav"]
        toc = next((n for n in found if "toc" in str(n.attrib.values())), found[0] if found else None)
        if toc is not None:
            for ol in toc:
                if _local(ol) == "ol":
                    walk(ol, [])
    elif ncx:

        def points(node, above):
            for p in node:
                if _local(p) == "navPoint":
                    title = collapse("".join("".join(x.itertext()) for x in p if _local(x) == "navLabel"))
                    src = next((x.get("src") for x in p if _local(x) == "content"), "")
                    here = [*above, title] if title else above
                    out.append((resolve(ncx, src), src.partition("#")[2], here))
                    points(p, here)

        for m in ET.fromstring(archive.read(ncx)).iter():
            if _local(m) == "navMap":
                points(m, [])
    return out


def read_epub(data: bytes) -> dict:
    """title, aliases, blocks, error."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    names = set(archive.namelist())
    if "META-INF/rights.xml" in names or "META-INF/encryption.xml" in names and b"EncryptedKey" in archive.read("META-INF/encryption.xml"):
        return {"title": None, "aliases": [], "blocks": [], "error": "locked"}
    opf = next(x.get("full-path") for x in ET.fromstring(archive.read("META-INF/container.xml")).iter() if _local(x) == "rootfile")
    package = ET.fromstring(archive.read(opf))
    items = {x.get("id"): x for x in package.iter() if _local(x) == "item"}
    manifest = {resolve(opf, x.get("href")): (x.get("media-type") or "", x.get("properties") or "") for x in items.values()}
    titles = [collapse("".join(x.itertext())) for x in package.iter() if _local(x) == "title"]
    contents = _contents(archive, manifest, opf)
    blocks: list[dict] = []
    path: list[str] = []
    for ref in (x for x in package.iter() if _local(x) == "itemref"):
        item = items.get(ref.get("idref"))
        name = resolve(opf, item.get("href")) if item is not None else ""
        if name not in names or "nav" in (item.get("properties") or "").split():
            continue
        whole = next((p for f, frag, p in contents if f == name and not frag), None)
        if whole:
            path = whole
            blocks.append({"kind": "part", "level": 0, "path": list(path), "text": ""})
        anchors = {frag: p for f, frag, p in contents if f == name and frag}
        _, got, path = read_html(archive.read(name).decode("utf-8", "replace"), anchors, headings=not contents, path=path)
        blocks += got
    return {"title": titles[0] if titles else None, "aliases": titles[1:], "blocks": blocks, "error": None}


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(data: bytes) -> dict:
    """title, aliases, blocks, error. Notes follow the paragraph that refers to them; contents lines and comments are left out."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    names = set(archive.namelist())
    body = ET.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    levels = {}
    if "word/styles.xml" in names:
        for s in ET.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
            name = s.find(f"{_W}name")
            m = re.fullmatch(r"heading ([1-9])", (name.get(f"{_W}val") if name is not None else "").lower())
            outline = s.find(f"{_W}pPr/{_W}outlineLvl")
            if m or outline is not None:
                levels[s.get(f"{_W}styleId")] = int(m[1]) if m else int(outline.get(f"{_W}val")) + 1
    notes = {}
    for kind in ("footnotes", "endnotes"):
        if f"word/{kind}.xml" in names:
            for n in ET.fromstring(archive.read(f"word/{kind}.xml")):
                notes[kind[:-1], n.get(f"{_W}id")] = n
    blocks: list[dict] = []

    def text_of(p) -> tuple[str, list]:
        out, asked = [], []
        for e in p.iter():
            tag = e.tag.removeprefix(_W)
            if tag == "t":
                out.append(e.text or "")
            elif tag == "tab":
                out.append("\t")
            elif tag in ("br", "cr"):
                out.append("\n")
            elif tag in ("footnoteReference", "endnoteReference"):
                asked.append((tag.removesuffix("Reference"), e.get(f"{_W}id")))
        return "\n".join(x for x in map(collapse, "".join(out).split("\n")) if x), asked

    def paragraph(p) -> None:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        style = style.get(f"{_W}val") if style is not None else ""
        if re.match(r"(?i)toc", style or ""):
            return
        text, asked = text_of(p)
        if text and style in levels:
            blocks.append({"kind": "heading", "level": levels[style], "path": [], "text": collapse(text)})
        elif text:
            blocks.append({"kind": "paragraph", "level": 0, "path": [], "text": text})
        for key in asked:
            if key in notes:
                note = collapse(" ".join(text_of(q)[0] for q in notes[key].iter(f"{_W}p")))
                if note:
                    blocks.append({"kind": "paragraph", "level": 0, "path": [], "text": note})

    def walk(node) -> None:
        for e in node:
            tag = e.tag.removeprefix(_W)
            if tag == "p":
                paragraph(e)
            elif tag == "tbl":
                for row in e.iter(f"{_W}tr"):
                    cells = [collapse(" ".join(text_of(p)[0] for p in c.iter(f"{_W}p"))) for c in row.iter(f"{_W}tc")]
                    if any(cells):
                        blocks.append({"kind": "paragraph", "level": 0, "path": [], "text": " · ".join(c for c in cells if c)})
            elif tag in ("sdt", "sdtContent", "ins", "smartTag", "customXml"):
                walk(e)

    walk(body)
    title = None
    if "docProps/core.xml" in names:
        title = next((collapse(x.text or "") for x in ET.fromstring(archive.read("docProps/core.xml")).iter() if _local(x) == "title"), None)
    return {"title": title or None, "aliases": [], "blocks": blocks, "error": None}


def container_kind(data: bytes) -> str | None:
    """epub, docx or neither, by what the archive declares."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = set(archive.namelist())
        if "mimetype" in names and archive.read("mimetype").strip() == b"application/epub+zip":
            return "epub"
        types = archive.read("[Content_Types].xml").decode("utf-8", "replace") if "[Content_Types].xml" in names else ""
    except (zipfile.BadZipFile, OSError, RuntimeError):
        return None
    main = ("wordprocessingml.document.main", "wordprocessingml.template.main", "ms-word.document.macroenabled.main")
    return "docx" if any(m in types.lower() for m in main) else None


#: The reader of PDF files, bytes -> {pages, bookmarks, title, recognized}; another one may take its place.
pdf_reader: Callable[[bytes], dict] = pdf.read
#: Recognition of pictures needs an engine that is not part of this library: bytes -> text.
ocr_engine: Callable[[bytes], str] | None = None

READ = T.StructType([*chunker.DOCUMENT.fields, T.StructField("kind", T.StringType()), T.StructField("error", T.StringType())])


def read_bytes(stem: str, kind: str | None, text: str | None, data: bytes | None) -> dict:
    """One file of any kind to a document; what can't be read says why."""
    none = {"title": stem, "aliases": [], "tags": [], "links": [], "chunks": [], "kind": kind, "error": None}
    try:
        if kind in ("markdown", "text"):
            return none | chunker.read(kind, stem, text)
        if kind == "zip":
            kind = container_kind(data)
            if kind is None:
                return none | {"error": "not a document"}
        if kind in ("epub", "docx"):
            got = (read_epub if kind == "epub" else read_docx)(data)
            if got["error"]:
                return none | {"kind": kind, "error": got["error"]}
            return none | chunker.read_blocks(stem, got["blocks"], got["title"], got["aliases"]) | {"kind": kind}
        if kind == "pdf":
            try:
                got = pdf_reader(data)
            except pdf.Locked:
                return none | {"error": "locked"}
            return none | chunker.read_paged(stem, got["pages"], got.get("bookmarks", ()), got.get("title"), got.get("recognized", ()))
        if kind == "image" and ocr_engine:
            return none | chunker.read_picture(stem, ocr_engine(data))
    except Exception as e:  # a damaged file is reported, the others go on
        return none | {"kind": kind, "error": f"damaged: {type(e).__name__}"}
    return none | {"error": "no reader" if kind == "image" else "not a document"}


@F.pandas_udf(READ)
def read_udf(stem: pd.Series, kind: pd.Series, text: pd.Series, data: pd.Series) -> pd.DataFrame:
    rows = [read_bytes(s, k, t, None if d is None else bytes(d)) for s, k, t, d in zip(stem, kind, text, data)]
    return pd.DataFrame(rows, columns=READ.names)


@F.pandas_udf(chunker.DOCUMENT)
def html_udf(stem: pd.Series, html: pd.Series) -> pd.DataFrame:
    out = []
    for s, h in zip(stem, html):
        title, blocks, _ = read_html(h or "")
        out.append(chunker.read_blocks(s, blocks, title))
    return pd.DataFrame(out, columns=chunker.DOCUMENT.names)


def html_documents(pages: DataFrame, key: str, html: str) -> DataFrame:
    """pages to documents: title, aliases, tags, links, chunks beside the key."""
    bounded(pages.sparkSession)
    return pages.select(key, html_udf(F.col(key).cast("string"), html).alias("d")).select(key, "d.*")


def fill_pages(pages: DataFrame, recognized: DataFrame) -> DataFrame:
    """pages(path, page, text) with the text of pages that hold none taken from recognized(path, page, text), and `recognized` where it was."""
    other = recognized.where(F.trim("text") != "").select("path", "page", F.col("text").alias("seen"))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    filled = pages.join(other, ["path", "page"], "left")
    return filled.select("path", "page", F.when(blank, F.coalesce("seen", "text")).otherwise(F.col("text")).alias("text"), (blank & F.col("seen").isNotNull()).alias("recognized"))


def best_reading(readings: DataFrame) -> DataFrame:
    """readings(path, page, recognizer, text) -> the reading of each page with most letters in clean words; ties to the first name."""
    score = F.struct(X.clean_letters(F.col("text")).alias("n"), F.struct("recognizer", "text").alias("r"))
    best = readings.groupBy("path", "page").agg(F.min_by(score["r"], F.struct(-score["n"], "recognizer")).alias("r"))
    return best.select("path", "page", "r.*")


def layout_paragraphs(lines: DataFrame) -> DataFrame:
    """lines(page, nth, text, top, height) of recognized text -> page, text: a gap of more than 0.8 line heights parts paragraphs.

    The line height is the upper median of the page; a word broken by a hyphen at a line's end is joined.
    """
    from pyspark.sql import Window as W

    h = F.array_sort(F.collect_list("height").over(W.partitionBy("page")))
    order = W.partitionBy("page").orderBy("nth")
    gap = F.col("top") - F.lag(F.col("top") + F.col("height")).over(order)
    marked = lines.withColumn("median", F.get(h, F.floor(F.size(h) / 2).cast("int"))).withColumn("new", F.coalesce((gap > 0.8 * F.col("median")).cast("int"), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text", "new"))), lambda x: F.concat(F.when(x["new"] == 1, "\n\n").otherwise("\n"), x["text"])), "")
    return marked.groupBy("page").agg(F.regexp_replace(F.regexp_replace(text, r"^\n+", ""), r"(?<=\p{L})-\n(?=\p{Ll})", "").alias("text"))
