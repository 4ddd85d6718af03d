"""Documents to chunks: at most 1500 characters under one heading.

The fold over lines is sequential in one document, so it runs in an Arrow UDF, one document a row;
explode() then makes the central table of chunks. Nothing is grouped or collected.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import bounded

LIMIT = 1500

CHUNK = T.StructType(
    [
        T.StructField("headings", T.ArrayType(T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("page", T.LongType()),
        T.StructField("recognized", T.BooleanType()),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("chunks", T.ArrayType(CHUNK)),
    ]
)

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t](.*))?$", re.S)
_LINKS = re.compile(r"\[\[(.*?)\]\]")


def lines_of(text: str) -> list[str]:
    """Lines without their ends, as \\n or \\r\\n close them."""
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x.removesuffix("\r") for x in out]


@dataclass
class Packer:
    """Packs paragraphs into chunks; headings, pages and parts close one."""

    chunks: list[dict] = field(default_factory=list)
    path: list[tuple[int, str]] = field(default_factory=list)
    page: int | None = None
    recognized: bool = False
    held: list[str] = field(default_factory=list)  # paragraphs of the open chunk
    held_line: int = 0
    size: int = 0
    open_lines: list[str] = field(default_factory=list)  # lines of the open paragraph
    open_at: int = 0

    def line(self, text: str, number: int) -> None:
        if not self.open_lines:
            self.open_at = number
        self.open_lines.append(text.rstrip())

    def blank(self) -> None:
        """The open paragraph ends."""
        if not self.open_lines:
            return
        taken, self.open_lines = self.open_lines, []
        whole = "\n".join(taken)
        if len(whole) <= LIMIT:
            self.paragraph(whole, self.open_at)
            return
        piece, piece_at = "", self.open_at
        for number, text in enumerate(taken, self.open_at):
            for part in cut_line(text):
                if piece and len(piece) + len(part) + 1 > LIMIT:
                    self.paragraph(piece, piece_at)
                    piece = ""
                if piece:
                    piece += "\n" + part
                else:
                    piece, piece_at = part, number
        if piece:
            self.paragraph(piece, piece_at)

    def paragraph(self, text: str, number: int) -> None:
        if self.held and self.size + 2 + len(text) > LIMIT:
            self.close()
        if self.held:
            self.size += 2
        else:
            self.held_line, self.size = number, 0
        self.size += len(text)
        self.held.append(text)

    def close(self) -> None:
        if self.held:
            self.chunks.append({"headings": [h for _, h in self.path], "text": "\n\n".join(self.held), "line": self.held_line, "page": self.page, "recognized": self.recognized})
            self.held, self.size = [], 0

    def section(self, level: int, heading: str) -> None:
        self.blank()
        self.close()
        while self.path and self.path[-1][0] >= level:
            self.path.pop()
        self.path.append((level, heading))

    def part(self, path: list[str]) -> None:
        self.blank()
        self.close()
        self.path = list(enumerate(path, 1))

    def done(self, page: int | None = None) -> list[dict]:
        self.blank()
        self.close()
        return self.chunks or [{"headings": [], "text": "", "line": 1, "page": page, "recognized": False}]


def cut_line(line: str) -> list[str]:
    """A line over the limit is cut after spaces; a word over the limit wherever the limit falls."""
    if len(line) <= LIMIT:
        return [line]
    parts, part = [], ""
    for word in re.findall(r"[^ ]* |[^ ]+$", line):
        if part and len(part) + len(word) > LIMIT:
            parts.append(part.rstrip())
            part = ""
        if len(word) > LIMIT:
            parts += [word[i : i + LIMIT] for i in range(0, len(word), LIMIT)]
        else:
            part += word
    if part.strip():
        parts.append(part.rstrip())
    return parts


def _fence(line: str) -> tuple[str, int] | None:
    m = re.match(r" {0,3}(`{3,}|~{3,})(.*)", line, re.S)
    if not m or m[1][0] == "`" and "`" in m[2]:
        return None
    return m[1][0], len(m[1])


def _closes(line: str, fence: tuple[str, int]) -> bool:
    m = re.match(rf" {{0,3}}({re.escape(fence[0])}*)(.*)", line, re.S)
    return bool(m) and len(m[1]) >= fence[1] and not m[2].strip()


def heading_of(line: str) -> tuple[int, str] | None:
    m = _HEADING.match(line)
    if not m:
        return None
    text = (m[2] or "").strip()
    bare = text.rstrip("#")
    if bare != text and (not bare or bare.endswith(" ")):
        text = bare.rstrip()
    return len(m[1]), text


def _unquoted(value: str) -> str:
    value = value.strip()
    for q in "\"'":
        if len(value) > 1 and value[0] == value[-1] == q:
            return value[1:-1].strip()
    return value


def front_matter(lines: list[str]) -> tuple[dict, int]:
    """Title, tags and aliases of a leading block between --- lines, and the index of the first line after it."""
    found: dict = {"title": None, "tags": [], "aliases": []}
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip() in ("---", "...")), None) if lines and lines[0].rstrip() == "---" else None
    if end is None:
        return found, 0

    def note(key: str, value: str) -> None:
        value = _unquoted(value)
        if not value:
            return
        if key == "title":
            found["title"] = value
        elif key in ("tag", "tags"):
            value = value.strip().lstrip("#").lower()
            if value and value not in found["tags"]:
                found["tags"].append(value)
        elif key in ("alias", "aliases") and value not in found["aliases"]:
            found["aliases"].append(value)

    key = None
    for row in lines[1:end]:
        item = row.lstrip()
        if item.startswith("- ") or row.strip() == "-":
            if key:
                note(key, item[2:])
            continue
        name, colon, value = row.partition(":")
        if not colon or name[:1] in (" ", "\t"):
            continue
        key, value = name.strip().lower(), value.strip()
        if len(value) > 1 and value[0] == "[" and value[-1] == "]":
            several = value[1:-1].split(",")
        else:
            several = re.split("[, ]", value) if key in ("tag", "tags") else [value]
        for v in several:
            note(key, v)
    return found, end + 1


def inline_tags(line: str) -> list[str]:
    """#tags at the start of a word that aren't numbers only."""
    out, i = [], 0
    while (i := line.find("#", i)) >= 0:
        if i and (line[i - 1].isalnum() or line[i - 1] in "#&/_"):
            i += 1
            continue
        j = i + 1
        while j < len(line) and (line[j].isalnum() or line[j] in "_-/"):
            j += 1
        body = line[i + 1 : j].rstrip("/-")
        if any(c not in "0123456789" for c in body):
            out.append(body.lower())
        i += 1 + len(body)
    return out


def inline_links(line: str) -> list[str]:
    targets = (m.split("|")[0].split("#")[0].strip() for m in _LINKS.findall(line))
    return [t for t in targets if t and "[" not in t]


def _without_code(line: str) -> str:
    """Code spans and their marks become blanks; one that isn't closed runs to the end."""
    return " ".join(p if i % 2 == 0 else " " * len(p) for i, p in enumerate(line.split("`")))


def read_markdown(stem: str, text: str) -> dict:
    lines = lines_of(text)
    front, body = front_matter(lines)
    tags, links, first = list(front["tags"]), [], None
    pack, fence = Packer(), None
    for number, line in enumerate(lines[body:], body + 1):
        if fence:
            pack.line(line, number)
            fence = None if _closes(line, fence) else fence
        elif fence := _fence(line):
            pack.line(line, number)
        elif head := heading_of(line):
            if head[0] == 1 and first is None and head[1]:
                first = head[1]
            links += inline_links(head[1])
            pack.section(*head)
        elif not line.strip():
            pack.blank()
        else:
            prose = _without_code(line)
            tags += inline_tags(prose)
            links += inline_links(prose)
            pack.line(line, number)
    title = front["title"] if front["title"] is not None else first
    return {"title": title or stem, "aliases": front["aliases"], "tags": list(dict.fromkeys(tags)), "links": list(dict.fromkeys(links)), "chunks": pack.done()}


def read_plain(stem: str, text: str) -> dict:
    pack = Packer()
    for number, line in enumerate(lines_of(text), 1):
        if line.strip():
            pack.line(line, number)
        else:
            pack.blank()
    return {"title": stem, "aliases": [], "tags": [], "links": [], "chunks": pack.done()}


def clean_page(page: str) -> str:
    """Soft hyphens join what they part, compatibility forms fold, spaces collapse by line."""
    joined = unicodedata.normalize("NFKC", re.sub("\\s*\xad\\s*", "", page))
    return "\n".join(" ".join(w for w in re.split("[ \t]", line) if w) for line in lines_of(joined))


def names_a_document(title: str, stem: str) -> bool:
    name, dot, ext = title.rpartition(".")
    file_like = bool(dot and name and 1 <= len(ext) <= 5 and ext.isascii() and ext.isalnum())
    return any(c.isalpha() for c in title) and title.lower() != stem.lower() and not file_like


def read_paged(stem: str, pages: list[str], bookmarks: list[dict] = (), title: str | None = None, recognized: list[int] = ()) -> dict:
    """bookmarks: {page, path}; a page stands under the last one at or before it."""
    marks = sorted((b for b in bookmarks if b["path"]), key=lambda b: b["page"])
    pack, line, at, path = Packer(), 0, 0, []
    for number, page in enumerate(pages, 1):
        while at < len(marks) and marks[at]["page"] <= number:
            path, at = list(marks[at]["path"]), at + 1
        pack.part(path)
        pack.page, pack.recognized = number, number in recognized
        for text in lines_of(clean_page(page)):
            line += 1
            if text.strip():
                pack.line(text, line)
            else:
                pack.blank()
    title = (title or "").strip()
    return {"title": stem, "aliases": [title] if names_a_document(title, stem) else [], "tags": [], "links": [], "chunks": pack.done(1)}


def read_picture(stem: str, text: str) -> dict:
    out = read_plain(stem, clean_page(text))
    for c in out["chunks"]:
        c["recognized"] = True
    return out


def read_blocks(stem: str, blocks: list[dict], title: str | None = None, aliases: list[str] = ()) -> dict:
    """blocks: {kind: heading|part|paragraph, level, path, text}; a line is a block's ordinal, with gaps between blocks."""
    pack, line = Packer(), 0
    for b in blocks:
        if b["kind"] == "heading":
            pack.section(max(1, b["level"]), b["text"])
            line += 1
        elif b["kind"] == "part":
            pack.part(list(b["path"]))
        else:
            for text in lines_of(b["text"]):
                line += 1
                pack.line(text, line)
            pack.blank()
        line += 1
    title = (title or "").strip()
    named = title if names_a_document(title, stem) else stem
    others = [a.strip() for a in aliases] + ([stem] if named != stem else [])
    return {"title": named, "aliases": list(dict.fromkeys(a for a in others if names_a_document(a, named))), "tags": [], "links": [], "chunks": pack.done()}


def read(kind: str, stem: str, text: str | None) -> dict:
    text = (text or "").removeprefix("\ufeff")
    if kind == "markdown":
        return read_markdown(stem, text)
    if kind == "pdf":
        return read_paged(stem, text.split("\f"))
    if kind == "image":
        return read_picture(stem, text)
    return read_plain(stem, text)


@F.pandas_udf(DOCUMENT)
def read_udf(kind: pd.Series, stem: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read(k, s, t) for k, s, t in zip(kind, stem, text)], columns=[f.name for f in DOCUMENT])


def documents(files: DataFrame) -> DataFrame:
    """files(path, kind, text, ...) -> the same with title, aliases, tags, links, chunks."""
    bounded(files.sparkSession)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    kept = [c for c in files.columns if c != "text"]
    return files.withColumn("d", read_udf("kind", stem, "text")).select(*kept, "d.*")


def chunks(docs: DataFrame) -> DataFrame:
    """One row for each chunk, with the fields of its document beside it."""
    kept = [F.col(c) for c in docs.columns if c != "chunks"]
    return docs.select(*kept, F.explode("chunks").alias("c")).select(*[c for c in docs.columns if c != "chunks"], "c.headings", F.col("c.text").alias("body"), "c.line", "c.page", "c.recognized")
