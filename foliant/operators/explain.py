"""Why a row was found: sentences, marks of the asked words, the closest sentence and the window around it.

Offsets are UTF-8 bytes, ends exclusive, as in stored highlights.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stem import stem
from ..functions.text import FRAGMENT, WORD_LIMIT

MOST_SENTENCES = 32
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())])
_WORD = re.compile(r"[^\W_]+")
_LAYOUT = re.compile(
    r"[ \t]*(?:>[ \t]*)*"  # quotes
    r"(?:(?:[-*+]|\d{1,9}[.)]|#{1,6})(?=[ \t])[ \t]*)?"  # list items and headings
    r"(?:\[[ xX]\](?=[ \t])[ \t]*|\[!(?:[^\W_]|-)+\][+-]?[ \t]*)?"  # tasks and callouts
)


def _bytes(s: str) -> int:
    return len(s.encode())


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Sentences end at line breaks and at . ! ? … before white space; marks of layout in front of a line don't count."""
    out, base = [], 0
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        begin = _LAYOUT.match(line).end()
        cuts = [begin, *(m.end() for m in re.finditer(r"[.!?…](?=\s|$)", line) if m.end() > begin), len(line)]
        for a, b in zip(cuts, cuts[1:]):
            piece = line[a:b]
            bare = piece.strip()
            if any(c.isalnum() for c in bare):
                at = base + _bytes(line[:a]) + _bytes(piece[: len(piece) - len(piece.lstrip())])
                out.append((at, at + _bytes(bare), bare))
        base += _bytes(line)
    return out


def marks(text: str, terms: set[str], stemmed: bool = True) -> list[tuple[int, int]]:
    """Byte ranges of words whose stem is asked for."""
    out = []
    for m in _WORD.finditer(text):
        w = m[0].lower()
        if _bytes(m[0]) < WORD_LIMIT and (stem(w) if stemmed else w) in terms:
            at = _bytes(text[: m.start()])
            out.append((at, at + _bytes(m[0])))
    return out


def best_fragment(text: str, terms: set[str], limit: int = FRAGMENT, stemmed: bool = True) -> tuple[str, list[tuple[int, int]]]:
    """The stretch of at most `limit` characters with most different asked words, and its marks; else the opening."""
    hits = [(m.start(), m.end(), stem(m[0].lower()) if stemmed else m[0].lower()) for m in _WORD.finditer(text)]
    hits = [h for h in hits if h[2] in terms]
    best = (0, 0, 0)
    for i, (a, _, _) in enumerate(hits):
        inside = [h for h in hits[i:] if h[1] - a <= limit]
        key = (len({h[2] for h in inside}), len(inside), -i)
        best = max(best, (*key[:2], -a), key=lambda k: k[:2])
    start = -best[2] if best[0] else 0
    start = max((m.end() for m in re.finditer(r"\s", text[max(0, start - 40) : start])), default=0) + max(0, start - 40) if start > 40 else 0
    part = text[start : start + limit]
    part = part.rstrip() + ("…" if start + limit < len(text) else "")
    return part, marks(part, terms, stemmed)


def window(text: str, start: int, end: int) -> tuple[str, int, int]:
    """The fragment shown for a sentence given by byte offsets, and where the sentence lies in it."""
    data = text.encode()
    lead = "…" if data[:start].decode().strip() else ""
    rest = data[start:].decode()
    cut = rest[:FRAGMENT] if len(rest) > FRAGMENT else None
    shown = cut.rstrip() + "…" if cut is not None else rest.rstrip()
    length = min(_bytes(cut) if cut is not None else _bytes(rest), end - start)
    inner = _bytes(rest.encode()[:length].decode("utf-8", "ignore").rstrip())
    return lead + shown, _bytes(lead), _bytes(lead) + inner


@F.pandas_udf(T.ArrayType(SPAN))
def sentences_udf(col: pd.Series) -> pd.Series:
    return col.map(lambda t: [{"start": a, "end": b, "text": s} for a, b, s in sentences(t or "")])


def marks_column(text: Column, terms: list[str], stemmed: bool = True) -> Column:
    asked = set(terms)

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda t: [{"start": a, "end": b} for a, b in marks(t or "", asked, stemmed)])

    return run(text)


def fragment_column(text: Column, terms: list[str], stemmed: bool = True) -> Column:
    asked = set(terms)

    @F.pandas_udf("fragment string, highlights array<struct<start:long,end:long>>")
    def run(col: pd.Series) -> pd.DataFrame:
        rows = [best_fragment(t or "", asked, stemmed=stemmed) for t in col]
        return pd.DataFrame({"fragment": [f for f, _ in rows], "highlights": [[{"start": a, "end": b} for a, b in m] for _, m in rows]})

    return run(text)


@F.pandas_udf(T.StructType().add("fragment", "string").add("start", "long").add("end", "long"))
def window_udf(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([window(t, int(a), int(b)) for t, a, b in zip(text, start, end)], columns=["fragment", "start", "end"])


def each_sentence(rows: DataFrame, text: str = "body", *keys: str) -> DataFrame:
    """keys, nth, start, end, text: the first 32 sentences of each row."""
    return rows.select(*keys, F.posexplode(F.slice(sentences_udf(text), 1, MOST_SENTENCES)).alias("nth", "s")).select(*keys, "nth", "s.*")


def closest_sentence(scored: DataFrame, *keys: str) -> DataFrame:
    """scored(keys, nth, start, end, score): the closest of each; the first wins ties."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "nth"))
    return scored.withColumn("r", rank).where("r = 1").drop("r")


def wants_why(meaning_rank: Column, highlights: Column, closest: Column) -> Column:
    return meaning_rank.isNotNull() & (F.size(F.coalesce(highlights, F.array())) == 0) & closest.isNull()


def utf16_ranges(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """UTF-8 byte ranges as UTF-16 ranges, in order; one that doesn't fall on characters' edges is dropped."""
    at, total, units = {0: 0}, 0, 0
    for c in text:
        total += _bytes(c)
        units += 2 if ord(c) > 0xFFFF else 1
        at[total] = units
    return sorted((at[a], at[b]) for a, b in ranges if a in at and b in at and at[a] < at[b])


def ordered_marks(marks: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Marks (start, end, kind) by start, the longer first, without those that begin inside the one before."""
    out: list[tuple[int, int, str]] = []
    for m in sorted(marks, key=lambda m: (m[0], -m[1])):
        if m[0] < m[1] and (not out or m[0] >= out[-1][1]):
            out.append(m)
    return out


def split_highlights(fragment: str, ranges: list[tuple[int, int]]) -> list[tuple[str, bool]]:
    """The pieces of a fragment in order, and whether each is marked; ranges in UTF-8 bytes."""
    data, out, at = fragment.encode(), [], 0
    for a, b, _ in ordered_marks([(a, b, "word") for a, b in ranges if b <= len(data)]):
        out += [(data[at:a], False), (data[a:b], True)]
        at = b
    return [(piece.decode("utf-8", "replace"), marked) for piece, marked in [*out, (data[at:], False)] if piece]
