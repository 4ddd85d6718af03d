"""Bytes to text: marks first, then two-byte text without a mark, UTF-8 with little damage, and legacy encodings by guess."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]
_RANGES = [(0x20, 0x7E), (0xA0, 0x2FF), (0x370, 0x6FF), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2100, 0x214F)]
_CONTROLS = bytes([*range(0x00, 0x09), *range(0x0E, 0x1A), *range(0x1C, 0x20), 0x7F])


def _textlike(c: str) -> bool:
    return c in "\t\n\r\f" or any(a <= ord(c) <= b for a, b in _RANGES)


def _controls(data: bytes) -> int:
    """Control bytes in a thousand."""
    return (len(data) - len(data.translate(None, _CONTROLS))) * 1000 // max(1, len(data))


def _two_bytes(data: bytes) -> tuple[str, str] | None:
    if len(data) % 2 == 0:
        for name in ("utf-16-le", "utf-16-be"):
            try:
                text = data.decode(name)
            except UnicodeDecodeError:
                continue
            if text and 100 * sum(map(_textlike, text)) >= 98 * len(text):
                return text, name
    return None


def _utf8(data: bytes) -> tuple[str, bool] | None:
    """Text and whether it is a guess: a cut last character is dropped, up to one broken in a hundred others is borne."""
    try:
        return data.decode(), False
    except UnicodeDecodeError as e:
        if e.reason == "unexpected end of data" and e.end == len(data):
            return data[: e.start].decode(), False
    text = data.decode("utf-8", "replace")
    broken = text.count("�")
    good = sum(not c.isascii() for c in text) - broken
    return (text, True) if broken * 100 <= good else None


def decode(data: bytes) -> dict:
    """text, encoding, guessed, error."""
    out = {"text": None, "encoding": None, "guessed": False, "error": None}
    for mark, name in _MARKS:
        if data.startswith(mark):
            return out | {"text": data[len(mark) :].decode(name, "replace"), "encoding": name}
    if 0 in data:
        if two := _two_bytes(data):
            return out | {"text": two[0], "encoding": two[1], "guessed": True}
        if _controls(data) <= 1:
            try:
                return out | {"text": data.decode().replace("\0", ""), "encoding": "utf-8"}
            except UnicodeDecodeError:
                pass
        return out | {"error": "binary data"}
    if (got := _utf8(data)) is not None:
        return out | {"text": got[0], "encoding": "utf-8", "guessed": got[1]}
    if _controls(data) > 1:
        return out | {"error": "binary data"}
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(data).best()
    except ImportError:
        best = None
    name = best.encoding if best else "cp1252"
    return out | {"text": data.decode(name, "replace"), "encoding": name, "guessed": True}


@F.pandas_udf(T.StructType().add("text", "string").add("encoding", "string").add("guessed", "boolean").add("error", "string"))
def _decode(col: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode(bytes(x) if x is not None else b"") for x in col], columns=["text", "encoding", "guessed", "error"])


def decoded(content: Column) -> Column:
    return _decode(content)
