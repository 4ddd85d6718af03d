"""PDF text layers: files are put together here, object by object."""

import zlib

import pytest
from pyspark.sql import functions as F

from foliant.operators import chunker
from foliant.sources import markup, pdf


def file(objects: dict[int, bytes], trailer: bytes = b"<< /Root 1 0 R /Info 9 0 R >>") -> bytes:
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % (n, o) for n, o in objects.items()) + b"trailer\n" + trailer + b"\n%%EOF"


def stream(data: bytes, extra: bytes = b"", deflate: bool = True) -> bytes:
    data = zlib.compress(data) if deflate else data
    return b"<< /Length %d %b %b >>\nstream\n%b\nendstream" % (len(data), b"/Filter /FlateDecode" if deflate else b"", extra, data)


CMAP = b"1 beginbfchar <0003> <0414> endbfchar 1 beginbfrange <0010> <0012> <0430> endbfrange"
BASE = {
    1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 10 0 R >>",
    2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R >>",
    4: b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R] >>",
    5: b"<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [250] /Encoding << /Differences [1 /fi /uni00E9] >> >>",
    6: b"<< /Type /Font /Subtype /Type0 /DescendantFonts [<< /DW 600 >>] /ToUnicode 13 0 R >>",
    7: stream(b"BT /F1 12 Tf 14 TL 72 700 Td (The \\(first\\) l) Tj [(ine) -600 (goes) 20 (on)] TJ T* (a \\001ne caf\\002) Tj 0 -60 Td (Next part) Tj ET"),
    8: stream(b"BT /F2 12 Tf 1 0 0 1 72 700 Tm <0003001000110012> Tj ET", deflate=False),
    9: b"<< /Title (A manual) >>",
    10: b"<< /First 11 0 R >>",
    11: b"<< /Title <FEFF004F006E0065> /Dest [3 0 R /Fit] /First 12 0 R >>",
    12: b"<< /Title (  Two\n deep ) /A << /S /GoTo /D [4 0 R /XYZ 0 0 0] >> >>",
    13: stream(CMAP),
}


def test_pages_bookmarks_and_title():
    got = pdf.read(file(BASE))
    assert got["pages"] == ["The (first) line goeson\na fine café\n\nNext part", "Дабв"]
    assert got["bookmarks"] == [{"page": 1, "path": ["One"]}, {"page": 2, "path": ["One", "Two deep"]}]
    assert got["title"] == "A manual"


def test_objects_in_streams_and_damaged_pages():
    inner = {3: BASE[3], 4: BASE[4], 5: BASE[5]}
    body, head = b"", b""
    for n, o in inner.items():
        head += b"%d %d " % (n, len(body))
        body += o + b" "
    packed = {n: o for n, o in BASE.items() if n not in inner} | {20: stream(head + body, b"/Type /ObjStm /N 3 /First %d" % len(head))}
    assert pdf.read(file(packed))["pages"][1] == "Дабв"
    broken = BASE | {7: b"<< /Length 5 /Filter /FlateDecode >>\nstream\nxxxxx\nendstream"}
    assert pdf.read(file(broken))["pages"] == ["", "Дабв"]
    with pytest.raises(zlib.error):
        pdf.read(file(broken | {8: broken[7]}))
    with pytest.raises(ValueError):
        pdf.read(b"no such file")
    loop = BASE | {2: b"<< /Kids [2 0 R 3 0 R] >>", 3: BASE[3][:-2] + b"/Resources << /Font << /F1 5 0 R >> >> >>"}
    assert len(pdf.read(file(loop))["pages"]) == 1


def test_predictors_and_other_filters():
    rows = b"".join(bytes([2, *(b ^ 0 for b in r)]) for r in (b"abc", b"\x01\x01\x01"))
    assert pdf._unpredicted(rows, {"Predictor": 12, "Columns": 3}) == b"abcbcd"
    d = pdf.Document(file(BASE))
    assert d.content(pdf.Stream({"Filter": [pdf.Name("ASCIIHexDecode")]}, b"61 62>")) == b"ab"
    assert d.content(pdf.Stream({"Filter": pdf.Name("ASCII85Decode")}, b"<~@:E^~>")) == b"abc"


def test_empty_password_and_others():
    owner, first = bytes(range(32)), b"0123456789abcdef"
    key = pdf.hashlib.md5(pdf._PAD + owner + (0xFFFFFFFC).to_bytes(4, "little") + first).digest()[:5]
    cipher = lambda n, data: pdf._rc4(pdf.hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0").digest()[:10], data)
    text = b"BT /F1 12 Tf 72 700 Td (secret words) Tj ET"
    locked = BASE | {7: stream(cipher(7, text), deflate=False), 8: stream(cipher(8, b""), deflate=False)}
    entry = lambda u: b"<< /Filter /Standard /V 1 /R 2 /P -4 /O <%b> /U <%b> >>" % (owner.hex().encode(), u.hex().encode())
    trailer = b"<< /Root 1 0 R /ID [<%b> <00>] /Encrypt 30 0 R >>" % first.hex().encode()
    assert pdf.read(file(locked | {30: entry(pdf._rc4(key, pdf._PAD))}, trailer))["pages"][0] == "secret words"
    with pytest.raises(pdf.Locked):
        pdf.read(file(locked | {30: entry(bytes(32))}, trailer))


def test_pdf_files_become_chunks(spark):
    rows = [("a.pdf", bytearray(file(BASE))), ("b.pdf", bytearray(b"%PDF-1.7 damaged"))]
    d = spark.createDataFrame(rows, "path string, content binary").withColumn("d", markup.read_udf(F.col("path"), F.lit("pdf"), F.lit(None).cast("string"), F.col("content")))
    got = {r["path"]: r["d"] for r in d.collect()}
    assert got["b.pdf"]["error"].startswith("damaged") and got["a.pdf"]["error"] is None
    chunks = chunker.chunks(d.where("d.error is null").select("path", "d.title", "d.chunks")).orderBy("page").collect()
    assert [(c["page"], c["headings"]) for c in chunks] == [(1, ["One"]), (2, ["One", "Two deep"])] and "fine" in chunks[0]["body"]
