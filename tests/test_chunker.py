"""Chunk shapes, front matter, tags, links, pages, blocks; markup and encodings."""

import io
import zipfile

import pytest

from foliant.operators import chunker as C
from foliant.operators import explain
from foliant.sources import decode, markup


def shape(doc):
    return [(c["headings"], c["text"], c["line"]) for c in doc["chunks"]]


def test_markdown_sections():
    doc = C.read_markdown("n", "---\ntitle: T\ntags: [Home, '#Tea']\naliases:\n- other\n---\nintro #Kitchen/x/ [[Note|n]] `#no [[m]]`\n# One\n## Two\ntext\n\n# Three ##\nlast\n")
    assert doc["title"] == "T" and doc["aliases"] == ["other"] and doc["tags"] == ["home", "tea", "kitchen/x"] and doc["links"] == ["Note"]
    assert shape(doc) == [([], "intro #Kitchen/x/ [[Note|n]] `#no [[m]]`", 7), (["One", "Two"], "text", 10), (["Three"], "last", 13)]


def test_fences_hold_headings_and_closing_needs_the_mark():
    doc = C.read_markdown("n", "````\n# no\n```\n````\n# yes\nx\n")
    assert shape(doc) == [([], "````\n# no\n```\n````", 1), (["yes"], "x", 6)]


def test_packing_limits():
    doc = C.read_plain("n", "\n\n".join("p" * 700 for _ in range(3)))
    assert [len(c["text"]) for c in doc["chunks"]] == [1402, 700] and [c["line"] for c in doc["chunks"]] == [1, 5]
    assert all(len(c["text"]) <= C.LIMIT for c in C.read_plain("n", "word " * 2000)["chunks"])
    assert [len(x) for x in C.cut_line("x" * 3200)] == [1500, 1500, 200]


def test_empty_documents_have_one_chunk():
    for kind in ("markdown", "text", "pdf", "image"):
        assert [c["text"] for c in C.read(kind, "n", "")["chunks"]] == [""]


def test_pages_follow_bookmarks():
    doc = C.read_paged("n", ["a\u00ad\nb", "c", "d"], [{"page": 2, "path": ["X"]}, {"page": 2, "path": ["X", "Y"]}], "A title")
    assert [(c["headings"], c["text"], c["page"]) for c in doc["chunks"]] == [([], "ab", 1), (["X", "Y"], "c", 2), (["X", "Y"], "d", 3)]
    assert doc["aliases"] == ["A title"]


def test_html():
    title, blocks, _ = markup.read_html("<title>T &amp; x</title><nav>no</nav><h1>One</h1><p>a <b>b</b><br>c<a href='#n'>[1]</a></p><table><tr><td>1<td>2</tr></table><script>x</script><pre>k  l</pre>")
    assert title == "T & x"
    assert [(b["kind"], b["text"]) for b in blocks] == [("heading", "One"), ("paragraph", "a b\nc"), ("paragraph", "1 · 2"), ("paragraph", "k l")]


def test_epub_and_docx():
    def archive(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)
        return out.getvalue()

    epub = archive({
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
        "o/p.opf": '<package><metadata><title>Book of tea</title></metadata><manifest><item id="n" href="nav.xhtml" properties="nav" media-type="x"/><item id="a" href="a.xhtml" media-type="x"/></manifest><spine><itemref idref="a"/></spine></package>',
        "o/nav.xhtml": '<html><nav type="toc"><ol><li><a href="a.xhtml">Part</a><ol><li><a href="a.xhtml#s">Sub</a></li></ol></li></ol></nav></html>',
        "o/a.xhtml": '<html><body><h1>Part</h1><p>one</p><p id="s">two</p></body></html>',
    })
    doc = markup.read_bytes("file", "zip", None, epub)
    assert (doc["kind"], doc["title"], doc["error"]) == ("epub", "Book of tea", None)
    assert [(c["headings"], c["text"]) for c in doc["chunks"]] == [(["Part"], "one"), (["Part", "Sub"], "two")]

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    docx = archive({
        "[Content_Types].xml": "wordprocessingml.document.main",
        "word/styles.xml": f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/document.xml": f'<w:document {w}><w:body>{p("Head", "H1")}{p("Body")}{p("Contents", "TOC1")}<w:tbl><w:tr><w:tc>{p("1")}</w:tc><w:tc>{p("2")}</w:tc></w:tr></w:tbl></w:body></w:document>',
    })
    doc = markup.read_bytes("file", "zip", None, docx)
    assert [(c["headings"], c["text"]) for c in doc["chunks"]] == [(["Head"], "Body\n\n1 · 2")]
    assert markup.read_bytes("f", "zip", None, b"PK\x03\x04broken")["error"] == "not a document"


@pytest.mark.parametrize(
    "data,text,guessed",
    [
        ("привет".encode("utf-16"), "привет", False), (b"\xef\xbb\xbftea", "tea", False), ("привет, мир".encode("utf-16-le"), "привет, мир", True),
        ("Гарантия ".encode() + "я".encode()[:1], "Гарантия ", False), (b"a\0" + b"b" * 2001, "a" + "b" * 2001, False), (bytes(range(256)), None, False),
    ],
)
def test_decoding(data, text, guessed):
    got = decode.decode(data)
    assert (got["text"], got["guessed"]) == (text, guessed)


def test_sentences_and_windows():
    text = "- [ ] One. Two!\n> 3. é it\n...\n"
    assert [s for _, _, s in explain.sentences(text)] == ["One.", "Two!", "é it"]
    a, b, _ = explain.sentences(text)[2]
    assert text.encode()[a:b].decode() == "é it"
    fragment, start, end = explain.window(text, a, b)
    assert fragment.startswith("…") and fragment.encode()[start:end].decode() == "é it"
    assert explain.marks("Kettles boil", {"kettl"}) == [(0, 7)]
