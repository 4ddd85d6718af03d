"""Library end to end on real folders: updates, search, backlinks, health, previews, streams, histories."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from foliant.operators import code, fusion, links, words
from foliant.plans.library import Library, Overlap
from foliant.sources import files, git
from foliant.sources.store import Busy, Store
from foliant.streaming import bursts


def put(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("notes"))
    put(root, "kettle.md", "# Kettle\nThe kettle has a warranty of two years. See [[tomatoes]].\n")
    put(root, "garden/tomatoes.md", "# Tomatoes\nThe tomatoes need water in the evenings.\n")
    put(root, "bicycle.txt", "The bicycle needs a chain. INV-2025-0114.\n")
    put(root, "чай.md", "Чай заваривают вечером.\n")
    put(root, "drafts/no.md", "ignored zeppelin\n")
    put(root, ".gitignore", "drafts/\n")
    lib = Library(spark, "file://" + str(tmp_path_factory.mktemp("store")))
    lib.add_source(root)
    report = lib.update()
    lib.root_folder = root
    assert (report.added, report.removed) == (4, 0)
    return lib


def names(df):
    return [os.path.basename(r["path"]) for r in df.orderBy(F.desc("score"), "path").collect()]


def test_stemmed_search_and_fallback(library):
    found, every = library.search_words("warranties kettles")
    assert every and names(found) == ["kettle.md"]
    found, every = library.search_words("kettle zeppelin")
    # the other note holds the word in the title of what links to it
    assert not every and {os.path.basename(r["path"]): r["share"] for r in found.collect()} == {"kettle.md": 0.5, "tomatoes.md": 0.5}
    assert names(library.search_words("INV-2025-0114")[0]) == ["bicycle.txt"]
    assert names(library.search_words("вечером")[0]) == ["чай.md"]
    assert library.search_words("  ")[0].count() == 0
    hit = library.search_words("kettle")[0].first()
    assert [hit["fragment"].encode()[h["start"] : h["end"]].decode().lower() for h in hit["highlights"]] == ["kettle"]


def test_backlinks_and_overlap(library):
    row = library.chunks().where("title = 'Tomatoes'").first()
    assert row["backlinks"] == ["Kettle"] and row["backlink_count"] == 1
    with pytest.raises(Overlap):
        library.add_source(library.root_folder + "/garden")


def test_no_op_update_and_scope(library):
    assert library.update().no_op
    path = put(library.root_folder, "garden/new.md", "A brand new zeppelin.\n")
    assert library.update([path]).added == 1
    assert names(library.search_words("zeppelin")[0]) == ["new.md"]
    os.remove(path)
    assert library.update([path]).removed == 1
    assert library.search_words("zeppelin")[0].count() == 0


def test_an_update_writes_the_changed_documents_only(library):
    def segments(table):
        meta = library.store.meta(table)
        return {n: library.store._open(table, meta, [n]).count() for n in meta["segments"]}

    before = segments("chunks")
    path = put(library.root_folder, "bicycle.txt", "The bicycle has a bell and a dynamo.\n")
    assert library.update([path]).changed == 1
    after = segments("chunks")
    assert {n: c for n, c in after.items() if n in before} == before and [c for n, c in after.items() if n not in before] == [1]
    assert names(library.search_words("dynamo")[0]) == ["bicycle.txt"] and library.search_words("chain")[0].count() == 0
    library.merge()
    assert len(segments("chunks")) == 1 and sum(segments("chunks").values()) == library.chunks().count() == 4
    assert names(library.search_words("dynamo")[0]) == ["bicycle.txt"]
    put(library.root_folder, "bicycle.txt", "The bicycle needs a chain. INV-2025-0114.\n")
    assert library.update([path]).changed == 1 and names(library.search_words("chain")[0]) == ["bicycle.txt"]
    assert not library.store._names("_read")


def test_files_that_could_not_be_read_are_kept_in_mind(library):
    path = os.path.join(library.root_folder, "broken.docx")
    with open(path, "wb") as f:
        f.write(b"PK\x03\x04 no archive")
    assert library.update([path]).skipped == 1
    assert [(os.path.basename(r["path"])) for r in library.health().collect()] == ["broken.docx"]
    assert library.update().skipped == 0 and library.health().count() == 1  # refused as it was, not tried again
    os.remove(path)
    library.update()
    assert library.health().count() == 0


def test_vectors_and_one_list(library):
    assert library.update_vectors() == 4 and library.update_vectors() == 0
    found, _ = library.search("tomatoes water", now=10**9)
    rows = found.collect()
    assert os.path.basename(rows[0]["path"]) == "tomatoes.md" and rows[0]["words_rank"] == 1 and rows[0]["meaning_rank"] == 1
    path = rows[0]["path"]
    assert path not in [r["path"] for r in library.similar(path, now=10**9).collect()]
    near = library.similar(passage="The tomatoes need water in the evenings.", now=10**9).orderBy(F.desc("score"), "path").first()
    assert near["path"] == path
    told = library.explain(library.search("zeppelin evenings garden", now=10**9)[0], "zeppelin evenings garden").where("why is not null").collect()
    assert all(r["why"]["sentence"] in r["why"]["window"]["fragment"] for r in told)
    assert all(r["words_rank"] is None for r in told)


def test_status_health_preview(library):
    assert library.status().first()["documents"] == 4
    assert library.health().count() == 0
    path = library.chunks().where("title = 'Kettle'").first()["path"]
    assert [r["offset"] for r in library.preview(path, 1).collect()] == [0]


def test_fused_order(spark):
    w = spark.createDataFrame([("answer", 1, 9.0, 1.0, 0), ("b", 2, 8.0, 1.0, 0), ("c", 3, 7.0, 1.0, 0)], "path string, rank int, score double, share double, modified long")
    m = spark.createDataFrame([("answer", 1, 0.9, 0), ("d", 2, 0.8, 0)], "path string, rank int, score double, modified long")
    assert [r["path"] for r in fusion.fuse(w, m, 0).collect()] == ["answer", "b", "c", "d"]


def test_common_words_give_way(spark):
    rows = [("a", "the espresso machine"), ("b", "the receipt for an espresso"), ("c", "the garden"), ("d", "the end")]
    chunks = words.analyzed(spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, body string, line long"))
    assert words.distinctive("the espresso zeppelin", chunks) == "espresso zeppelin"
    found, every = words.search(chunks, "the espresso zeppelin")
    assert not every and {r["path"]: r["share"] for r in found.collect()} == {"a": 0.5, "b": 0.5}


def test_store_pointers(spark, tmp_path):
    """A reader that has begun keeps its rows through the next write; a crash leaves the old state; a lock left behind gives way."""
    s = Store(spark, f"file://{tmp_path}")
    s.write("t", spark.range(3))
    begun = s.read("t")
    s.write("t", spark.range(5))
    assert begun.count() == 3 and s.read("t").count() == 5
    n = s.add("t", spark.range(2))
    assert s.read("t").count() == 7 and s.read("t", segments=True).where(F.col("seg") == n).count() == 2
    s._segment("t", spark.range(9), ())  # written, but never pointed to
    assert s.read("t").count() == 7
    s.write("t", spark.range(1))
    s.write("t", spark.range(2))
    assert len([x for x in s._names("t") if x.startswith("seg=")]) == 2
    lock = s.lock()
    lock.__enter__()
    with pytest.raises(Busy):
        s.lock().__enter__()
    os.utime(f"{tmp_path}/_lock", (0, 0))
    with s.lock():
        pass


def test_parsed_files_are_taken_over(spark):
    files_ = spark.createDataFrame([("a.py", "def f(): pass\n"), ("b.py", "x = 1\n"), ("c.txt", "no")], "path string, text string")
    first = code.index_files(files_).cache()
    changed = spark.createDataFrame([("a.py", "def f(): pass\n"), ("b.py", "def g(): pass\n")], "path string, text string")
    again = code.reindex(changed, first.withColumn("header", F.lit("kept")))
    assert {(r["path"], r["header"], len(r["symbols"])) for r in again.collect()} == {("a.py", "kept", 1), ("b.py", None, 1)}


def test_prose_is_asked_for_once(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("a", "h1", "one"), ("b", "h2", "two"), ("c", "h1", "one")], "path string, hash string, text string")
    asked = []

    def generate(text):
        asked.append(text)
        return f"about {text}", 0.5 if text == "one" else None

    got, spent = code.describe(rows, s, generate)
    assert {r["path"]: r["prose"] for r in got.collect()} == {"a": "about one", "b": "about two", "c": "about one"}
    assert sorted(asked) == ["one", "two"] and spent == {"cached": 0, "asked": 2, "cost": 0.5}
    assert code.describe(rows, s, generate)[1] == {"cached": 3, "asked": 0, "cost": 0.0}


def test_directives_are_no_headers():
    ts = code.read_source("typescript", "// @vitest-environment jsdom\n// Reads the settings.\nexport const a = 1;\n")
    assert ts["header"] == "Reads the settings."


def test_store_one_writer_and_formats(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    assert s.write("t", spark.range(3)) and not s.write("t", spark.range(3)) and s.write("t", spark.range(4))
    assert s.read("t").count() == 4
    with s.lock(), pytest.raises(Busy), s.lock():
        pass
    with pytest.raises(RuntimeError):
        Store(spark, f"file://{tmp_path}", 2).read("t")


def test_sniffing(spark):
    rows = [(b"%PDF-1.7", "pdf"), (b"RIFF\0\0\0\0WEBPxx", "image"), (b"RIFF\0\0\0\0WAVE", "other"), (b"\0\0\0\x18ftypheic", "image"), (b"\0\0\0\x18ftypisom", "other"), (b"BM" + b"\0" * 12 + b"\x28\0\0\0", "image"), (b"BMW is a car, not a picture", "text"), (b"", "text")]
    got = spark.createDataFrame([(bytearray(b), w) for b, w in rows], "content binary, want string").select(files.sniff(F.col("content"))["format"].alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_ignore_rules():
    rules = [("", "*.tmp", False), ("", "build/", False), ("", "keep.tmp", True), ("sub", "/x.md", False)]
    assert [files.ignored(p, rules) for p in ("a.tmp", "d/keep.tmp", "build/a.md", "build", "sub/x.md", "sub/y/x.md", "a.md")] == [True, False, True, False, True, False, False]


def test_code():
    rust = code.read_source("rust", "/// Doc.\npub struct A<T> { x: T }\nimpl<T> A<T> {\n    pub fn f(&self) -> u32 { 1 }\n}\n#[cfg(all(test, unix))]\npub mod tests {}\nuse std::io::{Read, Write};\n// fn no() {}\n")
    assert [(s["name"], s["kind"], s["parent"], s["public"]) for s in rust["symbols"]] == [("A", "type", None, True), ("f", "function", "A", True), ("tests", "module", None, False)]
    assert [i["module"] for i in rust["imports"]] == ["std::io::{Read, Write}"]
    ts = code.read_source("typescript", 'import {a} from "./a";\nexport class B {\n  m(x: number): void { }\n}\nconst y = require("./z");\nt("./no");\n')
    assert [s["name"] for s in ts["symbols"]] == ["B", "m", "y"] and [i["module"] for i in ts["imports"]] == ["./a", "./z"]
    go = code.read_source("go", 'package m\nimport (\n"fmt"\n)\nfunc (r *R) Do() {}\ntype t struct { }\n')
    assert [(s["name"], s["public"]) for s in go["symbols"]] == [("m", False), ("Do", True), ("t", False)]
    py = code.read_source("python", '"""Mod."""\nfrom .a import b\nclass A:\n    """Doc."""\n    def _f(self, x: int) -> int:\n        return 1\n')
    assert [(s["name"], s["parent"], s["public"]) for s in py["symbols"]] == [("A", None, True), ("_f", "A", False)] and py["header"] == "Mod."
    assert py["symbols"][1]["signature"] == "def _f(self, x: int) -> int" and py["imports"] == [{"module": ".a", "line": 2}]


def test_imports_resolve(spark):
    asked = spark.createDataFrame([("src/a.ts", "typescript", "./b"), ("src/a.ts", "typescript", "../lib"), ("p/x.py", "python", ".")], "path string, language string, module string")
    there = spark.createDataFrame([("src/b.tsx",), ("lib/index.ts",), ("p/__init__.py",)], "path string")
    assert {tuple(r) for r in links.resolve_imports(asked, there).collect()} == {("src/a.ts", "src/b.tsx"), ("src/a.ts", "lib/index.ts"), ("p/x.py", "p/__init__.py")}


def test_git_history(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    put(tmp_path, "src/a.py", "x = 1\n")
    run("add", "-A")
    run("commit", "-qm", "First\n\nbody text")
    put(tmp_path, "src/b.py", "y = 1\n")
    run("add", "-A")
    run("commit", "-qm", "Second")
    got = git.commits(spark, str(tmp_path)).orderBy("nth").collect()
    assert [(r["summary"], r["body"], r["paths"]) for r in got] == [("Second", None, ["src/b.py"]), ("First", "body text", ["src/a.py"])]
    assert git.matching(git.commits(spark, str(tmp_path)), "BODY", "src").count() == 1
    assert [r["path"] for r in git.work_tree(spark, str(tmp_path)).collect()] == ["src/a.py", "src/b.py"]
    assert [r["path"] for r in git.changed_paths(spark, str(tmp_path), "HEAD~1", "HEAD").collect()] == ["src/b.py"]
    assert git.revision(spark, str(tmp_path)).first()["dirty"] is False
    with pytest.raises(git.NotARepository):
        git.head("/")


def test_bursts_in_batch(spark):
    at = [0, 100, 450, 2000] + [10_000 + 400 * i for i in range(20)]
    e = spark.createDataFrame([("s", t / 1000) for t in at], "source string, t double").select("source", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"))
    assert sorted(r["n"] for r in bursts.capped_bursts(e).collect()) == [1, 3, 7, 13]


def test_bursts_in_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "source string, path string, everything boolean"
    spark.createDataFrame([("s", "/a", False), ("s", "/b", False), ("t", None, True)], schema).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).parquet(str(folder))
    seen = []
    q = bursts.each_burst(bursts.streaming_bursts(stream, 50, 200), seen.append, str(tmp_path / "ck"))
    try:
        import time

        for _ in range(40):
            if seen:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert seen and (None in seen or ["/a", "/b"] in [sorted(x) for x in seen if x])
