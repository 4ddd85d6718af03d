"""The command line end to end on a small folder and repository."""

import json
import subprocess

import pytest

from foliant import cli
from foliant.plans.evaluation import UnknownExpected


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    (root / "notes").mkdir()
    (root / "notes/kettle.md").write_text("# Kettle\nThe kettle has a warranty of two years.\n")
    (root / "notes/tomatoes.md").write_text("# Tomatoes\nThe tomatoes need water in the evenings.\n")
    return root


def run(spark, capsys, place, *args):
    capsys.readouterr()
    cli.main(["--library", str(place / "store"), *args], spark)
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_library_commands(spark, capsys, place):
    do = lambda *a: run(spark, capsys, place, *a)
    do("source", "add", str(place / "notes"))
    assert [s["path"] for s in do("source", "list")] == [str(place / "notes")]
    assert do("index", "--vectors")[0] == {"added": 2, "changed": 0, "unchanged": 0, "removed": 0, "skipped": 0, "reindexed": 0, "no_op": False, "embedded": 2}
    assert do("status") == [{"documents": 2, "chunks": 2}] and do("health") == []
    words = do("find", "--words", "warranties")
    assert [w["path"].rsplit("/", 1)[1] for w in words] == ["kettle.md"] and words[0]["found_by"] == "words"
    assert do("find", "kettle warranty")[0]["path"].endswith("kettle.md")
    assert all(not r["path"].endswith("kettle.md") for r in do("similar", str(place / "notes/kettle.md")))
    assert do("preview", str(place / "notes/kettle.md"), "2")
    (place / "set.json").write_text(json.dumps({"queries": [{"query": "kettle warranty", "expect": ["kettle.md"], "group": "en"}, {"query": "zeppelin", "expect": ["notes/tomatoes.md"], "group": "none"}]}))
    got = {(r["engine"], r["group"]): r for r in do("eval", str(place / "set.json"))}
    assert got["words", "en"]["hit1"] == 1.0
    assert (got["words", None]["queries"], got["words", None]["mrr"]) == (2, 0.5)
    (place / "bad.json").write_text(json.dumps({"queries": [{"query": "x", "expect": ["nowhere.md"]}]}))
    with pytest.raises(UnknownExpected):
        do("eval", str(place / "bad.json"))


def test_repo_and_model_commands(spark, capsys, place):
    root = place / "code"
    root.mkdir()
    (root / "a.ts").write_text('import {b} from "./b";\nexport function f(): void { }\nfunction hidden() { }\n')
    (root / "b.ts").write_text("export const b = 1;\n")
    (root / ".gitignore").write_text(".foliant/\n")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "First words")
    do = lambda action, *a: run(spark, capsys, place, "repo", action, *a, "--root", str(root))
    with pytest.raises(SystemExit):
        do("symbols")
    assert do("index") == [{"files": 2, "symbols": 3, "written": True}]
    assert do("index")[0]["written"] is False
    assert [s["name"] for s in do("symbols", "hid")] == ["hidden"]
    assert do("deps") == [{"from_path": "a.ts", "to_path": "b.ts"}]
    assert [len(s["entries"]) for s in do("summary")] == [1, 1]
    assert [c["summary"] for c in do("history", "WORDS")] == ["First words"] and do("history", "nothing") == []
    assert do("status")[0]["dirty"] is False
    assert len(run(spark, capsys, place, "model", "list")) == 3
