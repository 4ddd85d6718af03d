"""Code analytics: symbols, imports and module summaries of Python, Rust, TypeScript/JavaScript and Go.

Python is read by its own parser; the others by a scanner that blanks strings and comments, finds
declarations at statement starts and closes them by their braces. One file a row, so the work is an
Arrow UDF; symbols and imports are then exploded.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "py": "python", "pyi": "python", "go": "go"}
SPECIFIC = {"constant": 0, "function": 1, "module": 2, "type": 3}
SYMBOL = T.StructType().add("name", "string").add("kind", "string").add("start", "long").add("end", "long").add("line", "long").add("parent", "string").add("signature", "string").add("doc", "string").add("public", "boolean").add("cfg", "string")
IMPORT = T.StructType().add("module", "string").add("line", "long")
FILE = T.StructType().add("symbols", T.ArrayType(SYMBOL)).add("imports", T.ArrayType(IMPORT)).add("header", "string")


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def _dedent(doc: str) -> str:
    return " ".join(" ".join(doc.split("\n\n")[0].split()).split())


# Python


def _python(source: str) -> dict:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return {"symbols": [], "imports": [], "header": None}
    lines = source.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x.encode()) + 1)
    symbols, imports = [], []

    def add(node, name, kind, parent, doc=None, first=None):
        first = first or node
        at = starts[first.lineno - 1] + first.col_offset
        head = lines[node.lineno - 1 : (node.body[0].lineno - 1 if getattr(node, "body", None) else node.end_lineno)] or [lines[node.lineno - 1]]
        text = "\n".join(head)
        if getattr(node, "body", None):
            m = re.search(r":\s*(#.*)?$", text.rstrip()) or re.search(r":(?=[^:\]\)]*$)", text)
            text = text[: m.start()] if m else text
        symbols.append({"name": name, "kind": kind, "start": at, "end": starts[node.end_lineno - 1] + node.end_col_offset, "line": node.lineno, "parent": parent, "signature": " ".join(text.split()), "doc": _dedent(doc) if doc else None, "public": not name.startswith("_"), "cfg": None})

    def walk(body, parent, top):
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(n, ast.ClassDef)
                add(n, n.name, "type" if is_class else "function", parent, ast.get_docstring(n))
                walk(n.body, n.name, False)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)) and (top or parent):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and top:
                        add(n, t.id, "constant", parent)
            elif isinstance(n, (ast.If, ast.Try, ast.With)):
                for part in (n.body, getattr(n, "orelse", []), getattr(n, "finalbody", []), *(h.body for h in getattr(n, "handlers", []))):
                    walk(part, parent, top)

    walk(tree.body, None, True)
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports += [{"module": a.name, "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            imports.append({"module": "." * n.level + (n.module or ""), "line": n.lineno})
    return {"symbols": symbols, "imports": imports, "header": _dedent(ast.get_docstring(tree) or "") or None}


# languages of braces

_BLANKS = {
    "rust": r'//[^\n]*|/\*.*?\*/|b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?\'(?:\\.[^\']*|[^\'\\])\'',
    "typescript": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
    "go": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.[^']*|[^'\\])'",
}
_ID = r"[A-Za-z_$][\w$]*"
_RUST_VIS = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
_RULES = {
    "rust": [
        ("function", rf"^[ \t]*{_RUST_VIS}(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+(?:\S+\s+)?)?fn\s+({_ID})"),
        ("type", rf"^[ \t]*{_RUST_VIS}(?:unsafe\s+)?(?:auto\s+)?(?:struct|enum|union|trait|type)\s+({_ID})"),
        ("scope", rf"^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<(?:[^<>]|<[^<>]*>)*>)?\s+(?:[^{{;]*?\bfor\s+)?(?:&\s*)?(?:\w+::)*({_ID})"),
        ("module", rf"^[ \t]*{_RUST_VIS}mod\s+({_ID})"),
        ("constant", rf"^[ \t]*{_RUST_VIS}(?:const|static)\s+(?:mut\s+)?(?!fn\b)({_ID})\s*:"),
        ("function", rf"^[ \t]*macro_rules!\s*({_ID})"),
    ],
    "typescript": [
        ("function", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*({_ID})"),
        ("type", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+({_ID})"),
        ("type", rf"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+({_ID})\s*(?:<[^=]*>)?\s*="),
        ("module", rf"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+({_ID})"),
        ("function", rf"^(?:export\s+)?(?:const|let|var)\s+({_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]+)?=>|{_ID}\s*=>)"),
        ("constant", rf"^(?:export\s+)?(?:const|let|var)\s+({_ID})"),
        ("method", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?({_ID})\s*(?:<[^>\n]*>)?\([^;{{]*\)\s*(?::[^;{{]+)?\{{"),
    ],
    "go": [
        ("function", rf"^func\s+(?:\([^)]*\)\s*)?({_ID})"),
        ("type", rf"^type\s+({_ID})"),
        ("module", rf"^package\s+({_ID})"),
        ("constant", rf"^(?:const|var)\s+({_ID})"),
    ],
}
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "constructor_"}


def _blank(source: str, language: str) -> str:
    """Strings and comments become blanks of the same length, line breaks stay."""
    return re.sub(_BLANKS[language], lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def _end(code: str, at: int) -> tuple[int, int]:
    """Where a declaration's body opens (or its end) and where it ends."""
    depth, i = 0, at
    opened = None
    while i < len(code):
        c = code[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "{":
            if depth == 0 and opened is None:
                opened = i
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0 and opened is not None:
                return opened, i + 1
            if depth < 0:
                return i, i
        elif c == ";" and depth <= 0:
            return (opened if opened is not None else i), i + 1
        elif c == "\n" and depth <= 0 and opened is None and re.match(r"\s*\n|\s*(?:export|const|let|var|func|type|fn|pub|package|import)\b", code[i:]):
            return i, i
        i += 1
    return len(code), len(code)


def _doc_before(lines: list[str], row: int, language: str) -> tuple[str | None, list[str]]:
    """The comment right above a line, and attributes between (Rust)."""
    out, attrs, i = [], [], row - 1
    while i >= 0:
        s = lines[i].strip()
        if language == "rust" and s.startswith("#["):
            attrs.append(s)
        elif (m := re.match(r"///\s?(.*)" if language == "rust" else r"//\s?(.*)", s)) and not re.match(r"//\s*(eslint|@ts-|go:|nolint|prettier|#)", s):
            out.append(m[1])
        elif s.endswith("*/") and language != "go":
            while i >= 0 and not lines[i].strip().startswith("/*"):
                out.append(re.sub(r"^\s*\*?\s?|\s*\*/\s*$", "", lines[i]))
                i -= 1
            out.append(re.sub(r"^\s*/\*+\s?|\s*\*/\s*$", "", lines[i]) if i >= 0 else "")
        else:
            break
        i -= 1
    text = "\n".join(reversed(out)).strip()
    return (_dedent(text) or None), attrs[::-1]


def directive(comment: str) -> bool:
    """A comment addressed to a tool, or a lone URL."""
    return comment.strip().startswith(X.DIRECTIVES) or re.match(X.LONE_URL, comment.strip()) is not None


def _requires_test(predicate: str) -> bool:
    predicate = predicate.strip()
    if predicate == "test":
        return True
    m = re.fullmatch(r"(all|any)\s*\((.*)\)", predicate, re.S)
    if not m:
        return False
    parts, depth, last = [], 0, 0
    for i, c in enumerate(m[2]):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(m[2][last:i])
            last = i + 1
    parts = [p for p in [*parts, m[2][last:]] if p.strip()]
    return any(map(_requires_test, parts)) if m[1] == "all" else bool(parts) and all(map(_requires_test, parts))


def _braces(source: str, language: str) -> dict:
    code = _blank(source, language)
    lines = source.split("\n")
    offsets = [0]
    for x in lines:
        offsets.append(offsets[-1] + len(x) + 1)
    found: dict[tuple, dict] = {}
    scopes = []
    for kind, pattern in _RULES[language]:
        for m in re.finditer(pattern, code, re.M):
            name = m[1]
            if kind == "method" and name in _NOT_METHODS:
                continue
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            body, end = _end(code, m.end() if kind != "method" else m.end() - 1)
            row = source.count("\n", 0, at)
            signature = " ".join(source[at:body].split()).rstrip(" ;=")
            if kind == "scope":
                scopes.append((at, end, name))
                continue
            kind_ = "function" if kind == "method" else kind
            doc, attrs = _doc_before(lines, row, language)
            cfg = [c[1] for a in attrs if (c := re.match(r"#\[cfg\((.*)\)\]$", a))]
            public = {
                "rust": bool(re.match(r"pub\s+(?!\()", source[at:])) and not any(map(_requires_test, cfg)),
                "typescript": source[at:].startswith("export"),
                "go": name[0].isupper(),
            }[language]
            new = {"name": name, "kind": kind_, "start": len(source[:at].encode()), "end": len(source[:end].encode()), "line": row + 1, "parent": None, "signature": signature, "doc": doc, "public": public, "cfg": ", ".join(cfg) or None, "_at": at, "_end": end}
            old = found.get((at, name))
            if old is None or SPECIFIC[kind_] > SPECIFIC[old["kind"]]:
                found[at, name] = new
    symbols = sorted(found.values(), key=lambda s: (s["_at"], -s["_end"]))
    around = [(s["_at"], s["_end"], s["name"]) for s in symbols if s["_end"] > s["_at"]] + scopes
    for s in symbols:
        outer = [o for o in around if o[0] <= s["_at"] and o[1] >= s["_end"] and (o[0], o[1]) != (s["_at"], s["_end"])]
        s["parent"] = max(outer)[2] if outer else None
    if language == "typescript":  # what an exported class or interface holds is exported with it
        exported = {s["name"] for s in symbols if s["public"]}
        for s in symbols:
            s["public"] = s["public"] or s["parent"] in exported
    for s in symbols:
        del s["_at"], s["_end"]
    header = None
    top = re.match(r"(?:\s*//!.*\n?)+" if language == "rust" else r"\s*(?:/\*\*.*?\*/|(?://[^\n]*\n)+)", source, re.S if language != "rust" else 0)
    if top:
        said = re.sub(r"(?m)^\s*(//!?|/\*+|\*+/|\*)\s?|\s*\*/", "", top[0]).strip()
        header = _dedent("\n".join(x for x in said.split("\n") if not directive(x)).strip()) or None
    return {"symbols": symbols, "imports": _brace_imports(source, code, language), "header": header}


def _brace_imports(source: str, code: str, language: str) -> list[dict]:
    out = []
    line = lambda i: source.count("\n", 0, i) + 1
    if language == "rust":
        for m in re.finditer(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);|^[ \t]*extern\s+crate\s+(\w+)", code):
            out.append({"module": " ".join((m[1] or m[2]).split()), "line": line(m.start(1) if m[1] else m.start(2))})
    elif language == "typescript":
        for m in re.finditer(r"""(?m)(?:^[ \t]*(?:import|export)\b[^;'"()]*?(?:from\s*)?|\bimport\s*\(\s*|\brequire\s*\(\s*)(["'])([^"'\n]+)\1""", source):
            if code[m.start()] == source[m.start()] and (code[m.start() : m.start(1)].strip()):
                out.append({"module": m[2], "line": line(m.start())})
    else:
        for m in re.finditer(r'(?m)^import\s+(?:[\w.]+\s+)?"([^"]+)"|^import\s*\((.*?)\)', source, re.S):
            if m[1]:
                out.append({"module": m[1], "line": line(m.start())})
            else:
                out += [{"module": x[1], "line": line(m.start(2) + x.start())} for x in re.finditer(r'"([^"]+)"', m[2])]
    out.sort(key=lambda i: i["line"])
    return [i for k, i in enumerate(out) if not k or i != out[k - 1]]


def read_source(language: str | None, source: str | None) -> dict:
    if not language or source is None:
        return {"symbols": [], "imports": [], "header": None}
    return _python(source) if language == "python" else _braces(source, language)


@F.pandas_udf(FILE)
def read_source_udf(language: pd.Series, source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_source(a, b) for a, b in zip(language, source)], columns=FILE.names)


def index_files(files: DataFrame) -> DataFrame:
    """files(path, text) -> path, language, hash, symbols, imports, header; files of other languages drop out."""
    rows = files.withColumn("language", language_of(F.col("path"))).where("language is not null")
    return rows.withColumn("f", read_source_udf("language", "text")).select("path", "language", F.sha2("text", 256).alias("hash"), "f.*")


def reindex(files: DataFrame, stored: DataFrame | None) -> DataFrame:
    """index_files(files), where files whose text has the hash that is stored are taken over and only the others are parsed."""
    if stored is None:
        return index_files(files)
    rows = files.withColumn("language", language_of(F.col("path"))).where("language is not null").withColumn("hash", F.sha2("text", 256))
    kept = stored.join(rows.select("path", "hash"), ["path", "hash"], "left_semi").select("path", "language", "hash", *FILE.names)
    fresh = rows.join(stored.select("path", "hash"), ["path", "hash"], "left_anti")
    return kept.unionByName(index_files(fresh.select("path", "text")))


def described(summaries: DataFrame, cache: DataFrame | None) -> DataFrame:
    """summaries(path, hash, text) with `prose` from cache(hash, prose), null where it must be asked for. Equal bytes are one module wherever they lie."""
    if cache is None:
        return summaries.withColumn("prose", F.lit(None).cast("string"))
    return summaries.join(cache.select("hash", "prose").dropDuplicates(["hash"]), "hash", "left")


def describe(summaries: DataFrame, store, generate, table: str = "prose") -> tuple[DataFrame, dict]:
    """summaries with prose for all, and what it took: cached, asked, cost. generate(text) -> (prose, cost or None) is an outside service, asked once
    for each new content hash; each answer is stored before the next one is asked for, as it may have been paid for."""
    spark = summaries.sparkSession
    before = described(summaries, store.read(table))
    todo = before.where("prose is null").groupBy("hash").agg(F.min("text").alias("text")).orderBy("hash")
    spent = {"cached": before.where("prose is not null").count(), "asked": 0, "cost": 0.0}
    for row in todo.toLocalIterator():
        prose, cost = generate(row["text"])
        store.add(table, spark.createDataFrame([(row["hash"], prose)], "hash string, prose string"))
        spent["asked"] += 1
        spent["cost"] += cost or 0.0
    return described(summaries, store.read(table)), spent


def symbols(index: DataFrame, name: str | None = None, kind: str | None = None, under: str | None = None) -> DataFrame:
    """Symbols in order of place; name by part without case, `under` by plain prefix of the path."""
    rows = index.select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    if name:
        rows = rows.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    return (rows.where(F.col("path").startswith(under)) if under else rows).orderBy("path", "start")


def imports(index: DataFrame) -> DataFrame:
    return index.select("path", "language", F.explode("imports").alias("i")).select("path", "language", "i.*")


def summaries(index: DataFrame, everything: bool = False) -> DataFrame:
    """path, header, entries, symbols, public, text: the public declarations of each module as one text."""
    shown = F.filter("symbols", lambda s: s["public"])
    text = F.concat_ws("\n", "path", "header", F.array_join(F.transform(shown, lambda s: F.concat_ws(" - ", s["signature"], s["doc"])), "\n"))
    return index.select("path", "hash", "header", (F.col("symbols") if everything else shown).alias("entries"), F.size("symbols").alias("symbols"), F.size(shown).alias("public"), text.alias("text"))


def fold_declarations(symbols: DataFrame) -> DataFrame:
    """One row for equal span and name: the most specific kind."""
    order = F.create_map(*[F.lit(x) for kv in SPECIFIC.items() for x in kv])[F.col("kind")]
    return symbols.groupBy("path", "start", "end", "name").agg(F.max_by("kind", order).alias("kind"))
