"""Source code as rows of symbols, imports and complexity measures.

Python is read with the standard library's parser; other languages with
signature patterns per language and brace or indentation matching, which finds
declarations but not every construct of a full grammar.
"""

from __future__ import annotations

import ast
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import lines

SYMBOLS = (
    "file string, ord int, name string, kind string, signature string, docstring string, start_line int, end_line int, parent string, "
    "visibility string, calls array<string>, extends string, implements array<string>"
)
COMPLEXITY = (
    "file string, name string, start_line int, cyclomatic int, cognitive int, nesting int, parameters int, returns int, loc int, "
    "n1 int, n2 int, total1 int, total2 int"
)

_ID = r"[A-Za-z_$][\w$]*"
#: Per family: (kind, pattern with the groups name and, where there is one, parent types).
_C_LIKE = [("class", rf"\bclass\s+(?P<name>{_ID})"), ("interface", rf"\binterface\s+(?P<name>{_ID})"), ("enum", rf"\benum\s+(?:class\s+)?(?P<name>{_ID})")]
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "javascript": [*_C_LIKE[:1], ("function", rf"\bfunction\s*\*?\s*(?P<name>{_ID})\s*\("), ("function", rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*=>")],
    "typescript": [
        *_C_LIKE, ("type", rf"\btype\s+(?P<name>{_ID})\s*[=<]"), ("function", rf"\bfunction\s*\*?\s*(?P<name>{_ID})\s*[(<]"),
        ("function", rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?\([^)]*\)[^=]*=>"),
    ],
    "rust": [
        ("function", rf"\bfn\s+(?P<name>{_ID})"), ("struct", rf"\bstruct\s+(?P<name>{_ID})"), ("enum", rf"\benum\s+(?P<name>{_ID})"),
        ("trait", rf"\btrait\s+(?P<name>{_ID})"), ("macro", rf"\bmacro_rules!\s*(?P<name>{_ID})"), ("module", rf"\bmod\s+(?P<name>{_ID})\s*\{{"),
        ("constant", rf"\b(?:const|static)\s+(?P<name>[A-Z_][A-Z0-9_]*)\s*:"), ("type", rf"\btype\s+(?P<name>{_ID})\s*[=<]"),
    ],
    "go": [
        ("method", rf"^func\s+\([^)]*\)\s*(?P<name>{_ID})\s*\("), ("function", rf"^func\s+(?P<name>{_ID})\s*[(\[]"),
        ("struct", rf"\btype\s+(?P<name>{_ID})\s+struct\b"), ("interface", rf"\btype\s+(?P<name>{_ID})\s+interface\b"),
    ],
    "java": [*_C_LIKE, ("method", rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\],.? ]+\s+(?P<name>{_ID})\s*\(")],
    "c": [("struct", rf"\bstruct\s+(?P<name>{_ID})\s*\{{"), ("enum", rf"\benum\s+(?P<name>{_ID})\s*\{{"), ("function", rf"^(?:[\w*]+\s+)+\*?(?P<name>{_ID})\s*\([^;]*$")],
    "ruby": [("class", r"^\s*class\s+(?P<name>[A-Z]\w*)"), ("module", r"^\s*module\s+(?P<name>[A-Z]\w*)"), ("method", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!]?)")],
    "php": [*_C_LIKE, ("function", rf"\bfunction\s+(?P<name>{_ID})\s*\(")],
    "swift": [*_C_LIKE[:1], ("struct", rf"\bstruct\s+(?P<name>{_ID})"), ("interface", rf"\bprotocol\s+(?P<name>{_ID})"), ("function", rf"\bfunc\s+(?P<name>{_ID})")],
    "kotlin": [*_C_LIKE, ("function", rf"\bfun\s+(?:<[^>]*>\s*)?(?P<name>{_ID})\s*\(")],
    "bash": [("function", r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{")],
}
PATTERNS |= {"cpp": [*_C_LIKE[:1], *PATTERNS["c"]], "csharp": PATTERNS["java"], "scala": [*_C_LIKE[:1], ("trait", rf"\btrait\s+(?P<name>{_ID})"), ("function", rf"\bdef\s+(?P<name>{_ID})")]}
_KEYWORDS = frozenset("if for while switch catch return sizeof function match fn def func elif else with".split())


def _visibility(name: str, line: str, language: str) -> str:
    if language == "python":
        dunder = name.startswith("__") and name.endswith("__")
        return "public" if dunder or not name.startswith("_") else "private" if name.startswith("__") else "protected"
    if language == "rust":
        return "internal" if "pub(crate)" in line else "public" if re.match(r"\s*pub\b", line) else "private"
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    found = re.search(r"\b(public|private|protected|internal)\b", line)
    return found[1] if found else "public"


def _python(source: str) -> list[dict]:
    out: list[dict] = []

    def visit(node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                bases = [ast.unparse(b) for b in child.bases] if is_class else []
                if is_class:
                    inside = [*bases, *[ast.unparse(k) for k in child.keywords]]
                    signature = f"class {child.name}({', '.join(inside)})" if inside else f"class {child.name}"
                else:
                    returns = f" -> {ast.unparse(child.returns)}" if child.returns else ""
                    signature = f"{'async ' * isinstance(child, ast.AsyncFunctionDef)}def {child.name}({ast.unparse(child.args)}){returns}"
                called = [ast.unparse(c.func).rpartition(".")[2] for c in ast.walk(child) if isinstance(c, ast.Call)] if not is_class else []
                out.append(
                    {
                        "name": child.name, "kind": "class" if is_class else "method" if parent else "function", "signature": signature,
                        "docstring": ast.get_docstring(child), "start_line": child.lineno, "end_line": child.end_lineno, "parent": parent,
                        "visibility": _visibility(child.name, "", "python"), "calls": sorted(set(called)),
                        "extends": bases[0] if bases else None, "implements": bases[1:],
                    }
                )
                visit(child, child.name if is_class else parent)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                module = getattr(child, "module", None)
                for alias in child.names:
                    out.append(_plain(alias.name if module is None else module, "import", child.lineno, child.end_lineno))
            else:
                visit(child, parent)

    visit(ast.parse(source), None)
    return out


def _plain(name: str, kind: str, start: int, end: int, **more: object) -> dict:
    return {
        "name": name, "kind": kind, "signature": None, "docstring": None, "start_line": start, "end_line": end, "parent": None,
        "visibility": "public", "calls": [], "extends": None, "implements": [], **more,
    }


def _block_end(text: list[str], start: int) -> int:
    """The last line (from 1) of the braces that open at or just after a line; without braces the line itself."""
    depth, opened = 0, False
    for i in range(start - 1, len(text)):
        for c in text[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
        if opened and depth <= 0:
            return i + 1
        if not opened and (text[i].rstrip().endswith(";") or i > start + 3):
            return start
    return len(text) if opened else start


def _by_pattern(source: str, language: str) -> list[dict]:
    text = source.split("\n")
    compiled = [(kind, re.compile(p)) for kind, p in PATTERNS[language]]
    found: list[dict] = []
    for number, line in enumerate(text, 1):
        if line.lstrip().startswith(("//", "#", "*", "/*")) and language not in ("bash", "ruby"):
            continue
        for kind, pattern in compiled:
            m = pattern.search(line)
            if not m or m["name"] in _KEYWORDS:
                continue
            end = _block_end(text, number) if language not in ("ruby",) else number
            body = "\n".join(text[number:end])
            calls = {c for c in re.findall(rf"\b({_ID})\s*\(", body) if c not in _KEYWORDS}
            bases = re.search(r"\bextends\s+([\w.$]+)", line)
            others = re.search(r"\bimplements\s+([\w.$, ]+)", line)
            comment = []
            for above in reversed(text[: number - 1]):
                if not re.match(r"\s*(?:///|//|/\*\*|\*|#\[|@|\*/)", above):
                    break
                comment.append(re.sub(r"^\s*(?:///?|/\*\*|\*/|\*)\s?", "", above).strip())
            found.append(
                _plain(
                    m["name"], kind, number, end, signature=line.strip().rstrip("{").strip(), docstring="\n".join(c for c in reversed(comment) if c) or None,
                    visibility=_visibility(m["name"], line, language), calls=sorted(calls - {m["name"]}) if kind in ("function", "method") else [],
                    extends=bases[1] if bases else None, implements=[x.strip() for x in others[1].split(",")] if others else [],
                )
            )
            break
    for symbol in found:  # the innermost type around a function
        around = [s for s in found if s is not symbol and s["kind"] in ("class", "interface", "struct", "trait") and s["start_line"] < symbol["start_line"] <= s["end_line"]]
        if around:
            symbol["parent"] = min(around, key=lambda s: s["end_line"] - s["start_line"])["name"]
            symbol["kind"] = "method" if symbol["kind"] == "function" else symbol["kind"]
    return found


def symbols_of(source: str | None, language: str | None) -> list[dict]:
    """Symbols of one file; none for unknown languages or what Python can't parse."""
    if not source or language is None:
        return []
    try:
        return _python(source) if language == "python" else _by_pattern(source, language) if language in PATTERNS else []
    except (SyntaxError, ValueError, RecursionError):
        return []


def parse_symbols(files: DataFrame, path: str = "path", language: str = "language", content: str = "content") -> DataFrame:
    """Symbols of files, one row each."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SYMBOLS.split(", ")]
        for batch in batches:
            rows = [
                {"file": f, "ord": k, **s}
                for f, lang, body in zip(batch["path"], batch["language"], batch["content"], strict=True)
                for k, s in enumerate(symbols_of(body, lang))
            ]
            yield pd.DataFrame(rows, columns=names)

    chosen = files.select(F.col(path).alias("path"), F.col(language).alias("language"), F.col(content).alias("content"))
    return chosen.mapInPandas(parse, SYMBOLS)


# Import patterns by language.
IMPORT_PATTERNS = {
    "python": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "javascript": r"""(?:from\s+|require\(\s*|import\s+)['"]([^'"]+)['"]""",
    "typescript": r"""(?:from\s+|require\(\s*|import\s+)['"]([^'"]+)['"]""",
    "rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)",
    "go": r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*$""",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",
}


def imports(files: DataFrame, path: str = "path", language: str = "language", content: str = "content") -> DataFrame:
    """(path, source) of every import statement, by expressions."""
    found = F.array().cast("array<string>")
    for name, pattern in IMPORT_PATTERNS.items():
        own = F.regexp_extract_all(F.col(content), F.lit(pattern), F.lit(1))
        if name == "python":
            own = F.concat(own, F.regexp_extract_all(F.col(content), F.lit(pattern), F.lit(2)))
        found = F.when(F.col(language) == name, own).otherwise(found)
    return files.select(path, F.explode(F.filter(found, lambda s: s != "")).alias("source"))


def import_candidates(source: Column, directory: Column) -> Column:
    """Paths that an import may mean, in order of preference."""
    dotted = F.replace(source, F.lit("."), F.lit("/"))
    relative = F.concat(F.when(directory != "", F.concat(directory, F.lit("/"))).otherwise(F.lit("")), F.regexp_replace(source, r"^\./", ""))
    made = [relative, *[F.concat(relative, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")]]
    made += [F.concat(dotted, F.lit(e)) for e in (".py", "/__init__.py", ".java", ".rs", "/mod.rs")]
    made += [F.concat(F.lit("src/"), dotted, F.lit(e)) for e in (".py", ".rs", "/mod.rs")]
    return F.array(*made)


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, source, resolved, is_external): the first candidate that is a file; none: external."""
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    tried = found.select("path", "source", F.posexplode(import_candidates(F.col("source"), directory)).alias("k", "candidate"))
    hit = tried.join(files.select(F.col("path").alias("candidate")), "candidate").groupBy("path", "source").agg(F.min_by("candidate", "k").alias("resolved"))
    return found.join(hit, ["path", "source"], "left").withColumn("is_external", F.col("resolved").isNull())


_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.BinOp, ast.comprehension)
_FLOW = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.Match)


def complexity_of(node: ast.AST) -> dict[str, int]:
    """Measures of one Python function."""
    inner = [n for n in ast.walk(node) if n is not node]
    bools = sum(len(n.values) - 1 for n in inner if isinstance(n, ast.BoolOp))
    cases = sum(len(n.cases) for n in inner if isinstance(n, ast.Match))
    cognitive = deepest = 0
    work = [(child, 0) for child in ast.iter_child_nodes(node)]
    while work:
        n, depth = work.pop()
        if isinstance(n, _FLOW):
            deepest = max(deepest, depth + 1)
            cognitive += 0 if isinstance(n, ast.With) else 1 + depth
            depth += 1
        elif isinstance(n, (ast.Break, ast.Continue)):
            cognitive += 1
        work += [(child, depth) for child in ast.iter_child_nodes(n)]
    operators = Counter(type(n).__name__ for n in inner if isinstance(n, (ast.operator, ast.unaryop, ast.cmpop, ast.boolop, ast.Call, ast.Assign, ast.Return, *_FLOW)))
    operands = Counter(ast.unparse(n) for n in inner if isinstance(n, (ast.Name, ast.Constant)))
    arguments = node.args
    return {
        "cyclomatic": 1 + sum(isinstance(n, _BRANCH) for n in inner) + bools + cases, "cognitive": cognitive + bools, "nesting": deepest,
        "parameters": len(arguments.posonlyargs) + len(arguments.args) + len(arguments.kwonlyargs) + bool(arguments.vararg) + bool(arguments.kwarg),
        "returns": sum(isinstance(n, ast.Return) for n in inner), "loc": node.end_lineno - node.lineno + 1,
        "n1": len(operators), "n2": len(operands), "total1": sum(operators.values()), "total2": sum(operands.values()),
    }


def complexity(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Measures of every function in Python files; combine with ``rank.halstead`` and ``rank.maintainability``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in COMPLEXITY.split(", ")]
        for batch in batches:
            rows = []
            for file, body in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = ast.walk(ast.parse(body or ""))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += [
                    {"file": file, "name": n.name, "start_line": n.lineno, **complexity_of(n)} for n in found if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))
                ]
            yield pd.DataFrame(rows, columns=names)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(parse, COMPLEXITY)


def lines_of_code(text: Column) -> Column:
    """Lines that are neither blank nor comments."""
    return F.size(F.filter(lines(text), lambda x: ~x.rlike(r"^\s*(?:$|//|#|/\*|\*|--)")))


def brace_depth(text: Column) -> Column:
    """The deepest nesting of curly braces."""
    braces = F.split(F.regexp_replace(text, r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(braces, start, step, lambda a: a["most"])


def doc_tags(doc: Column) -> Column:
    """(tag, name, text) of ``@param x text`` and ``:param x: text`` entries in a doc comment."""
    whole = r"(?m)^\s*[*]?\s*[@:](param|returns?|throws|raises|example|deprecated)\b[ \t]*(?:\{[^}]*\}[ \t]*)?(?:(\w+)[ \t]*)?:?[ \t-]*([^\n]*)"
    groups = [F.regexp_extract_all(doc, F.lit(whole), F.lit(k)) for k in (1, 2, 3)]
    return F.transform(
        F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("a", "b", "c"), strict=True)]),
        lambda z: F.struct(z["a"].alias("tag"), F.nullif(z["b"], F.lit("")).alias("name"), z["c"].alias("text")),
    )


def unreachable(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, terminator_line, snippet): the first code after a line that ends control flow, by a fold over lines."""
    ends = r"^(?:return|throw|raise|break|continue|exit|die\(|panic!|unreachable!)"
    skip = r"^(?:$|//|#|/\*|\*)|^[})\]]$"
    again = r"^(?:case |default:|else|catch|except|rescue|finally)"
    own = F.transform(lines(F.coalesce(content, F.lit(""))), lambda x: F.trim(x))
    hits = F.array().cast("array<struct<line:int,terminator_line:int,snippet:string>>")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("after"), hits.alias("out"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        found = (a["after"] > 0) & ~x.rlike(ends) & ~x.rlike(skip) & ~x.rlike(again)
        after = F.when(x.rlike(ends), n).when((a["after"] > 0) & x.rlike(skip), a["after"]).otherwise(0)
        hit = F.struct(n.alias("line"), a["after"].alias("terminator_line"), x.alias("snippet"))
        return F.struct(n.alias("n"), after.alias("after"), F.when(found, F.array_append(a["out"], hit)).otherwise(a["out"]).alias("out"))

    rows = files.select(path, F.explode(F.aggregate(own, start, step, lambda a: a["out"])).alias("u"))
    return rows.select(path, "u.line", "u.terminator_line", "u.snippet")


# Words and signs that branch, by language family.
_BRANCHES = {
    "python": r"\b(?:if|elif|for|while|except|case|and|or)\b", "ruby": r"\b(?:if|elsif|unless|for|while|until|when|rescue|and|or)\b|&&|\|\|",
}
_BRACED_BRANCHES = r"\b(?:if|for|while|case|catch|match|loop|guard|select)\b|&&|\|\||\?(?=[^.?:])"


def branch_count(content: Column, language: Column) -> Column:
    """1 and the branches of a piece of code, by words and signs outside of strings and comments; null for unknown languages."""
    bare = F.regexp_replace(content, r"(?s)/\*.*?\*/|//[^\n]*|\"(?:\\\\.|[^\"\\\\\n])*\"|'(?:\\\\.|[^'\\\\\n])*'", " ")
    hashed = F.regexp_replace(bare, r"#[^\n]*", " ")
    lower = F.lower(language)
    out = F.when(lower.isin(list(PATTERNS)), F.regexp_count(bare, F.lit(_BRACED_BRANCHES)) + 1)
    for name, pattern in _BRANCHES.items():
        out = F.when(lower == name, F.regexp_count(hashed, F.lit(pattern)) + 1).otherwise(out)
    return out


def type_signatures(symbols: DataFrame) -> DataFrame:
    """(file, name, start_line, parameter, type, ord): the parameters and, as ``return``, the result of functions and methods.

    Types are what follows the colon (or, where a language puts them first, what
    stands before the name); null where none is given.
    """
    from sievework.operators.rank import parameters, return_type

    rows = symbols.filter(F.col("kind").isin("function", "method") & F.col("signature").isNotNull())
    own = rows.select("file", "name", "start_line", F.posexplode(parameters(F.col("signature"))).alias("ord", "p"))
    bare = F.trim(F.regexp_replace("p", r"(?s)\s*=(?![=>]).*$", ""))
    colon = F.regexp_extract(bare, r"(?s)^[^:]*:\s*(.*)$", 1)
    before = F.regexp_extract(bare, r"(?s)^(.*\S)\s+[*&]*\w+$", 1)
    kind = F.nullif(F.when(F.contains(bare, F.lit(":")), colon).otherwise(before), F.lit(""))
    name = F.when(F.contains(bare, F.lit(":")), F.trim(F.substring_index(bare, ":", 1))).otherwise(F.regexp_extract(bare, r"([*&]*\w+)$", 1))
    given = own.select("file", "name", "start_line", name.alias("parameter"), kind.alias("type"), "ord")
    result = rows.select("file", "name", "start_line", F.lit("return").alias("parameter"), return_type(F.concat("signature", F.lit(":"))).alias("type"), F.lit(-1).alias("ord"))
    return given.unionByName(result)
