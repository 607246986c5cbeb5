"""Column functions on text. All stay inside the JVM unless their name says ``_udf``."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.tables import NAMED_EXTENSIONS


def lines(text: Column) -> Column:
    """The lines of a text without line ends; a final line end adds none; empty text: no lines."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def trim(text: Column) -> Column:
    """``text`` without white space at both ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def contains_any(text: Column, pieces: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in pieces], F.lit(False))


def starts_with_any(text: Column, pieces: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in pieces], F.lit(False))


def count_contained(text: Column, pieces: list[str]) -> Column:
    """How many of the pieces occur in the text."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(p)).cast("int") for p in pieces], F.lit(0))


def remove_empty_lines(text: Column, numbered: bool = False) -> Column:
    """Lines with something on them; ``numbered`` puts ``N:`` before each. Lines that carry numbers already keep or lose them."""
    own = lines(text)
    carried = F.regexp_extract(F.coalesce(F.get(own, 0), F.lit("")), r"^(\+?[0-9]{1,10}):", 1) != ""
    rest = lambda line: F.regexp_replace(line, r"^[^:]*:", "")
    blank = lambda line: trim(line) == ""
    some = F.filter(own, lambda x: ~blank(F.when(x.contains(":"), rest(x)).otherwise(x)))
    with_numbers = some if numbered else F.transform(some, lambda x: F.when(x.contains(":"), rest(x)).otherwise(x))
    plain = F.filter(own, lambda x: ~blank(x))
    if numbered:
        indexed = F.transform(own, lambda x, i: F.when(~blank(x), F.concat((i + 1).cast("string"), F.lit(":"), x)))
        plain = F.filter(indexed, lambda x: x.isNotNull())
    return F.array_join(F.when(carried, with_numbers).otherwise(plain), "\n")


def truncate_data_uris(text: Column) -> Column:
    """Base64 data URIs keep their type, their payload becomes a marker."""
    return F.regexp_replace(text, r"(data:[^;]+;base64,)[A-Za-z0-9+/]*={0,2}", "$1[BASE64_TRUNCATED]")


def truncate_base64(text: Column) -> Column:
    """Data URIs, and runs of 200 or more base64 characters with + or /, which keep 50."""
    run = r"(?<![A-Za-z0-9+/,])(?=[A-Za-z0-9]*[+/])([A-Za-z0-9+/]{50})[A-Za-z0-9+/]{150,}={0,2}"
    return F.regexp_replace(truncate_data_uris(text), run, "$1...[BASE64_TRUNCATED]")


def normalize_lines(text: Column) -> Column:
    """Line ends as LF, no white space at line ends, no blank lines at both ends. NFC is ``nfc_udf``."""
    body = F.regexp_replace(text, r"\r\n?", "\n")
    body = F.regexp_replace(body, r"[ \t\f\x0b ]+(?=\n|\z)", "")
    return F.regexp_replace(body, r"\A\n+|\n+\z", "")


def nfc_udf() -> object:
    """A pandas UDF to Unicode normal form C; ASCII texts pass through."""

    @F.pandas_udf("string")
    def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return nfc


def normalize_for_dedup(text: Column) -> Column:
    """Lower case, letters, digits and single spaces only."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def mask(secret: Column) -> Column:
    """Stars, but for up to four characters, a quarter at most, at both ends; up to 8 characters: only stars."""
    n = F.char_length(secret)
    edge = F.least(F.lit(4), F.floor(n / 4).cast("int"))
    long = F.concat(F.substr(secret, F.lit(1), edge), F.repeat(F.lit("*"), n - 2 * edge), F.right(secret, edge))
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(long)


def split_identifier(name: Column) -> Column:
    """Words of a camelCase, snake_case or ACRONYMCase name."""
    parted = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(parted, r"[^A-Za-z0-9]+"), lambda w: w != "")


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, exclamation or question mark before white space or the end; else the first line."""
    found = F.regexp_extract(text, r"(?s)\A\s*(.*?[.!?])(?=\s|\z)", 1)
    return F.when(found != "", found).otherwise(trim(F.coalesce(F.get(lines(text), 0), F.lit(""))))


def ellipsis(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three of a cut text being dots."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def escape_xml(text: Column) -> Column:
    """A text for XML content and attributes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_yaml(text: Column) -> Column:
    """The inside of a double-quoted YAML string."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_cell(text: Column) -> Column:
    """A text inside a Markdown table cell."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def code_fence(text: Column) -> Column:
    """A run of backticks longer than any in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.char_length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def sanitize_cell(text: Column) -> Column:
    """A quote before cells that a spreadsheet would run as formulas."""
    return F.when(text.rlike(r"^[=+\-@|\t]"), F.concat(F.lit("'"), text)).otherwise(text)


def normalize_path(path: Column) -> Column:
    """A path without ``.``, empty and ``..`` parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)),
    )
    return F.array_join(kept, "/")


def glob_regex(pattern: str) -> str:
    """A regular expression for a path glob: ``**`` spans directories, so do ``*`` and ``?`` as in shell-less globs."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
            continue
        if c == "*":
            while k + 1 < len(pattern) and pattern[k + 1] == "*":
                k += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            body = pattern[k + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            k = end
        else:
            out.append("\\" + c if c in r".+^$(){}|\[]" else c)
        k += 1
    return "^" + "".join(out) + "$"


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two number arrays; 0 if lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def content_hash(text: Column) -> Column:
    """SHA-256 of a text, lower-case hex."""
    return F.sha2(text.cast("binary"), 256)


def content_id(text: Column) -> Column:
    """``ec_`` and 32 hex digits of the content hash."""
    return F.concat(F.lit("ec_"), F.substring(content_hash(text), 1, 32))


def location_key(*parts: Column) -> Column:
    """A key of where a chunk lies; null parts are empty."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def chunk_id(key: Column, full_hash: Column) -> Column:
    """An id for a content at a place."""
    return content_id(F.concat(key, F.lit("\0"), full_hash))


def module_path(path: Column, language: Column) -> Column:
    """The module that a file is in its language: ``auth.jwt`` for Python, ``auth::jwt`` for Rust, ``auth/jwt`` for scripts, packages for Java and Go."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    bare = F.regexp_replace(p, r"^(?:src|lib)/", "")
    in_src = F.regexp_replace(p, r"^src/", "")
    rust = F.when(in_src.isin("lib.rs", "main.rs"), "").otherwise(F.replace(F.regexp_replace(in_src, r"(?:/mod)?\.rs$", ""), F.lit("/"), F.lit("::")))
    segment = r"^(?!__pycache__)[A-Za-z_][A-Za-z0-9_]*$"
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(p, "^/+", ""), r"^(?:src|lib)/", ""), "/"), lambda x: x != "")
    after_packages = F.regexp_replace(F.array_join(parts, "/"), r"^(?:.*/)?(?:site-packages|dist-packages)/", "")
    after_root = F.regexp_replace(after_packages, r"^(?:[^/]+/)*?(?:src|lib)/(?=(?:.*/)?[A-Za-z_])", "")
    own = F.split(F.regexp_replace(F.when(after_packages != F.array_join(parts, "/"), after_packages).otherwise(after_root), r"\.py$", ""), "/")
    own = F.filter(own, lambda x: x.rlike(segment))
    python = F.array_join(F.when(F.element_at(own, -1) == "__init__", F.slice(own, 1, F.size(own) - 1)).otherwise(own), ".")
    python = F.when(F.size(own) == 0, "").otherwise(python)
    script = F.when(bare.startswith("index."), "").otherwise(F.regexp_replace(bare, r"(?:/index)?\.(?:tsx?|jsx?)$", ""))
    package = F.regexp_replace(F.regexp_replace(p, r"^(?:src/main/java/|src/test/java/|src/)", ""), r"(?:^|/)[^/]*$", "")
    java = F.replace(package, F.lit("/"), F.lit("."))
    go_file = F.regexp_replace(F.regexp_replace(p, r"^(?:internal|pkg|cmd)/", ""), r"\.go$", "")
    go = F.regexp_replace(go_file, r"/[^/]*$", "")
    other = F.replace(F.regexp_replace(bare, r"\.[^./]*$", ""), F.lit("/"), F.lit("::"))
    lower = F.lower(language)
    return (
        F.when(lower == "rust", rust).when(lower == "python", python).when(lower.isin("typescript", "tsx", "javascript", "jsx"), script)
        .when(lower == "java", java).when(lower == "go", go).otherwise(other)
    )


def qualified_name(path: Column, parent: Column, name: Column, repository: Column | None = None) -> Column:
    """``repo::folder::file::Parent::name`` of a symbol."""
    bare = F.regexp_replace(path, r"\.(?:" + "|".join(NAMED_EXTENSIONS) + ")$", "")
    module = F.translate(bare, "\\/", "\u0001\u0001")
    parts = [F.nullif(repository, F.lit(""))] if repository is not None else []
    return F.concat_ws("::", *parts, F.replace(module, F.lit("\u0001"), F.lit("::")), parent, name)


def dotted_module(path: Column) -> Column:
    """A file's module in a dependency graph: without source folder and extension, by dots."""
    bare = F.regexp_replace(path, r"^(?:src/)*(?:lib/)*(?:app/)*", "")
    cut = F.regexp_replace(bare, r"\.[^.]*$", "")
    return F.regexp_replace(F.translate(cut, "/\\", ".."), r"^\.+|\.+$", "")


def repository_module(path: Column) -> Column:
    """A file's module among several repositories: without extension, ``mod``, ``index`` or ``__init__``, by double colons."""
    bare = F.regexp_replace(path, r"(?:\.rs)*(?:\.py)*(?:\.ts)*(?:\.js)*(?:\.java)*(?:\.go)*(?:\.rb)*(?:\.php)*$", "")
    module = F.regexp_replace(bare, r"(?:/mod)*(?:/index)*(?:/__init__)*$", "")
    return F.regexp_replace(F.regexp_replace(module, r"[/\\]", "::"), "^(?:::)+", "")
