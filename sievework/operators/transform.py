"""Text transformations that need a scanner: pandas UDFs over Arrow batches."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.tables import MODELS, SPECIAL_CHARACTERS
from sievework.functions.text import lines

# Comment marks (line, block start, block end) by language.
COMMENTS = {
    **dict.fromkeys("python ruby shell bash sh yaml yml".split(), ("#", "", "")),
    **dict.fromkeys("javascript typescript java c cpp c++ rust go swift kotlin scala".split(), ("//", "/*", "*/")),
    **dict.fromkeys("html xml".split(), ("", "<!--", "-->")),
    **dict.fromkeys("css scss sass".split(), ("", "/*", "*/")),
    "sql": ("--", "/*", "*/"),
    "lua": ("--", "--[[", "]]"),
}
# How declaration lines start, by language.
SIGNATURES = {
    "python": ("def ", "class ", "async def "),
    **dict.fromkeys("javascript typescript jsx tsx".split(), ("function ", "class ", "const ", "let ", "export ", "async ")),
    "rust": ("fn ", "pub fn ", "struct ", "enum ", "trait ", "impl ", "type ", "const "),
    "go": ("func ", "type ", "const ", "var "),
    **dict.fromkeys("java kotlin".split(), ("public ", "private ", "protected ", "class ", "interface ", "enum ")),
    **dict.fromkeys("c cpp c++".split(), ("void ", "int ", "char ", "bool ", "class ", "struct ", "enum ")),
}
_OTHER_SIGNATURES = ("def ", "fn ", "func ", "function ", "class ", "struct ")
_QUOTED = re.compile(r"""\\.|["']""", re.S)


def _in_string(before: str) -> bool:
    quote = None
    for m in _QUOTED.finditer(before):
        if m[0] == quote:
            quote = None
        elif quote is None and m[0] in "\"'":
            quote = m[0]
    return quote is not None


def remove_comments(text: str, language: str) -> str:
    """``text`` without comments; a marker inside a string is no comment. Each kept line ends with a line end."""
    mark, start, stop = COMMENTS.get((language or "").lower(), ("//", "/*", "*/"))
    out, inside = [], False
    for line in text.splitlines():
        if inside:
            _, found, rest = line.partition(stop)
            if found:
                inside = False
                if rest.strip():
                    out.append(rest)
            continue
        if start and start in line:
            before, _, rest = line.partition(start)
            _, found, after = rest.partition(stop)
            inside = not found
            kept = before + after if found else before.rstrip()
            if kept.strip():
                out.append(kept)
            continue
        if mark and line.strip().startswith(mark):
            continue
        at = line.find(mark) if mark else -1
        while at >= 0 and _in_string(line[:at]):
            at = line.find(mark, at + len(mark))
        if at >= 0:
            line = line[:at].rstrip()
            if not line:
                continue
        out.append(line)
    return "".join(f"{x}\n" for x in out)


def signatures(text: str, language: str) -> str:
    """Lines that start like declarations; none: the first 50 lines."""
    starts = SIGNATURES.get((language or "").lower(), _OTHER_SIGNATURES)
    own = text.splitlines()
    found = [x for x in own if x.strip().startswith(starts)]
    return "".join(f"{x}\n" for x in found) if found else "\n".join(own[:50])


def _of_two(function: Callable[[str, str], str]) -> object:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in batches:
            yield pd.Series([None if t is None else function(t, lang) for t, lang in zip(texts, languages, strict=True)])

    return run


def remove_comments_udf() -> object:
    return _of_two(remove_comments)


def signatures_udf() -> object:
    return _of_two(signatures)


_SPECIAL = np.zeros(256, bool)
_SPECIAL[[ord(c) for c in SPECIAL_CHARACTERS]] = True


def prefix_tokens(text: bytes, model: str) -> np.ndarray:
    """The token estimate of each prefix of a UTF-8 text, from one byte on, in single precision."""
    _, per_token, _, _, counts_special, _ = next(m for m in MODELS if m[0] == model)
    data = np.frombuffer(text, np.uint8)
    f32 = np.float32
    value = np.arange(1, len(data) + 1, dtype=f32) / f32(per_token)
    value = value - np.cumsum((data == 32) | (data == 9)).astype(f32) * f32(0.3)
    value = value + np.cumsum(data == 10).astype(f32) * f32(0.5)
    if counts_special:
        value = value + np.cumsum(_SPECIAL[data]).astype(f32) * f32(0.3)
    return np.maximum(np.ceil(value), 1).astype(np.int64)


def truncate(text: str, budget: int, model: str = "claude") -> str:
    """The longest prefix of at most ``budget`` tokens, cut back to its last blank or line end if there is one."""
    raw = text.encode()
    if not raw:
        return text
    counts = prefix_tokens(raw, model)
    if counts[-1] <= budget:
        return text
    end = int(np.searchsorted(np.maximum.accumulate(counts), budget, "right"))
    while end and (raw[end] & 0xC0) == 0x80:  # not inside a character
        end -= 1
    cut = max(raw.rfind(b" ", 0, end), raw.rfind(b"\n", 0, end))
    return raw[: cut if cut > 0 else end].decode()


def truncate_udf(budget: int, model: str = "claude") -> object:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t if t is None else truncate(t, budget, model))

    return run


#: Where a text is cut: at the last byte that fits, the last line end before it, or the last start of a declaration.
STRATEGIES = ("hard", "line", "semantic")
TRUNCATED = "\n\n... [truncated]"
# What starts a declaration after an empty line.
_DECLARATIONS = ["fn ", "def ", "class ", "function ", "pub fn ", "async ", "impl ", "#[", "@"]
_DECLARATION = re.compile("\n\n(?=" + "|".join(map(re.escape, _DECLARATIONS)) + ")")
# Ends of a piece of output, and the note after a cut.
_OUTPUT_ENDS = ["</file>", "```\n\n", "----------------------------------------\n", "\n---\n"]
_OUTPUT_NOTE = "\n\n<!-- Output truncated to fit token limit -->\n"


def longest_prefix(text: str, budget: int, model: str = "claude") -> str:
    """The longest prefix of at most ``budget`` tokens before which no prefix has more, at a character's end."""
    raw = text.encode()
    if not raw:
        return text
    counts = np.maximum.accumulate(prefix_tokens(raw, model))
    end = int(np.searchsorted(counts, budget, "right"))
    while end < len(raw) and end and (raw[end] & 0xC0) == 0x80:
        end -= 1
    return raw[:end].decode()


def truncate_content(text: str, budget: int, model: str = "claude", strategy: str = "line") -> str:
    """A text within ``budget`` tokens, cut by a strategy, with a note; one that fits stays as it is."""
    if not text or prefix_tokens(text.encode(), model)[-1] <= budget:
        return text
    head = longest_prefix(text, budget, model)
    cut = len(head)
    if strategy != "hard" and "\n" in head:
        cut = head.rindex("\n") + 1
    if strategy == "semantic" and (starts := [m.end() for m in _DECLARATION.finditer(head)]):
        cut = starts[-1]
    return head[:cut] + TRUNCATED


def truncate_content_udf(model: str = "claude", strategy: str = "line") -> object:
    """A pandas UDF of text and budget."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, budgets in batches:
            yield pd.Series([None if t is None else truncate_content(t, int(b), model, strategy) for t, b in zip(texts, budgets, strict=True)])

    return run


def truncate_output(text: str, budget: int, model: str = "claude") -> str:
    """A whole output within ``budget`` tokens: cut as ``truncate`` does, then back to the end of a piece if that is in the second half."""
    if not text or prefix_tokens(text.encode(), model)[-1] <= budget:
        return text
    head = truncate(text, budget, model)
    size = len(head.encode())
    for mark in _OUTPUT_ENDS:
        at = head.rfind(mark)
        if at >= 0 and len(head[: at + len(mark)].encode()) > size // 2:
            head = head[: at + len(mark)]
            break
    return head + _OUTPUT_NOTE


def truncate_output_udf(budget: int, model: str = "claude") -> object:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t if t is None else truncate_output(t, budget, model))

    return run


KEY_KINDS = ["function", "class", "struct", "trait", "enum", "interface"]
MOST_KEY_SYMBOLS, MOST_OTHER_SYMBOLS = 30, 20


def key_symbols(files: DataFrame, symbols: DataFrame, around: int = 0) -> DataFrame:
    """(path, text): the signatures of each file's first 30 key symbols that aren't private, else of its first 20 that are no imports.

    A symbol without a signature gives its first line; with ``around``, each
    gives so many lines before and after its first line instead. Files without
    symbols give what looks like signatures.
    """
    order = F.struct("start_line", "name")
    own = symbols.filter("kind != 'import'").withColumn("key", F.col("kind").isin(KEY_KINDS) & (F.col("visibility") != "private"))
    entry = F.struct(order.alias("order"), "key", "kind", "name", "signature", "start_line")
    grouped = own.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    keys = F.filter("all", lambda s: s["key"])
    chosen = F.when(F.size(keys) > 0, F.slice(keys, 1, MOST_KEY_SYMBOLS)).otherwise(F.slice("all", 1, MOST_OTHER_SYMBOLS))
    rows = files.select("path", "language", "content").join(grouped.select("path", chosen.alias("chosen")), "path", "left")
    lined = rows.withColumn("rows", lines(F.coalesce("content", F.lit(""))))

    def shown(s: Column) -> Column:
        first = F.greatest(s["start_line"] - around, F.lit(1))
        near = F.array_join(F.slice(F.col("rows"), first, s["start_line"] + around - first + 1), "\n")
        line = F.get(F.col("rows"), s["start_line"] - 1)
        body = near if around else F.coalesce(s["signature"], line)
        return F.concat(F.lit("// "), s["kind"], F.lit(": "), s["name"], F.lit("\n"), F.coalesce(F.concat(body, F.lit("\n")), F.lit("")))

    found = lined.select("path", "language", "content", F.array_join(F.transform("chosen", shown), "").alias("text"))
    guessed = signatures_udf()(F.when(F.coalesce("text", F.lit("")) == "", F.col("content")), F.col("language"))
    return found.select("path", F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(guessed).alias("text"))


DIMENSIONS = 384


def character_vector(text: str) -> np.ndarray:
    """Character counts weighted by 1 / position, in 384 buckets, of unit length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % DIMENSIONS
    out = np.zeros(DIMENSIONS, np.float64)
    np.add.at(out, codes, 1.0 / np.arange(1, len(codes) + 1))
    norm = math.sqrt(float(out @ out))
    return (out / norm if norm else out).astype(np.float32)


def character_vector_udf() -> object:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else character_vector(t))

    return run


def _folded_period(text: str, ratio: float) -> str | None:
    """A text that is, for four fifths, one pattern of up to 100 bytes over and over: the pattern some times, and the count."""
    data = np.frombuffer(text.encode(), np.uint8)
    for n in range(1, min(100, len(data) // 3) + 1):
        if (data[n] & 0xC0) == 0x80:
            continue
        pattern = data[:n].tobytes().decode()
        if not pattern.strip():
            continue
        other = np.flatnonzero(data[n:] != data[:-n])  # where the text stops to be as it was a pattern before
        count = (int(other[0]) if len(other) else len(data) - n) // n + 1
        if count >= 3 and np.float32(count * n) / np.float32(len(data)) >= np.float32(0.8):
            shown = min(5, max(1, math.ceil(np.float32(count) * np.float32(ratio))))
            rest = data[count * n :].tobytes().decode()
            note = f"{(pattern * shown).rstrip()}\n/* ... pattern repeated {count} times (showing {shown}) ... */"
            return f"{note}\n{rest.strip()}" if rest else note
    return None


def _folded_lines(text: str) -> str | None:
    """A text half of whose lines are the same: each run of that line once, with its length; only if that halves the text."""
    own = text.split("\n")
    own = [x.removesuffix("\r") for x in (own[:-1] if own[-1] == "" else own)]
    counts = Counter(x for x in own if x.strip())
    if len(own) < 3 or not counts:
        return None
    line, most = counts.most_common(1)[0]  # of equally frequent lines the first
    if most < 3 or most / len(own) < 0.5:
        return None
    out: list[str] = []
    for repeated, run in itertools.groupby(own, key=lambda x: x == line):
        rows = list(run)
        if not repeated:
            out += rows
            continue
        out.append(line)
        if len(rows) > 1:
            out.append(f"/* ... above line repeated {len(rows)} times ... */")
    folded = "\n".join(out)
    return folded if 2 * len(folded.encode()) < len(text.encode()) else None


def compress_repeats(text: str, ratio: float = 0.5) -> str | None:
    """A repetitive text of 200 bytes or more in short, by its period or by its lines; else null."""
    if len(text.encode()) < 200:
        return None
    short = _folded_period(text, ratio)
    return _folded_lines(text) if short is None else short


def semantic_compress(text: str, ratio: float = 0.5, threshold: float = 0.7) -> str:
    """Repetitions folded; else paragraphs clustered by character vectors, the longest of each cluster kept in first-seen order;
    if all are alike, every n-th paragraph of the wanted share."""
    if (short := compress_repeats(text, ratio)) is not None:
        return short
    pieces = [p for p in re.split(r"\n\s*\n", text) if p.strip()]
    if len(pieces) < 2:
        if ratio >= 1 or len(text) < 10:
            return text
        cut = max(text.rfind(" ", 0, int(len(text) * ratio)), text.rfind("\n", 0, int(len(text) * ratio)))
        cut = cut if cut > 0 else int(len(text) * ratio)
        return f"{text[:cut].rstrip()}\n/* ... truncated to {ratio * 100:.0f}% ({cut} of {len(text)} chars) ... */"
    clusters: list[tuple[np.ndarray, list[str]]] = []
    for p in pieces:
        v = character_vector(p)
        own = next((c for first, c in clusters if float(first @ v) >= threshold), None)
        if own is None:
            clusters.append((v, [p]))
        else:
            own.append(p)
    if len(clusters) > 1:
        return "\n\n".join(max(c, key=len) for _, c in clusters)
    wanted = math.ceil(len(pieces) * ratio)
    step = max(1, len(pieces) // max(1, wanted))
    kept = pieces[::step][:wanted]
    if len(kept) == len(pieces):
        return "\n\n".join(kept)
    share = len(kept) / len(pieces) * 100
    return "\n\n".join(kept) + f"\n\n/* ... {len(pieces) - len(kept)} chunks compressed ({share:.0f}% of original) ... */"


def semantic_compress_udf(ratio: float = 0.5, threshold: float = 0.7) -> object:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t if t is None else semantic_compress(t, ratio, threshold))

    return run
