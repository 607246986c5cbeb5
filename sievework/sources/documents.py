"""Documents of several formats as rows of blocks.

Every parser is a function from text (or bytes) to blocks with their section;
``parse_documents`` runs them as an Arrow-batched map, one document at a time,
so memory is bounded by a document. Sections are flat rows with a breadcrumb.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = (
    "path string, section_ord int, level int, title string, number string, breadcrumb string, "
    "block_ord int, block_type string, text string, payload string"
)
#: Larger documents, and archives that unpack to more, are refused.
MAX_BYTES = 100 << 20

FORMATS = {
    "md": "markdown", "markdown": "markdown", "txt": "plain", "text": "plain", "log": "plain", "html": "html", "htm": "html",
    "csv": "csv", "tsv": "csv", "docx": "docx", "xlsx": "xlsx",
}


@dataclass
class Builder:
    """Collects sections and their blocks in reading order."""

    rows: list[dict] = field(default_factory=list)
    section: int = 0
    level: int = 0
    title: str | None = None
    number: str | None = None
    trail: list[tuple[int, str]] = field(default_factory=list)
    used: bool = True
    count: int = 0

    def heading(self, level: int, title: str, number: str | None = None) -> None:
        self.close()
        self.trail = [t for t in self.trail if t[0] < level] + [(level, title)]
        self.section, self.level, self.title, self.number = self.section + 1, level, title, number
        self.used, self.count = False, 0

    def add(self, kind: str, text: str | None, payload: object = None) -> None:
        self.rows.append(
            {
                "section_ord": self.section, "level": self.level, "title": self.title, "number": self.number,
                "breadcrumb": " > ".join(t for _, t in self.trail), "block_ord": self.count, "block_type": kind, "text": text,
                "payload": None if payload is None else json.dumps(payload, ensure_ascii=False),
            }
        )
        self.used = True
        self.count += 1

    def close(self) -> list[dict]:
        if not self.used:  # a heading without content is a section too
            self.add("empty", None)
        return self.rows


def guard_cell(cell: str) -> str:
    """A quote before a cell that a spreadsheet would run."""
    cell = cell.strip()
    return "'" + cell if cell[:1] in ("=", "+", "-", "@", "|", "\t") else cell


def table_text(rows: list[list[str]]) -> str:
    return "\n".join(" | ".join(r) for r in rows)


_BULLET = re.compile(r"(?:[-*•] |[0-9]+[.)] |[a-z]\) )(.*)", re.S)
_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})")


def parse_markdown(text: str) -> list[dict]:
    """Headings, fenced code, quotes, tables, lists, rules and paragraphs; front matter is left out."""
    lines = text.splitlines()
    if lines and lines[0].strip() == "---":
        end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() in ("---", "...")), None)
        lines = lines if end is None else lines[end + 1 :]
    out, paragraph, quote, items, table = Builder(), [], [], [], []
    ordered, fence, code, language = False, "", [], None

    def flush() -> None:
        nonlocal ordered
        if paragraph:
            joined = " ".join(paragraph)
            kind = "definition" if re.fullmatch(r"\*\*[^*]+\*\*\s*[:–-]\s+.+", joined) else "paragraph"
            out.add(kind, joined)
        if quote:
            out.add("blockquote", "\n".join(quote).strip())
        if items:
            out.add("list", "\n".join(items), {"ordered": ordered, "items": list(items)})
        if table:
            out.add("table", table_text(table), {"headers": table[0], "rows": table[1:]})
        for held in (paragraph, quote, items, table):
            held.clear()

    for line in lines:
        bare = line.strip()
        if fence:
            if line.startswith(fence):
                out.add("code", "\n".join(code).rstrip(), {"language": language})
                fence, code = "", []
            else:
                code.append(line)
            continue
        if line.startswith(("```", "~~~")):
            flush()
            fence, language = line[:3], line.lstrip(line[0]).strip() or None
            continue
        if line.startswith("> ") or line == ">":
            if not quote:
                flush()
            quote.append(line[2:])
            continue
        if bare and (bare.startswith("|") or bare.endswith("|")):
            if not table:
                flush()
            cells = bare.strip("|").split("|")
            if not all(set(c.strip()) <= set("-: ") for c in cells):
                table.append([guard_cell(c) for c in cells])
            continue
        if quote or table:
            flush()
        if not bare:
            flush()
        elif heading := _ATX.fullmatch(line):
            flush()
            out.heading(len(heading[1]), (heading[2] or "").strip())
        elif _RULE.fullmatch(bare):
            flush()
            out.add("break", None)
        elif bullet := _BULLET.fullmatch(bare):
            if paragraph:
                flush()
            if not items:
                ordered = bare[0].isdigit()
            items.append(bullet[1])
        elif items and line[:1] in (" ", "\t"):
            items[-1] += " " + bare
        else:
            if items:
                flush()
            paragraph.append(bare)
    if fence:
        out.add("code", "\n".join(code).rstrip(), {"language": language})
    flush()
    return out.close()


def _capitals(line: str) -> bool:
    letters = [c for c in line if c.isalpha()]
    return 3 <= len(line.encode()) <= 120 and len(letters) >= 2 and all(c.isupper() for c in letters)


def parse_plain(text: str) -> list[dict]:
    """Underlined, capital and numbered headings, bullet lists, paragraphs joined by spaces."""
    lines, out, paragraph = text.splitlines(), Builder(), []

    def flush() -> None:
        if paragraph:
            out.add("paragraph", " ".join(paragraph))
            paragraph.clear()

    i = 0
    while i < len(lines):
        line, bare = lines[i], lines[i].strip()
        after = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if not bare:
            flush()
        elif re.fullmatch(r"={3,}|-{3,}", after):
            flush()
            out.heading(1 if after[0] == "=" else 2, bare)
            i += 1
        elif not after and _capitals(bare):
            flush()
            out.heading(1, bare)
        elif not after and (m := re.fullmatch(r"([0-9][0-9.]*) (.*[^\W\d_].*)", bare)) and len(m[2].encode()) <= 120:
            flush()
            out.heading(min(m[1].count(".") + 1, 6), m[2].strip(), m[1].rstrip("."))
        elif _BULLET.fullmatch(bare):
            flush()
            items, ordered = [], bare[0].isdigit()
            while i < len(lines) and lines[i].strip():
                if m := _BULLET.fullmatch(lines[i].strip()):
                    items.append(m[1])
                elif lines[i][:2] == "  " or lines[i][0] == "\t":
                    items[-1] += " " + lines[i].strip()
                else:
                    break
                i += 1
            out.add("list", "\n".join(items), {"ordered": ordered, "items": items})
            continue
        else:
            paragraph.append(bare)
        i += 1
    flush()
    return out.close()


_DROP = re.compile(r"(?is)<(script|style|nav|footer|noscript|svg|iframe)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<!doctype[^>]*>")
_PIECE = re.compile(
    r"(?is)<(h[1-6]|p|blockquote|pre)\b[^>]*>(.*?)(?:</\1\s*>|(?=<(?:p|h[1-6]|ul|ol|table|pre|blockquote|div)\b)|\Z)"
    r"|<(ul|ol|table)\b[^>]*>(.*?)(?:</\3\s*>|\Z)|<(hr)\b[^>]*>"
)
_TAG = re.compile(r"(?s)<[^>]*>")


def plain_of(html: str) -> str:
    """Text of a fragment: breaks as blanks, tags gone, references decoded, single blanks."""
    return " ".join(unescape(_TAG.sub("", re.sub(r"(?i)<br\b[^>]*>", " ", html))).split())


def html_metadata(html: str) -> dict[str, str]:
    """Title and named meta tags."""
    found = {}
    if m := re.search(r"(?is)<title[^>]*>(.*?)</title>", html):
        found["title"] = plain_of(m[1])
    for tag in re.findall(r"(?is)<meta\b[^>]*>", html):
        attributes = {k.lower(): a or b for k, a, b in re.findall(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""", tag)}
        name = attributes.get("name") or attributes.get("property")
        if name and "content" in attributes:
            found[name.lower()] = unescape(attributes["content"])
    return found


def parse_html(html: str) -> list[dict]:
    """Sections by headings; paragraphs, lists, tables, code, quotes and rules. Scripts, styles, navigation and footers go."""
    body = _DROP.sub(" ", html)
    start = re.search(r"(?is)<body\b[^>]*>", body)
    body = re.sub(r"(?is)<head\b.*?</head\s*>", " ", body) if not start else body[start.end() :]
    out = Builder()
    for m in _PIECE.finditer(body):
        tag = (m[1] or m[3] or m[5]).lower()
        inner = m[2] or m[4] or ""
        if tag[0] == "h" and tag != "hr":
            if title := plain_of(inner):
                out.heading(int(tag[1]), title)
        elif tag == "hr":
            out.add("break", None)
        elif tag == "pre":
            out.add("code", unescape(_TAG.sub("", inner)).strip("\n"), {"language": None})
        elif tag in ("ul", "ol"):
            items = [t for t in (plain_of(x) for x in re.findall(r"(?is)<li\b[^>]*>(.*?)(?=</li\s*>|<li\b|\Z)", inner)) if t]
            if items:
                out.add("list", "\n".join(items), {"ordered": tag == "ol", "items": items})
        elif tag == "table":
            rows = [[plain_of(c) for c in re.findall(r"(?is)<t[hd]\b[^>]*>(.*?)(?=</t[hd]\s*>|<t[hd]\b|\Z)", r)] for r in re.findall(r"(?is)<tr\b[^>]*>(.*?)(?=</tr\s*>|<tr\b|\Z)", inner)]
            if rows := [r for r in rows if r]:
                out.add("table", table_text(rows), {"headers": rows[0], "rows": rows[1:]})
        elif text := plain_of(inner):
            out.add("blockquote" if tag == "blockquote" else "paragraph", text)
    return out.close()


def csv_delimiter(lines: list[str]) -> str:
    """The delimiter that most lines have most often: comma, tab, semicolon, pipe on ties."""
    votes = dict.fromkeys(",\t;|", 0)
    for line in lines[:10]:
        counts = {d: line.count(d) for d in votes}
        best = max(counts, key=lambda d: counts[d])
        if counts[best]:
            votes[best] += 1
    return max(votes, key=lambda d: votes[d]) if any(votes.values()) else ","


def parse_csv(text: str) -> list[dict]:
    """One table: the first line that is no comment is the header, rows are padded or cut to its width."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    out = Builder()
    if lines:
        rows = list(csv.reader(lines, delimiter=csv_delimiter(lines)))
        width = len(rows[0])
        rows = [[guard_cell(c) for c in (r + [""] * width)[:width]] for r in rows]
        out.add("table", table_text(rows), {"headers": rows[0], "rows": rows[1:]})
    return out.close()


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _member(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    """An XML part; refused if it unpacks to too much or declares entities."""
    if name not in archive.namelist():
        return None
    if archive.getinfo(name).file_size > MAX_BYTES:
        raise ValueError(f"{name} is too large")
    raw = archive.read(name)
    if b"<!ENTITY" in raw:
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(raw)


def parse_docx(data: bytes) -> list[dict]:
    """Headings by style, paragraphs and tables of a Word document."""
    out = Builder()
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = _member(archive, "word/document.xml")
        body = root.find(f"{_W}body") if root is not None else None
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
        for node in body if body is not None else []:
            if node.tag == f"{_W}tbl":
                rows = [[guard_cell(text(c)) for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
                if rows:
                    out.add("table", table_text(rows), {"headers": rows[0], "rows": rows[1:]})
            elif node.tag == f"{_W}p" and text(node).strip():
                style = node.find(f"{_W}pPr/{_W}pStyle")
                name = style.get(f"{_W}val", "") if style is not None else ""
                if m := re.fullmatch(r"(?i)heading\s*([1-6])", name):
                    out.heading(int(m[1]), text(node).strip())
                elif name.lower() == "title":
                    out.heading(1, text(node).strip())
                else:
                    out.add("list" if "list" in name.lower() else "paragraph", text(node).strip())
    return out.close()


def parse_xlsx(data: bytes) -> list[dict]:
    """One section and table per sheet of a workbook."""
    out = Builder()
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        shared = _member(archive, "xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in shared] if shared is not None else []
        book = _member(archive, "xl/workbook.xml")
        names = [s.get("name", "") for s in book.iter(f"{_S}sheet")] if book is not None else []
        for k, name in enumerate(names, 1):
            sheet = _member(archive, f"xl/worksheets/sheet{k}.xml")
            if sheet is None:
                continue
            out.heading(1, name)
            rows = []
            for row in sheet.iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    value = c.find(f"{_S}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    own = strings[int(value.text)] if c.get("t") == "s" and value is not None else value.text if value is not None else inline
                    cells.append(guard_cell(own or ""))
                rows.append(cells)
            if rows:
                out.add("table", table_text(rows), {"headers": rows[0], "rows": rows[1:]})
    return out.close()


PARSERS: dict[str, Callable] = {
    "markdown": parse_markdown, "plain": parse_plain, "html": parse_html, "csv": parse_csv, "docx": parse_docx, "xlsx": parse_xlsx,
}


def parse_documents(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Blocks of files (path, content as string or binary) by extension; unknown ones are plain text.

    A file that can't be read or is too large gives one block of type ``error``.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in BLOCKS.split(", ")]
        for batch in batches:
            rows = []
            for name, body in zip(batch["path"], batch["content"], strict=True):
                form = FORMATS.get((name or "").rpartition(".")[2].lower(), "plain")
                try:
                    body = b"" if body is None else bytes(body)
                    if len(body) > MAX_BYTES:
                        raise ValueError("too large")
                    own = PARSERS[form](body if form in ("docx", "xlsx") else body.decode("utf-8", "replace"))
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    own = Builder()
                    own.add("error", str(e))
                    own = own.rows
                rows += [{"path": name, **r} for r in own]
            yield pd.DataFrame(rows, columns=names)

    return files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInPandas(parse, BLOCKS)


def document_titles(blocks: DataFrame) -> DataFrame:
    """(path, title): the first heading."""
    return blocks.filter("title IS NOT NULL").groupBy("path").agg(F.min_by("title", "section_ord").alias("title"))


def document_counts(blocks: DataFrame, model: str = "claude") -> DataFrame:
    """(path, sections, blocks, tokens) of parsed documents."""
    from sievework.functions.tokens import estimate

    tokens = F.sum(estimate(F.coalesce("text", F.lit("")), model)).alias("tokens")
    return blocks.groupBy("path").agg(F.count_distinct("section_ord").alias("sections"), F.count("*").alias("blocks"), tokens)
