"""Chat formatting with typed content parts.

A message's content is a list of parts of type text, image, audio or document;
a plain text is a list of one text part. A visitor flattens the parts, in order,
into escaped text and placeholders, records the reference of each attachment and
counts the tokens that its placeholder will stand for. The template then marks
the turn. Every conversation takes this way, and reading back parses its output:
``read_parts`` gives the parts of a turn again, ``read_back`` digests.

All control strings begin with ``<|``: the turn marks, and the placeholders
``<|image 0 ref|>``. Within texts and roles they are escaped reversibly: in
``<|``, ``<\\|``, ``<\\\\|`` and so on one more backslash is put before the bar, so
that a bare ``<|`` in the output is always the template's own. Neighbouring
texts are joined before they are escaped, as the ``<`` of one and the ``|`` of
the next would be a control string. References are percent-encoded.

Turns are flattened and formatted row by row. Reading back needs a
conversation's turns in order: rows are dealt by conversation, sorted within
partitions, and read as a stream with running digests, so a conversation of any
length needs no more memory than one turn.

Defined results: a null text or role is empty, a null part list has no parts, a
null part is left out; a part of null type is a text if it has a text, and else
a document, as is a part of unknown type; a null reference is read back as null,
an empty one as empty; neighbouring texts are read back as one text; sizes that
are missing, negative or no numbers count as one token, or one page; turns are ordered by turn (null first), equal ones by role and
text; rows with a null conv_id are one conversation; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import pick

START, END = "<|im_start|>", "<|im_end|>\n"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
#: A placeholder in the output: kind, number within the turn, reference.
_PLACEHOLDER = re.compile(r"<\|(image|audio|document) (\d+)(?: ([^|\n ]*))?\|>")
#: A turn in the output: role, then body up to the end mark.
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.IntegerType()),
    ]
)
FLAT = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("plain", T.StringType()),
        T.StructField(
            "attachments",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("number", T.IntegerType()),
                        T.StructField("type", T.StringType()),
                        T.StructField("ref", T.StringType()),
                        T.StructField("tokens", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("expanded_tokens", T.LongType()),
    ]
)


def escape(text: str) -> str:
    """``text`` without a bare ``<|``."""
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line, without a bare ``<|``."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    """The inverse of ``escape_role``."""
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


@dataclass
class Flattener:
    """Visits content parts in order."""

    #: Image tokens: one per patch of so many pixels a side; audio: per second; documents: per page.
    patch: int = 28
    per_second: float = 25.0
    per_page: int = 512
    content: list[str] = field(default_factory=list)
    plain: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    #: Neighbouring texts that aren't escaped yet.
    texts: list[str] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or ("text" if part.get("text") is not None else "document")
        getattr(self, f"visit_{kind}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, -(-(part.get(side) or 0) // self.patch)) for side in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0
        self._attach("audio", part, max(1, round(seconds * self.per_second)) if 0 < seconds < float("inf") else 1)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * self.per_page)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._escape_texts()
        number, ref = len(self.attachments), part.get("ref")
        self.attachments.append({"number": number, "type": kind, "ref": ref, "tokens": tokens})
        self.content.append(f"<|{kind} {number}{'' if ref is None else ' ' + quote(ref, safe='/:')}|>")

    def _escape_texts(self) -> None:
        text = "".join(self.texts)
        self.texts.clear()
        self.plain.append(text)
        self.content.append(escape(text))

    def result(self) -> dict:
        self._escape_texts()
        return {
            "content": "".join(self.content),
            "plain": "".join(self.plain),
            "attachments": self.attachments,
            "expanded_tokens": sum(a["tokens"] for a in self.attachments),
        }


def flatten_parts(messages: DataFrame, column: str = "parts") -> DataFrame:
    """``messages`` with the struct ``flat`` of its typed parts.

    ``content`` is the escaped text with placeholders, ``plain`` the texts alone,
    ``attachments`` has number, type, ref and tokens of each, ``expanded_tokens`` their sum.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = messages.columns
    plain = messages.toDF(*[f"_c{i}" for i in range(len(names))])
    at = f"_c{names.index(column)}"
    schema = T.StructType([*plain.schema.fields, T.StructField("flat", FLAT)])
    arrow = to_arrow_schema(T.StructType([schema["flat"]])).field("flat").type

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(at).to_pylist():
                visitor = Flattener()
                for part in parts or []:
                    if part is not None:
                        visitor.visit(part)
                out.append(visitor.result())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, "flat"])

    return plain.mapInArrow(flatten, schema).toDF(*names, "flat")


def text_parts(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and parts of plain rows (conv_id, turn, role, text): each text is a list of one text part."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    values = {"type": F.lit("text"), "text": F.col("text").cast("string")}
    part = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PART])
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_turns(messages: DataFrame) -> DataFrame:
    """Each message (conv_id, turn, role, parts; or text instead of parts) as the template writes it.

    Returns conv_id, turn, role, text (its text parts alone), ``formatted``, attachments and expanded_tokens.
    """
    typed = messages if any(n.lower() == "parts" for n in messages.columns) else text_parts(messages)
    rows = pick(typed, conv_id="conv_id", turn="turn", role="role", parts="parts").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        "parts",
    )
    role = F.regexp_replace(F.replace(F.replace("role", F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), r"<(\\*)\|", r"<$1\\|")
    return flatten_parts(rows).select(
        "conv_id",
        "turn",
        "role",
        F.col("flat.plain").alias("text"),
        F.concat(F.lit(START), role, F.lit("\n"), F.col("flat.content"), F.lit(END)).alias("formatted"),
        F.col("flat.attachments").alias("attachments"),
        F.col("flat.expanded_tokens").alias("expanded_tokens"),
    )


def read_parts(formatted: str) -> list[tuple[str, list[tuple[str, str | None]]]]:
    """(role, parts) of each turn in a formatted conversation; a part is (type, its text or reference)."""
    out = []
    for role, body in _TURN.findall(formatted):
        parts: list[tuple[str, str | None]] = []
        at = 0
        for m in _PLACEHOLDER.finditer(body):
            if m.start() > at:
                parts.append(("text", unescape(body[at : m.start()])))
            parts.append((m[1], None if m[3] is None else unquote(m[3])))
            at = m.end()
        if at < len(body):
            parts.append(("text", unescape(body[at:])))
        out.append((unescape_role(role), parts))
    return out


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, texts joined) of each turn in a formatted conversation."""
    return [(role, "".join(value or "" for kind, value in parts if kind == "text")) for role, parts in read_parts(formatted)]


class _Reader:
    """Running digests over one conversation's output."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.all_turns, self.loss_text = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text in parse(formatted):
            self.turns += 1
            self.all_turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss += len(text)
                self.loss_text.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all_turns.hexdigest(), self.loss, self.loss_text.hexdigest(), self.chars


_DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Reader | None = None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[] for _ in _DIGEST]
        done.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _DIGEST, strict=True)], schema=_DIGEST)

    for batch in batches:
        for conv_id, formatted in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Reader(conv_id)
            now.read(formatted)
        yield out()
    if now is not None:
        done.append(now.row())
    yield out()


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the ``formatted`` turns of ``format_turns``.

    The loss mask covers the texts of assistant turns, without marks and placeholders.
    """
    ordered = (
        turns.select("conv_id", "turn", "role", "text", "formatted")
        .repartition("conv_id")
        .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "formatted")
        .select("conv_id", "formatted")
    )
    return ordered.mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
