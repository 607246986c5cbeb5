"""Secrets, personal data and licences: findings, summaries, redaction.

Findings are expressions over lines: one row per line and match. Patterns are
literals, so each is compiled once per task. Regular expressions use ASCII
classes. Redaction of overlapping matches and validated kinds is a pandas UDF.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.tables import (
    LICENSE_COMMENTS,
    LICENSE_FILES,
    LICENSE_PHRASES,
    LICENSES,
    PII_PATTERNS,
    PII_PLACEHOLDERS,
    SECRET_ANCHORS,
    SECRET_PATTERNS,
    SOURCE_EXTENSIONS,
    SPDX_IDS,
)
from sievework.functions.text import contains_any, lines, mask, trim


def _lines(docs: DataFrame, key: str, text: str, keep: list[str] = ()) -> DataFrame:
    own = F.posexplode(lines(F.coalesce(F.col(text), F.lit("")))).alias("at", "line_text")
    return docs.select(key, *keep, own).select(key, *keep, (F.col("at") + 1).alias("line"), "line_text")


def _is_skipped(line: Column) -> Column:
    """Comments, and lines that speak of examples or placeholders."""
    own = trim(line)
    comment = own.startswith("//") | own.startswith("#") | own.startswith("/*") | own.startswith("*")
    return comment | own.rlike(r"(?i)\bexample\b") | F.contains(F.lower(own), F.lit("placeholder")) | F.contains(own, F.lit("xxxxx"))


def _matches(kind: str, severity: str, pattern: str, grouped: bool, source: Column) -> Column:
    """An array of a pattern's matches on ``line_text``: value, whole match, and whether the value is quoted."""
    part = lambda p, group: F.regexp_extract_all("line_text", F.lit(p), F.lit(group))
    pairs = F.arrays_zip(
        part(pattern, 1 if grouped else 0).alias("value"),
        part(pattern, 0).alias("whole"),
        part(pattern + r"(.?)", 2 if grouped else 1).alias("after"),
    )

    def made(p: Column) -> Column:
        quotes = [p["whole"].endswith(F.concat(F.lit(q), p["value"])) & (p["after"] == q) for q in ("'", '"')]
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(severity).alias("severity"),
            p["value"].alias("value"),
            p["whole"].alias("whole"),
            (~source if grouped else F.lit(True)).alias("unquoted_ok"),
            (quotes[0] | quotes[1]).alias("quoted"),
        )

    return F.transform(pairs, made)


def secret_findings(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, allow: list[str] = ()) -> DataFrame:
    """(key, line, kind, severity, masked) of every match of every pattern on lines that aren't skipped.

    In source files (by the extension of ``path``) values of key-value patterns
    count only within quotes. Matches with an allowed substring don't count.
    """
    rows = _lines(docs, key, text, [path] if path else []).filter(~_is_skipped(F.col("line_text")))
    source = F.lit(False)
    if path:
        source = F.coalesce(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(SOURCE_EXTENSIONS), F.lit(False))
    found = [_matches(kind, severity, pattern, grouped, source) for kind, severity, pattern, grouped in SECRET_PATTERNS]
    hit = F.explode(F.concat(*found)).alias("hit")
    # cheap tests first: most lines hold no anchor, and of the others most match nothing
    rows = rows.withColumn("lower_text", F.lower("line_text"))
    anchored = [F.contains("lower_text", F.lit(a)) if a else contains_any(F.col("lower_text"), ["secret", "token"]) for a in SECRET_ANCHORS]
    some = reduce(lambda a, b: a | b, [a & F.col("line_text").rlike(p) for a, (_, _, p, _) in zip(anchored, SECRET_PATTERNS, strict=True)])
    out = rows.filter(some).select(key, "line", hit).filter("hit.unquoted_ok OR hit.quoted")
    for a in allow:
        out = out.filter(~F.contains("hit.whole", F.lit(a)))
    return out.select(key, "line", "hit.kind", "hit.severity", mask(F.col("hit.value")).alias("masked"))


def secret_summary(findings: DataFrame) -> DataFrame:
    """Findings per severity and kind."""
    return findings.groupBy("severity", "kind").agg(F.count("*").alias("n"))


def redact_secrets_udf(allow: list[str] = ()) -> object:
    """A pandas UDF that masks every secret, from left to right, longer matches first; comments are not skipped."""
    patterns = [(re.compile(p), grouped) for _, _, p, grouped in SECRET_PATTERNS]
    allowed = list(allow)

    def redact(text: str) -> str:
        spans = []
        for pattern, grouped in patterns:
            for m in pattern.finditer(text):
                if not any(a in m[0] for a in allowed):
                    spans.append(m.span(1 if grouped else 0))
        taken: list[tuple[int, int]] = []
        for a, b in sorted(set(spans), key=lambda s: (s[0] - s[1], s[0])):
            if all(b <= c or d <= a for c, d in taken):
                taken.append((a, b))
        out, at = [], 0
        for a, b in sorted(taken):
            n = b - a
            edge = 0 if n <= 8 else min(4, n // 4)
            out += [text[at:a], text[a : a + edge], "*" * (n - 2 * edge), text[b - edge : b]]
            at = b
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t if t is None else "\n".join(map(redact, t.split("\n"))))

    return masked


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits with a right Luhn sum."""
    digits = _digits(value)
    return F.char_length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _iban_ok(value: Column) -> Column:
    moved = F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))
    digits = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(digits, F.lit(0), lambda a, d: F.when(d > 9, (a * 100 + d) % 97).otherwise((a * 10 + d) % 97))
    return rest == 1


def valid_pii(kind: Column, value: Column) -> Column:
    """Whether a match of a kind passes the kind's checks."""
    body = F.substring(value, 3, 40)
    country = F.substring(value, 1, 2)
    vat = (
        F.when(country == "DE", body.rlike(r"^[0-9]{9}$"))
        .when(country == "FR", body.rlike(r"^[A-Za-z0-9]{2}[0-9]{9}$"))
        .when(country == "IT", body.rlike(r"^[0-9]{11}$"))
        .when(country == "ES", body.rlike(r"^[A-Za-z][0-9]{7}[A-Za-z0-9]$"))
        .otherwise(F.char_length(_digits(body)) >= 2)
    )
    return (
        F.when(kind == "ssn", ~value.rlike(r"^(?:000|666|9..)|-00-|-0000$"))
        .when(kind == "credit_card", luhn(value))
        .when(kind == "ip_address", F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255))
        .when(kind == "iban", _iban_ok(value))
        .when(kind == "intl_phone", F.char_length(_digits(value)).between(7, 15))
        .when(kind == "eu_vat", vat)
        .otherwise(True)
    )


def may_hold_pii(text: Column) -> Column:
    """A digit, at sign or colon: every match of every kind that passes its checks has one."""
    return text.rlike("[0-9@:]")


def pii_matches(docs: DataFrame, kinds: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, kind, value) of every valid match of the kinds; overlapping kinds are all listed."""
    rows = _lines(docs, key, text)

    def of_kind(kind: str) -> Column:
        found = F.regexp_extract_all("line_text", F.lit(PII_PATTERNS[kind]), F.lit(0))
        return F.transform(found, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    made = [of_kind(k) for k in kinds]
    some = reduce(lambda a, b: a | b, [F.col("line_text").rlike(PII_PATTERNS[k]) for k in kinds])
    hits = rows.filter(may_hold_pii(F.col("line_text"))).filter(some).select(key, "line", F.explode(F.concat(*made)).alias("hit"))
    return hits.select(key, "line", "hit.kind", "hit.value").filter(valid_pii(F.col("kind"), F.col("value")))


_RANK = {"phone": 9, "intl_phone": 5}


def _luhn_ok(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and total % 10 == 0


def _iban_number(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def _vat_ok(value: str) -> bool:
    rules = {"DE": r"[0-9]{9}", "FR": r"[A-Za-z0-9]{2}[0-9]{9}", "IT": r"[0-9]{11}", "ES": r"[A-Za-z][0-9]{7}[A-Za-z0-9]"}
    body = value[2:]
    return bool(re.fullmatch(rules[value[:2]], body)) if value[:2] in rules else sum(c.isdigit() for c in body) >= 2


_CHECKS = {
    "ssn": lambda v: not re.search(r"^(?:000|666|9..)|-00-|-0000$", v),
    "credit_card": _luhn_ok,
    "ip_address": lambda v: all(int(o) <= 255 for o in v.split(".")),
    "iban": lambda v: _iban_number(v) == 1,
    "intl_phone": lambda v: 7 <= sum(c.isdigit() for c in v) <= 15,
    "eu_vat": _vat_ok,
}


def pii_findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, kind, value) of all kinds; of overlapping matches the more specific, else the earlier, stays."""
    compiled = {k: re.compile(p, re.ASCII) for k, p in PII_PATTERNS.items()}

    def of_line(line: str) -> list[tuple[int, int, str]]:
        raw = [
            (*m.span(), kind) for kind, p in compiled.items() for m in p.finditer(line) if _CHECKS.get(kind, lambda v: True)(m[0])
        ]
        kept: list[tuple[int, int, str]] = []
        for a, b, kind in sorted(raw, key=lambda r: r[:2]):
            clash = [x for x in kept if x[0] < b and a < x[1]]
            if any(_RANK.get(x[2], 10) >= _RANK.get(kind, 10) for x in clash):
                continue
            kept = [x for x in kept if x not in clash] + [(a, b, kind)]
        return kept

    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [{"kind": k, "value": t[a:b]} for a, b, k in of_line(t)])

    rows = _lines(docs, key, text).filter(may_hold_pii(F.col("line_text")))
    return rows.select(key, "line", F.explode(scan("line_text")).alias("hit")).select(key, "line", "hit.kind", "hit.value")


def pii_summary(findings: DataFrame) -> DataFrame:
    """Findings per kind."""
    return findings.groupBy("kind").agg(F.count("*").alias("n"))


def redact_kind(text: Column, kind: str) -> Column:
    """All matches of a kind without checks (email, phone, uk_nino, ipv6_address) as its placeholder."""
    if kind in _CHECKS:
        raise ValueError(f"{kind} needs redact_pii_udf")
    return F.regexp_replace(text, PII_PATTERNS[kind], F.lit(PII_PLACEHOLDERS[kind]))


def redact_pii_udf() -> object:
    """A pandas UDF that replaces all kinds, one after the other."""
    compiled = [(re.compile(PII_PATTERNS[k], re.ASCII), _CHECKS.get(k), p) for k, p in PII_PLACEHOLDERS.items()]

    may_hold = re.compile("[0-9@:]")

    def redact(text: str) -> str:
        for pattern, check, placeholder in compiled:
            text = pattern.sub(lambda m, c=check, p=placeholder: p if c is None or c(m[0]) else m[0], text)
        return text

    @F.pandas_udf("string")
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t if t is None or not may_hold.search(t) else redact(t))

    return redacted


def license_of(text: Column) -> Column:
    """The licence, confidence, phrase and line of the first phrase in the table that a text holds; else null."""
    return F.transform(F.array(F.lower(text)), _license_in)[0]


def _license_in(lower: Column) -> Column:
    out = F.lit(None).cast("struct<license:string,confidence:double,phrase:string,line:int>")
    for name, confidence, phrase in reversed(LICENSE_PHRASES):
        before = F.substring_index(lower, phrase, 1)
        line = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        found = F.struct(
            F.lit(name).alias("license"), F.lit(confidence).alias("confidence"), F.lit(phrase).alias("phrase"), line.cast("int").alias("line")
        )
        out = F.when(F.contains(lower, F.lit(phrase)), found).otherwise(out)
    return out


def is_license_file(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, r"([^/]*)$", 1)).isin(LICENSE_FILES)


def license_headers(docs: DataFrame, key: str = "doc_id", text: str = "text", max_lines: int = 50) -> DataFrame:
    """(key, line, license, confidence) by SPDX identifiers and licence phrases in comments of the first lines."""
    rows = _lines(docs, key, text).filter(F.col("line") <= max_lines).withColumn("lower", F.lower("line_text"))
    none = F.lit(None).cast("struct<license:string,confidence:double>")
    made = lambda name, c: F.struct(F.lit(name).alias("license"), F.lit(c).alias("confidence"))
    spdx, comment = none, none
    for piece, name in reversed(SPDX_IDS):
        spdx = F.when(F.contains("lower", F.lit(piece)), made(name, 0.99)).otherwise(spdx)
    for piece, name, confidence in reversed(LICENSE_COMMENTS):
        comment = F.when(F.contains("lower", F.lit(piece)), made(name, confidence)).otherwise(comment)
    in_comment = F.col("lower").rlike(r"//|/\*|\*|#")
    spdx = F.when(F.contains("lower", F.lit("spdx-license-identifier")), spdx)
    found = rows.select(key, "line", F.coalesce(spdx, F.when(in_comment, comment)).alias("f")).filter("f IS NOT NULL")
    return found.select(key, "line", "f.license", "f.confidence")


def license_files(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, confidence, line, spdx, risk, copyleft) of texts that hold a licence phrase."""
    spark = docs.sparkSession
    names = "license string, spdx string, risk string, copyleft boolean, strong boolean, permissive boolean"
    known = spark.createDataFrame(LICENSES, names)
    found = docs.select(key, license_of(F.col(text)).alias("f")).filter("f IS NOT NULL").select(key, "f.license", "f.confidence", "f.line")
    return found.join(F.broadcast(known), "license").select(key, "license", "confidence", "line", "spdx", "risk", "copyleft")


def license_summary(findings: DataFrame) -> DataFrame:
    """Findings per risk, and whether any is copyleft."""
    return findings.groupBy("risk").agg(F.count("*").alias("n"), F.bool_or("copyleft").alias("has_copyleft"))
