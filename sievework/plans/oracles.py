"""DuckDB SQL for the registered core queries."""

from __future__ import annotations

from sievework.functions import tables as T

_M = {m[0]: m for m in T.MODELS}


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def lines(text: str) -> str:
    return f"(CASE WHEN {text} = '' THEN [] ELSE string_split(regexp_replace({text}, '\\r?\\n$', ''), chr(10)) END)"


def estimate(text: str, model: str) -> str:
    special = "length(regexp_replace({t}, {p}, '', 'g'))"
    blanks = f"(strlen({text}) - strlen(translate({text}, ' ' || chr(9), '')))"
    ends = f"(strlen({text}) - strlen(replace({text}, chr(10), '')))"
    value = f"CAST(strlen({text}) AS FLOAT) / CAST({_M[model][1]} AS FLOAT)"
    value = f"CAST({value} - CAST(CAST({blanks} AS FLOAT) * CAST(0.3 AS FLOAT) AS FLOAT) AS FLOAT)"
    value = f"CAST({value} + CAST(CAST({ends} AS FLOAT) * CAST(0.5 AS FLOAT) AS FLOAT) AS FLOAT)"
    if _M[model][4]:
        pattern = q("[" + "".join("\\" + c for c in T.SPECIAL_CHARACTERS) + "]")
        count = f"(length({text}) - {special.format(t=text, p=pattern)})"
        value = f"CAST({value} + CAST(CAST({count} AS FLOAT) * CAST(0.3 AS FLOAT) AS FLOAT) AS FLOAT)"
    return f"(CASE WHEN {text} = '' THEN 0 ELSE greatest(CAST(ceil({value}) AS INTEGER), 1) END)"


def any_contains(text: str, pieces: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in pieces) + ")"


def counted(text: str, pieces: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {q(p)}) AS INTEGER)" for p in pieces) + ")"


def trimmed(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^\\s+', ''), '\\s+$', '')"


BLOCKS = f"""block AS (
  SELECT doc_id, ls[i] AS text, CAST(i - 1 AS INTEGER) AS block_ord
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {lines('text')} AS ls FROM documents)))"""

WORTHLESS = (
    f"({trimmed('lower(text)')} = '' OR (regexp_replace(regexp_replace({trimmed('lower(text)')}, '^[-– —]+', ''), '[-– —]+$', '') <> {trimmed('lower(text)')}"
    f" AND regexp_full_match(regexp_replace(regexp_replace({trimmed('lower(text)')}, '^[-– —]+', ''), '[-– —]+$', ''), '[0-9]{{1,4}}'))"
    f" OR starts_with({trimmed('lower(text)')}, 'page ') OR regexp_full_match({trimmed('lower(text)')}, '\\s*[0-9]*\\s*/\\s*[0-9]*\\s*')"
    f" OR (strlen({trimmed('lower(text)')}) < 5 AND NOT regexp_matches({trimmed('lower(text)')}, '\\pL')) OR {any_contains('lower(text)', T.BOILERPLATE)})"
)
NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN\\s]', '', 'g'), '\\s+', ' ', 'g'))"

_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
_NUMBER = "^[+-]?(?:[0-9]+\\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\\.[0-9]+(?:[eE][+-]?[0-9]+)?)$"
SCORE = (
    f"least(greatest(0.5::DOUBLE + {counted('lower(text)', T.REQUIREMENT_WORDS)} * 0.15::DOUBLE - {counted('lower(text)', T.INFORMATIVE_WORDS)} * 0.05::DOUBLE"
    f" + len(list_filter({_WORDS}, lambda w: contains(w, '%') OR regexp_matches(w, '{_NUMBER}') OR (contains(w, '/') AND strlen(w) <= 10"
    f" AND strlen(regexp_replace(w, '[^0-9]', '', 'g')) >= 2)))::DOUBLE / greatest(len({_WORDS}), 1) * 0.3::DOUBLE"
    " - CASE WHEN strlen(text) < 50 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN strlen(text) > 300 THEN 0.05::DOUBLE ELSE 0 END, 0), 1)"
)

_ESTIMATES = ", ".join(f"{estimate('text', m)} AS {m}" for m in T.COUNTED_MODELS)
_PAIRS = "[" + ", ".join(f"{{'tokens': {estimate('text', m)}, 'ord': {i}, 'model': '{m}'}}" for i, m in enumerate(T.COUNTED_MODELS)) + "]"


def _mask(s: str) -> str:
    edge = f"least(4, length({s}) // 4)"
    return (
        f"(CASE WHEN length({s}) <= 8 THEN repeat('*', length({s})) ELSE left({s}, {edge}) || repeat('*', length({s}) - 2 * {edge})"
        f" || right({s}, {edge}) END)"
    )


_COMMENT = "(starts_with(l, '//') OR starts_with(l, '#') OR starts_with(l, '/*') OR starts_with(l, '*'))"
_LINE = f"""line AS (SELECT doc_id, block_ord + 1 AS line, text, {trimmed('text')} AS l FROM block)"""
_SECRETS = " UNION ALL ".join(
    f"SELECT doc_id, line, '{kind}' AS kind, '{severity}' AS severity, unnest(regexp_extract_all(text, {q(p)}, {int(grouped)})) AS v FROM usable"
    for kind, severity, p, grouped in T.SECRET_PATTERNS
)
_SECRET = f"""WITH {BLOCKS}, {_LINE},
usable AS (SELECT * FROM line WHERE NOT {_COMMENT} AND NOT regexp_matches(l, '(?i)\\bexample\\b') AND NOT contains(lower(l), 'placeholder') AND NOT contains(l, 'xxxxx')),
found AS ({_SECRETS})"""

_PII = " UNION ALL ".join(f"SELECT doc_id, line, '{k}' AS kind, unnest(regexp_extract_all(text, {q(p)})) AS value FROM line" for k, p in T.PII_PATTERNS.items())
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = (
    f"(length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0"
    f" THEN CAST({_DIGITS}[i] AS INTEGER) ELSE (CASE WHEN 2 * CAST({_DIGITS}[i] AS INTEGER) > 9 THEN 2 * CAST({_DIGITS}[i] AS INTEGER) - 9"
    f" ELSE 2 * CAST({_DIGITS}[i] AS INTEGER) END) END)) % 10 = 0)"
)
def _valid(kind: str, v: str) -> str:
    """Whether a match of a kind of personal data passes its checks."""
    digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    letter = "CASE WHEN regexp_full_match(c, '[0-9]') THEN CAST(c AS BIGINT) ELSE ascii(c)::BIGINT - 55 END"
    return {
        "ssn": f"NOT regexp_matches({v}, '^(?:000|666|9..)|-00-|-0000$')",
        "credit_card": _LUHN.replace(_DIGITS, digits),
        "ip_address": f"len(list_filter(string_split({v}, '.'), lambda o: CAST(o AS INTEGER) > 255)) = 0",
        "iban": f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({v}[5:] || {v}[:4], ''), lambda c: {letter})),"
        " lambda a, d: CASE WHEN d > 9 THEN (a * 100 + d) % 97 ELSE (a * 10 + d) % 97 END) = 1",
        "intl_phone": f"length({digits}) BETWEEN 7 AND 15",
        "eu_vat": f"CASE {v}[:2] WHEN 'DE' THEN regexp_full_match({v}[3:], '[0-9]{{9}}') WHEN 'FR' THEN regexp_full_match({v}[3:], '[A-Za-z0-9]{{2}}[0-9]{{9}}')"
        f" WHEN 'IT' THEN regexp_full_match({v}[3:], '[0-9]{{11}}') WHEN 'ES' THEN regexp_full_match({v}[3:], '[A-Za-z][0-9]{{7}}[A-Za-z0-9]')"
        f" ELSE length(regexp_replace({v}[3:], '[^0-9]', '', 'g')) >= 2 END",
    }.get(kind, "true")


_CASES = " ".join(f"WHEN '{k}' THEN {_valid(k, 'value')}" for k in T.PII_PATTERNS)
_PII_VALID = f"""WITH {BLOCKS}, {_LINE}, raw AS ({_PII}), found AS (SELECT * FROM raw WHERE CASE kind {_CASES} END)"""


def _redacted(source: str) -> str:
    """A chain of tables from ``source`` to ``redacted``: all kinds in the column text, one after the other."""
    steps, before = [], source
    for k, (kind, mark) in enumerate(T.PII_PLACEHOLDERS.items()):
        pattern = q(T.PII_PATTERNS[kind])
        if _valid(kind, "v") == "true":
            text = f"regexp_replace(text, {pattern}, {q(mark)}, 'g')"
        else:
            found = f"list_filter(regexp_extract_all(text, {pattern}), lambda v: {_valid(kind, 'v')})"
            text = f"list_reduce(list_prepend(text, {found}), lambda t, v: replace(t, v, {q(mark)}))"
        name = "redacted" if k == len(T.PII_PLACEHOLDERS) - 1 else f"redacted{k}"
        steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE ({text} AS text) FROM {before})")
        before = name
    return ", ".join(steps)


def _compressed(source: str) -> str:
    """A chain of tables from ``source`` to ``compressed``: filler phrases go or become short, one after the other."""
    steps, before = [], source
    upper = "(CASE WHEN regexp_matches(p[i], '\\pL') THEN regexp_extract(p[i], '^([^\\pL]*)', 1) || upper(substr(p[i], length(regexp_extract(p[i], '^([^\\pL]*)', 1)) + 1, 1))"
    upper += " || substr(p[i], length(regexp_extract(p[i], '^([^\\pL]*)', 1)) + 2) ELSE p[i] END)"
    for k, (phrase, short) in enumerate(T.FILLERS):
        big = short[:1].upper() + short[1:]
        start = "((i = 2 AND p[1] = '') OR right(p[i - 1], 2) IN ('. ', '.' || chr(10)))"
        piece = f"CASE WHEN i = 1 THEN p[1] ELSE {upper} END" if not short else f"CASE WHEN i = 1 THEN p[1] ELSE (CASE WHEN {start} THEN {q(big)} ELSE {q(short)} END) || p[i] END"
        split = f"regexp_split_to_array(text, '(?i)' || {q(phrase)})"
        joined = f"(SELECT array_to_string(list_transform(range(1, len(p) + 1), lambda i: {piece}), '') FROM (SELECT {split} AS p))"
        steps.append(f"filler{k} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN contains(lower(text), {q(phrase)}) THEN {joined} ELSE text END AS text) FROM {before})")
        before = f"filler{k}"
    return ", ".join(steps) + f", compressed AS (SELECT * REPLACE ({trimmed("regexp_replace(text, ' {2,}', ' ', 'g')")} AS text) FROM {before})"


_STRIPPED = f"""stripped AS (SELECT * FROM block WHERE NOT {WORTHLESS}),
deduplicated AS (
  SELECT doc_id, block_ord, text FROM (SELECT *, {NORM} AS norm FROM stripped)
  QUALIFY strlen(norm) < 20 OR row_number() OVER (PARTITION BY doc_id, norm ORDER BY block_ord) = 1)"""


def _license(what: str) -> str:
    cases = " ".join(f"WHEN contains(t, {q(p)}) THEN {q(n) if what == 'license' else c if what == 'confidence' else q(p)}" for n, c, p in T.LICENSE_PHRASES)
    return f"CASE {cases} END"


_LICENSE_VALUES = ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {str(d).lower()})" for a, b, c, d, _, _ in T.LICENSES)
_LICENSES = f"""found AS (
  SELECT doc_id, {_license('license')} AS license, CAST({_license('confidence')} AS DOUBLE) AS confidence,
         CAST(length(string_split(t, {_license('phrase')})[1]) - length(replace(string_split(t, {_license('phrase')})[1], chr(10), '')) + 1 AS INTEGER) AS line
  FROM (SELECT doc_id, lower(text) AS t FROM documents)),
known(license, spdx, risk, copyleft) AS (VALUES {_LICENSE_VALUES}),
licensed AS (SELECT doc_id, license, confidence, line, spdx, risk, copyleft FROM found JOIN known USING (license))"""


def _next_fit(source: str, group: str, order: str, limit: int) -> str:
    """A recursive pass over each group's rows in order; ``source`` has the columns group, order, tokens."""
    return f"""numbered AS (SELECT {group} AS g, tokens, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS r FROM {source}),
fold(g, r, chunk, used, tokens) AS (
  SELECT g, r, 0, tokens, tokens FROM numbered WHERE r = 1
  UNION ALL
  SELECT n.g, n.r, CASE WHEN f.used + n.tokens > {limit} THEN f.chunk + 1 ELSE f.chunk END,
         CASE WHEN f.used + n.tokens > {limit} THEN n.tokens ELSE f.used + n.tokens END, n.tokens
  FROM fold f JOIN numbered n ON n.g = f.g AND n.r = f.r + 1),
chunks AS (SELECT g, chunk, count(*) AS files, sum(tokens) AS tokens FROM fold GROUP BY ALL)"""


_SUPPLY = """edge AS (
  SELECT o_custkey AS src, l_suppkey + 1000000000 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT s_suppkey + 1000000000, CAST(s_nationkey AS BIGINT) + 2000000000 FROM supplier)"""


def _pagerank(graph: str, rounds: int, dangling: bool, nodes: str = "SELECT src AS node FROM edge UNION SELECT dst FROM edge") -> str:
    parts = [
        graph,
        f"node AS ({nodes})",
        "degree AS (SELECT src, count(*) AS d FROM edge GROUP BY 1)",
        "size AS (SELECT count(*) AS n FROM node)",
        "share AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE / d AS share FROM edge JOIN degree USING (src) GROUP BY src, dst, d)",
        "r0 AS MATERIALIZED (SELECT node, src IS NULL AS sink, 1.0::DOUBLE / n AS rank FROM size, node LEFT JOIN degree ON node = src)",
    ]
    for k in range(1, rounds + 1):
        lost = f"(SELECT coalesce(sum(rank) FILTER (WHERE sink), 0) FROM r{k - 1}) * 0.85 / n" if dangling else "0"
        parts.append(
            f"r{k} AS MATERIALIZED (SELECT node, sink, 0.15::DOUBLE / n + {lost} + coalesce(gain, 0) * 0.85 AS rank FROM size, r{k - 1}"
            f" LEFT JOIN (SELECT dst, sum(rank * share) AS gain FROM share JOIN r{k - 1} ON node = src GROUP BY 1) ON node = dst)"
        )
    return "WITH " + ", ".join(parts)


_SPARSE = """edge AS (
  SELECT p_partkey AS src, (p_partkey * 7) % 211 AS dst FROM part
  UNION ALL SELECT p_partkey, (p_partkey * p_partkey) % 197 FROM part WHERE p_partkey % 5 = 0)"""
_PATHS = """path AS (
  SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '^m[.]', 'tests/') || '/src/index.ts' AS path FROM pages)"""
_VERSIONS = """now AS (SELECT CAST(doc_id AS VARCHAR) AS location_key, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3),
old AS (SELECT CAST(doc_id AS VARCHAR) AS location_key, sha256(CASE WHEN doc_id % 10 = 5 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 7),
diff AS (
  SELECT location_key, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'modified' ELSE 'unchanged' END AS status
  FROM now n FULL JOIN old o USING (location_key))"""
_FILES = """f AS (
  SELECT item_id AS ord, 'd/<' || item_id || '>|.md' AS path, CASE WHEN item_id % 3 <> 0 THEN 'markdown' END AS language,
         'a ``` ]]> "q" ,' || chr(10) || text AS content FROM benchmark)"""


def _xml(s: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = f"replace({s}, {q(a)}, {q(b)})"
    return s


def _yaml(s: str) -> str:
    s = f"replace(replace({s}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
    return f"replace(replace(replace({s}, chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"


def _cell(s: str) -> str:
    return f"regexp_replace(replace({s}, '|', chr(92) || '|'), '\\r?\\n', ' ', 'g')"


_FENCE = "repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(content, '`+'), lambda r: length(r))), 0) + 1))"
_T = "('=<a b=''c' || chr(92) || 'd''>|&\"' || text)"


def _rank_cases() -> str:
    name, p = "regexp_extract(lower(path), '([^/]*)$', 1)", "lower(path)"
    prefix = lambda pieces: "(" + " OR ".join(f"starts_with({name}, {q(x)})" for x in pieces) + ")"
    listed = ", ".join(map(q, T.CRITICAL_FILES))
    low = f"({any_contains(p, T.VENDOR_PIECES)} OR {any_contains(p, T.TEST_PIECES)})"
    base = (
        f"CASE WHEN {any_contains(p, T.VENDOR_PIECES)} THEN 0.05 WHEN {any_contains(p, T.TEST_PIECES)} THEN 0.15"
        f" WHEN {any_contains(name, T.CONFIG_PIECES)} OR {any_contains(p, T.CONFIG_PIECES)} THEN 0.25 WHEN {prefix(T.DOC_PREFIXES)} THEN 0.35"
        f" WHEN {name} IN ({listed}) THEN 1.0 WHEN {prefix(T.ENTRY_PREFIXES)} THEN 0.9 WHEN {any_contains(p, T.CORE_DIRECTORIES)} THEN 0.75 ELSE 0.5 END"
    )
    boosted = f"least({base} + least((page_id % 10)::DOUBLE / 50, 0.15), 1.0)"
    named = f"CASE WHEN {any_contains(name, T.BOOSTED_NAMES)} THEN least({boosted} + 0.1, 1.0) ELSE {boosted} END"
    return f"round(CASE WHEN {low} THEN {base} ELSE {named} END::DOUBLE, 6)"


_HALSTEAD = """m AS (SELECT p_partkey, p_size AS n1, p_partkey % 13 AS n2, p_size * 3 AS b1, p_partkey % 13 * 5 AS b2 FROM part),
h AS (SELECT *, CASE WHEN n1 + n2 > 0 THEN (b1 + b2) * log2((n1 + n2)::DOUBLE) ELSE 0 END AS volume,
             CASE WHEN n2 > 0 THEN n1 / 2.0 * (b2::DOUBLE / n2) ELSE 0 END AS difficulty FROM m)"""
_SPDX = " ".join(f"WHEN contains(t, {q(a)}) THEN {q(b)}" for a, b in T.SPDX_IDS)
_COMMENTS = " ".join(f"WHEN contains(t, {q(a)}) THEN {q(b)}" for a, b, _ in T.LICENSE_COMMENTS)
_COMMENT_SURE = " ".join(f"WHEN contains(t, {q(a)}) THEN {c}" for a, _, c in T.LICENSE_COMMENTS)

ORACLE: dict[str, str] = {
    "scan_language_stats": f"""
WITH per AS (SELECT lang AS language, count(*) AS files, CAST(sum(len({lines('text')})) AS BIGINT) AS lines, CAST(sum({estimate('text', 'claude')}) AS BIGINT) AS tokens
             FROM documents GROUP BY 1)
SELECT language, files, lines, round(100.0::DOUBLE * files / (SELECT sum(files) FROM per), 4) AS percent, tokens FROM per""",
    "scan_totals": "SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, "
    + ", ".join(f"CAST(sum(CAST(floor(CAST(strlen(text) AS FLOAT) / CAST({_M[m][1]} AS FLOAT)) AS INTEGER)) AS BIGINT) AS tokens_{m}" for m in T.COUNTED_MODELS)
    + " FROM documents",
    "model_table": "SELECT * FROM (VALUES "
    + ", ".join(f"({q(a)}, {w}, {min(w * 3 // 4, 500_000)}, {q(v)}, {str(e).lower()})" for a, _, w, v, _, e in T.MODELS)
    + ") AS t(model, context_window, default_budget, vendor, exact)",
    "token_estimate_all": f"SELECT doc_id, p.model AS model, p.tokens AS tokens FROM (SELECT doc_id, unnest({_PAIRS}) AS p FROM documents)",
    "cheapest_model": f"SELECT doc_id, p.model AS model, p.tokens AS tokens FROM (SELECT doc_id, list_min({_PAIRS}) AS p FROM documents)",
    "token_totals": f"SELECT {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}' for m in T.COUNTED_MODELS)} FROM (SELECT {_ESTIMATES} FROM documents)",
    "exceeds_budget": f"SELECT conv_id, turn, {estimate('text', 'claude')} AS tokens, {estimate('text', 'claude')} > 100 AS exceeds FROM conversations",
    "quick_estimates": "SELECT item_id, "
    + ", ".join(f"greatest(CAST(ceil(CAST(strlen(text) AS FLOAT) / CAST({_M[m][1]} AS FLOAT)) AS INTEGER), 1) AS quick_{m}" for m in ("claude", "gemini"))
    + ", CAST(floor(CAST(strlen(text) AS FLOAT) / CAST(3.6 AS FLOAT)) AS INTEGER) AS scan_cohere FROM benchmark",
    "remove_empty_lines": f"""
WITH t AS (SELECT doc_id, text || chr(10) || chr(10) || '  ' || chr(10) || text AS text FROM documents)
SELECT doc_id, md5(array_to_string(list_filter({lines('text')}, lambda x: {trimmed('x')} <> ''), chr(10))) AS digest FROM t""",
    "numbered_lines": f"""
WITH t AS (SELECT doc_id, {lines("(text || chr(10) || ' ' || chr(10) || 'end')")} AS ls FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: {trimmed('ls[i]')} <> ''), lambda i: i || ':' || ls[i]), chr(10))) AS digest FROM t""",
    "normalize_hash_dups": """
SELECT sha256(t) AS hash, count(*) AS n, min(doc_id) AS first
FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\f\\v]+(\\n|$)', '\\1', 'g'), '^\\n+', ''), '\\n+$', '') AS t FROM documents)
GROUP BY t HAVING count(*) > 1""",
    "paragraph_first_seen": f"""
WITH {BLOCKS}, n AS (SELECT doc_id, block_ord, {NORM} AS norm FROM block)
SELECT doc_id, block_ord, strlen(norm) < 20 OR row_number() OVER (PARTITION BY doc_id, norm ORDER BY block_ord) = 1 AS kept FROM n""",
    "strip_boilerplate": f"WITH {BLOCKS} SELECT doc_id, count(*) FILTER (WHERE NOT {WORTHLESS}) AS kept, count(*) FILTER (WHERE {WORTHLESS}) AS dropped FROM block GROUP BY 1",
    "section_score": f"WITH {BLOCKS} SELECT doc_id, round(least(greatest(avg({SCORE}), 0), 1), 6) AS importance FROM block GROUP BY 1",
    "arrange_thirds": f"""
WITH {BLOCKS}, s AS (SELECT doc_id, block_ord, round({SCORE}, 6) AS importance FROM block),
r AS (SELECT doc_id, block_ord, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, block_ord) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM s),
p AS (SELECT *, CASE WHEN n < 3 OR r <= ceil(n / 3.0) THEN 0 WHEN r <= 2 * ceil(n / 3.0) THEN 2 ELSE 1 END AS part FROM r)
SELECT doc_id, block_ord, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, block_ord) AS INTEGER) AS new_ord FROM p""",
    "secret_findings": f"{_SECRET} SELECT doc_id, line, kind, severity, {_mask('v')} AS masked FROM found",
    "secret_summary": f"{_SECRET} SELECT severity, kind, count(*) AS n FROM found GROUP BY ALL",
    "pii_findings": f"{_PII_VALID} SELECT doc_id, line, kind, value FROM found",
    "pii_summary": f"{_PII_VALID} SELECT kind, count(*) AS n FROM found GROUP BY 1",
    "pii_redact_email": f"SELECT doc_id, md5(regexp_replace(text, {q(T.PII_PATTERNS['email'])}, '[REDACTED-EMAIL]', 'g')) AS digest FROM documents",
    "license_files": f"WITH {_LICENSES} SELECT * FROM licensed",
    "license_risk": f"WITH {_LICENSES} SELECT risk, count(*) AS n, bool_or(copyleft) AS has_copyleft FROM licensed GROUP BY 1",
    "license_headers": f"""
WITH d AS (SELECT doc_id, '// SPDX-License-Identifier: LGPL-3.0' || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ') AS text FROM documents),
l AS (SELECT doc_id, CAST(i AS INTEGER) AS line, lower(ls[i]) AS t FROM (SELECT doc_id, ls, unnest(range(1, least(50, len(ls)) + 1)) AS i FROM (SELECT doc_id, {lines('text')} AS ls FROM d))),
f AS (SELECT doc_id, line, CASE WHEN contains(t, 'spdx-license-identifier') THEN (CASE {_SPDX} END) END AS spdx,
             CASE WHEN regexp_matches(t, '//|/\\*|\\*|#') THEN (CASE {_COMMENTS} END) END AS said, CAST(CASE {_COMMENT_SURE} END AS DOUBLE) AS sure FROM l)
SELECT doc_id, line, coalesce(spdx, said) AS license, CASE WHEN spdx IS NOT NULL THEN 0.99 ELSE sure END AS confidence FROM f WHERE coalesce(spdx, said) IS NOT NULL""",
    "html_title_text": """
SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
       CAST(strlen(trim(regexp_replace(regexp_replace(regexp_replace(html,
         '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS INTEGER) AS text_bytes
FROM pages""",
    "doc_chunks": f"""
WITH RECURSIVE {BLOCKS}, sized AS (SELECT doc_id, block_ord, CAST({estimate('text', 'claude')} AS BIGINT) AS tokens FROM block),
{_next_fit('sized', 'doc_id', 'block_ord', 400)}
SELECT g AS doc_id, CAST(chunk AS BIGINT) AS chunk, files, CAST(tokens AS BIGINT) AS tokens, count(*) OVER (PARTITION BY g) AS total FROM chunks""",
    "module_chunks": f"""
WITH RECURSIVE sized AS (SELECT source, doc_id, CAST({estimate('text', 'claude')} AS BIGINT) AS tokens FROM documents),
{_next_fit('sized', 'source', 'doc_id', 4000)}
SELECT g AS source, CAST(chunk AS BIGINT) AS chunk, files, CAST(tokens AS BIGINT) AS tokens, count(*) OVER (PARTITION BY g) AS total FROM chunks""",
    "budget_enforce": f"""
WITH RECURSIVE n AS (
  SELECT source, doc_id, CAST({estimate('text', 'claude')} AS BIGINT) AS t, row_number() OVER (PARTITION BY source ORDER BY n_chars % 7 DESC, doc_id) AS r FROM documents),
f(source, doc_id, r, total, action, used) AS (
  SELECT source, doc_id, r, CASE WHEN t <= 19000 THEN t ELSE 19000 END, CASE WHEN t <= 19000 THEN 'keep' ELSE 'truncate' END, CASE WHEN t <= 19000 THEN t ELSE 19000 END FROM n WHERE r = 1
  UNION ALL
  SELECT n.source, n.doc_id, n.r, CASE WHEN f.total + t <= 19000 THEN f.total + t WHEN f.total + 100 < 19000 THEN 19000 ELSE f.total END,
         CASE WHEN f.total + t <= 19000 THEN 'keep' WHEN f.total + 100 < 19000 THEN 'truncate' ELSE 'drop' END,
         CASE WHEN f.total + t <= 19000 THEN t WHEN f.total + 100 < 19000 THEN 19000 - f.total ELSE 0 END
  FROM f JOIN n ON n.source = f.source AND n.r = f.r + 1)
SELECT source, doc_id, action, CAST(used AS BIGINT) AS used FROM f""",
    "top_n_by_importance": """
SELECT doc_id, quality * 1000000 + n_chars AS score, CAST(row_number() OVER (ORDER BY quality * 1000000 + n_chars DESC, doc_id) AS INTEGER) AS rank
FROM documents JOIN labels USING (doc_id) ORDER BY score DESC, doc_id LIMIT 25""",
    "sample_documents": "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50",
    "keyword_top": """
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 4)) AS word FROM documents),
c AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, word) AS r FROM w GROUP BY 1, 2)
SELECT doc_id, string_agg(word, ' ' ORDER BY r) AS words FROM c WHERE r <= 10 GROUP BY 1""",
    "module_graph": """
SELECT p_brand AS src_module, 'nation' || s_nationkey AS dst_module, count(*) AS weight
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
    "pagerank": _pagerank(_SUPPLY, 20, True) + " SELECT node, round(rank, 8) AS rank FROM r20",
    "file_importance": _pagerank(_SUPPLY, 30, False) + " SELECT node, round(rank / (SELECT max(rank) FROM r30), 8) AS rank FROM r30",
    "scc_cycles": f"""
WITH RECURSIVE {_SPARSE}, reach(a, b) AS (SELECT src, dst FROM edge WHERE src <> dst UNION SELECT r.a, e.dst FROM reach r JOIN edge e ON e.src = r.b),
both_ways AS (SELECT x.a AS node, x.b AS other FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b)
SELECT node, least(node, min(other)) AS component FROM both_ways GROUP BY node""",
    "closure": f"""
WITH RECURSIVE {_SPARSE}, reach(src, dst) AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON e.src = r.dst)
SELECT src, dst FROM reach""",
    "transitive_callers": f"""
WITH RECURSIVE {_SPARSE}, reach(node, depth) AS (SELECT CAST(unnest([3, 4, 5]) AS BIGINT), 0 UNION SELECT e.src, r.depth + 1 FROM reach r JOIN edge e ON e.dst = r.node WHERE r.depth < 3)
SELECT node, depth FROM (SELECT node, min(depth) AS depth FROM reach GROUP BY 1) WHERE depth > 0""",
    "callers_callees": f"""
WITH {_SPARSE}, p AS (SELECT DISTINCT src, dst FROM edge)
SELECT node, coalesce(a, 0) AS callers, coalesce(b, 0) AS callees
FROM (SELECT dst AS node, count(*) AS a FROM p GROUP BY 1) FULL JOIN (SELECT src AS node, count(*) AS b FROM p GROUP BY 1) USING (node)""",
    "call_chain": f"""
WITH {_SPARSE}, f AS (SELECT src, min(dst) AS nxt FROM edge GROUP BY 1), s0 AS (SELECT src AS node FROM edge UNION SELECT dst FROM edge),
s1 AS (SELECT node AS start, nxt AS a FROM s0 JOIN f ON node = src WHERE nxt <> node),
s2 AS (SELECT start, a, nxt AS b FROM s1 JOIN f ON a = src WHERE nxt NOT IN (start, a)),
s3 AS (SELECT start, nxt AS c FROM s2 JOIN f ON b = src WHERE nxt NOT IN (start, a, b))
SELECT start, 1 AS step, a AS node FROM s1 UNION ALL SELECT start, 2, b FROM s2 UNION ALL SELECT start, 3, c FROM s3""",
    "topological_levels": f"""
WITH RECURSIVE {_SPARSE}, e AS (SELECT DISTINCT greatest(src, dst) AS src, least(src, dst) AS dst FROM edge WHERE src <> dst),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
walk(node, level) AS (SELECT node, 0 FROM n UNION SELECT e.dst, w.level + 1 FROM walk w JOIN e ON e.src = w.node)
SELECT node, max(level) AS level FROM walk GROUP BY 1""",
    "resolve_calls": """
WITH s AS (SELECT p_partkey AS callee_id, p_brand AS f, 'f' || p_size AS name FROM part),
c AS (SELECT s_suppkey AS caller_id, 'f' || s_nationkey AS name FROM supplier),
r AS (SELECT caller_id, callee_id, row_number() OVER (PARTITION BY caller_id ORDER BY CASE WHEN f = 'Brand#11' THEN 0 WHEN f IN ('Brand#22', 'Brand#33') THEN 1 ELSE 2 END, callee_id) AS k
      FROM c JOIN s USING (name))
SELECT caller_id, callee_id FROM r WHERE k = 1""",
    "range_line_symbol": """
WITH s AS (SELECT p_brand AS file, p_partkey % 500 AS a, p_partkey % 500 + p_size AS b, p_partkey AS symbol_id FROM part),
p AS (SELECT DISTINCT p_brand AS file, p_partkey * 3 % 500 AS line FROM part),
r AS (SELECT p.file, line, symbol_id, row_number() OVER (PARTITION BY p.file, line ORDER BY b - a, a, symbol_id) AS k FROM p JOIN s ON p.file = s.file AND line BETWEEN a AND b)
SELECT file, line, symbol_id FROM r WHERE k = 1""",
    "manifest_diff": f"WITH {_VERSIONS} SELECT location_key, status FROM diff",
    "manifest_rows": f"WITH {_VERSIONS} SELECT location_key, status FROM diff WHERE status <> 'unchanged'",
    "manifest_checksum": f"""
WITH {_VERSIONS}, d AS (SELECT sha256(location_key || chr(0) || h) AS x FROM now)
SELECT count(*) AS entries, sha256({" || '-' || ".join(f"CAST(sum(CAST('0x' || substr(x, {k}, 8) AS BIGINT)) AS VARCHAR)" for k in (1, 9, 17, 25))}) AS checksum FROM d""",
    "chunk_ids": """
SELECT doc_id, 'ec_' || substr(sha256(k || chr(0) || sha256(text)), 1, 32) AS chunk_id, k AS location_key
FROM (SELECT *, source || '|' || lang || '|' || doc_id AS k FROM documents)""",
    "collisions": "SELECT doc_id % 50 AS chunk_id, count(DISTINCT sha256(text)) AS hashes FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1",
    "cache_staleness": "SELECT doc_id AS path, n_chars AS size FROM documents WHERE doc_id % 4 = 1 OR doc_id % 6 = 0",
    "deleted_files": "SELECT doc_id AS path FROM documents WHERE doc_id % 3 = 0",
    "upsert_batches": "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 64 AS BIGINT) AS batch FROM documents",
    "audit_chain": """
WITH r AS (SELECT o_custkey AS log, o_orderkey AS seq, lag(CAST(o_orderkey AS VARCHAR)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT log, seq FROM r WHERE seq % 97 = 0 AND coalesce(before, '') <> 'x'""",
    "unused_parts": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
    "cosine_pairs": """
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
WHERE a.vec_id % 100 = 0 AND round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) >= 0.3""",
    "watch_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events)
SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY 1""",
    "commit_frequency": """
WITH n AS (SELECT max(o_orderdate) AS t FROM orders)
SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderdate >= t - INTERVAL 90 DAY) AS recent, CAST(date_diff('day', max(o_orderdate), max(t)) AS INTEGER) AS age_days
FROM orders, n GROUP BY 1""",
    "file_rank": f"""
WITH {_PATHS}, r AS (SELECT * FROM path UNION ALL SELECT page_id, regexp_replace(path, 'src/index.ts$', 'lib/user_service.py') FROM path),
s AS (SELECT page_id, path, {_rank_cases()} AS importance FROM r)
SELECT *, CASE WHEN importance > 0.8 THEN 'critical' WHEN importance > 0.6 THEN 'high' WHEN importance > 0.3 THEN 'normal' ELSE 'low' END AS bucket FROM s""",
    "filter_paths": f"""
WITH {_PATHS} SELECT * FROM path
WHERE (contains(path, 'example.com') OR contains(path, 'example.org/en')) AND NOT list_contains(string_split(path, '/'), 'tests') AND NOT starts_with(path, 'tests')
  AND NOT starts_with(path, 'www.') AND NOT starts_with(path, 'blog.ththti')""",
    "normalize_paths": f"""
WITH {_PATHS} SELECT page_id, array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), '/') || '/x/z' AS path, 'typescript' AS language FROM path""",
    "identifiers": """
WITH n AS (SELECT p_partkey, 'parseHTTP' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || '_v2' AS t FROM part)
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+'), lambda w: w <> ''), ' ') AS words FROM n""",
    "escapes": f"""
SELECT item_id, {_xml(_T)} AS xml, {_yaml(_T)} AS yaml, {_cell(_T)} AS cell, '''' || {_T} AS guarded, {_mask('text')} AS masked,
       CASE WHEN length({_T}) > 40 THEN left({_T}, 37) || '...' ELSE {_T} END AS short,
       CASE WHEN regexp_matches(text, '(?s)^\\s*.*?[.!?](\\s|$)') THEN regexp_extract(text, '(?s)^\\s*(.*?[.!?])(?:\\s|$)', 1) ELSE {trimmed('string_split(text, chr(10))[1]')} END AS sentence
FROM benchmark""",
    "data_uris": "SELECT item_id, regexp_replace(text, '[\\r\\n]', '', 'g') || ' data:image/png;base64,[BASE64_TRUNCATED] end' AS text FROM benchmark",
    "halstead_measures": f"""
WITH {_HALSTEAD}
SELECT p_partkey, round(volume, 4) AS volume, round(difficulty, 4) AS difficulty, round(volume * difficulty, 4) AS effort, round(volume / 3000, 4) AS bugs,
       round(least(greatest((171 - 5.2 * ln(greatest(volume, 1)) - 0.23 * n2 - 16.2 * ln(greatest(n1, 1)::DOUBLE)) * 100 / 171, 0), 100), 4) AS maintainability FROM h""",
    "complexity_gates": """
WITH m AS (
  SELECT p_partkey, 'cyclomatic' AS measure, p_size AS v, p_size > 20 AS e, p_size > 10 AS w FROM part
  UNION ALL SELECT p_partkey, 'cognitive', p_partkey % 37, p_partkey % 37 > 30, p_partkey % 37 > 15 FROM part
  UNION ALL SELECT p_partkey, 'nesting', p_partkey % 8, p_partkey % 8 > 6, p_partkey % 8 > 4 FROM part
  UNION ALL SELECT p_partkey, 'parameters', p_partkey % 11, p_partkey % 11 > 8, p_partkey % 11 > 5 FROM part
  UNION ALL SELECT p_partkey, 'maintainability', p_partkey % 101, p_partkey % 101 < 20, p_partkey % 101 < 40 FROM part)
SELECT p_partkey, measure, CAST(v AS DOUBLE) AS value, CASE WHEN e THEN 'error' ELSE 'warning' END AS severity FROM m WHERE e OR w""",
    "symbol_scores": """
WITH u AS (SELECT p_name, count(*) AS n FROM (SELECT p_name FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT p_name FROM supplier JOIN part ON s_suppkey = p_partkey) GROUP BY 1),
s AS (SELECT p_partkey, p_size, coalesce(n, 0) AS refs, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.3 END AS k FROM part LEFT JOIN u USING (p_name))
SELECT p_partkey, refs, round(least(greatest(0.4::DOUBLE * refs / greatest((SELECT max(refs) FROM s), 1) + 0.25 * k + 0.2 * 0.5 + 0.15 * least(p_size::DOUBLE / (SELECT max(p_size) FROM s), 1), 0), 1), 6) AS score FROM s""",
    "impact_levels": f"""
WITH {_SPARSE}, p AS (SELECT DISTINCT src, dst FROM edge),
d AS (SELECT node, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT dst AS node, count(*) AS a FROM p GROUP BY 1) FULL JOIN (SELECT src AS node, count(*) AS b FROM p GROUP BY 1) USING (node))
SELECT node, CASE WHEN a > 20 OR a * 3 + b > 50 THEN 'critical' WHEN a > 10 OR a * 3 + b > 20 THEN 'high' WHEN a > 3 OR a * 3 + b > 5 THEN 'medium' ELSE 'low' END AS level FROM d""",
    "common_symbols": "SELECT unnest(string_split(upper(p_name), ' ')) AS name FROM part INTERSECT SELECT p_type FROM part",
    "emit_documents": f"WITH {BLOCKS} SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY block_ord)) AS digest FROM block GROUP BY 1",
    "graph_export": f"""
WITH {_SPARSE}, s AS (SELECT 's:' || p_partkey AS id, p_name AS name, p_brand || '/' || p_size || '.py' AS file, p_brand AS m, CASE WHEN p_partkey % 4 = 0 THEN p_partkey // 2 END AS parent FROM part),
v AS (SELECT id, 'symbol' AS label, name FROM s UNION ALL SELECT DISTINCT 'f:' || file, 'file', file FROM s UNION ALL SELECT DISTINCT 'm:' || m, 'module', m FROM s),
e AS (SELECT id AS src, 'f:' || file AS dst, 'DEFINED_IN' AS label FROM s UNION ALL SELECT 's:' || src, 's:' || dst, 'CALLS' FROM edge
  UNION ALL SELECT DISTINCT 'f:' || file, 'm:' || m, 'BELONGS_TO' FROM s UNION ALL SELECT 's:' || parent, id, 'CONTAINS' FROM s WHERE parent IS NOT NULL)
SELECT id, label, name, NULL::VARCHAR AS src, NULL::VARCHAR AS dst FROM v UNION ALL SELECT src || '-' || label || '-' || dst, label, NULL, src, dst FROM e""",
    "emit_xml": f"""
WITH {_FILES} SELECT ord, '<file path="' || {_xml('path')} || '"' || CASE WHEN language IS NOT NULL THEN ' language="markdown"' ELSE '' END || '><![CDATA['
  || replace(content, ']]>', ']]]]><![CDATA[>') || ']]></file>' AS text FROM f""",
    "emit_markdown": f"""
WITH {_FILES} SELECT ord, '### ' || {_cell('path')} || chr(10) || chr(10) || {_FENCE} || coalesce(language, '') || chr(10) || content || chr(10) || {_FENCE} AS text FROM f""",
    "emit_yaml": f"""
WITH {_FILES} SELECT ord, '- path: "' || {_yaml('path')} || '"' || chr(10) || '  language: "' || coalesce(language, '') || '"' || chr(10) || '  content: "' || {_yaml('content')} || '"' AS text FROM f""",
    "emit_toon": f"""
WITH {_FILES} SELECT ord, {_yaml('path')} || ',' || coalesce(language, '') || ',' || replace({_yaml('content')}, ',', chr(92) || ',') AS text FROM f""",
    "emit_plain": f"""
WITH {_FILES}, l AS (SELECT ord, path, {lines('content')} AS ls FROM f)
SELECT ord, '=== ' || path || ' ===' || chr(10) || array_to_string(list_transform(range(1, len(ls) + 1), lambda i: i || ': ' || ls[i]), chr(10)) AS text FROM l""",
}

_TYPES = """t AS (SELECT 'T' || p_partkey AS name, CASE WHEN p_partkey > 2 THEN 'T' || (p_partkey // 3) END AS parent FROM part),
up(name, ancestor, depth) AS (SELECT name, parent, 1 FROM t WHERE parent IS NOT NULL UNION ALL SELECT u.name, t.parent, u.depth + 1 FROM up u JOIN t ON t.name = u.ancestor WHERE t.parent IS NOT NULL)"""
_UNIQUE = """c AS (SELECT s_suppkey AS caller_id, 'Brand#1' || (s_suppkey % 5 + 1) AS file, 'f' || (s_suppkey * 5 % 601) AS name FROM supplier),
s AS (SELECT p_partkey AS id, p_brand AS file, 'f' || (p_partkey % 601) AS name FROM part),
r AS (SELECT caller_id, c.name, coalesce(
  (SELECT CASE WHEN count(DISTINCT id) = 1 THEN min(id) END FROM s WHERE s.name = c.name AND s.file = c.file),
  (SELECT CASE WHEN count(DISTINCT id) = 1 THEN min(id) END FROM s WHERE s.name = c.name AND s.file = 'Brand#22')) AS callee_id FROM c)"""

ORACLE |= {
    "csv_tables": """
SELECT n_regionkey || '.csv' AS path, 'table' AS block_type,
       'k | name | r' || chr(10) || string_agg(n_nationkey || ' | ' || n_name || ' | ''=' || n_regionkey, chr(10) ORDER BY n_nationkey || ';' || n_name) AS text
FROM nation GROUP BY n_regionkey""",
    "diff_lines": """
WITH b AS (SELECT item_id AS key, CAST(item_id + 1 AS BIGINT) AS a, replace(text, chr(10), ' ') AS t FROM benchmark)
SELECT key, CAST(1 AS BIGINT) AS hunk, 'context' AS kind, a AS old_line, a AS new_line, 'same' AS text FROM b
UNION ALL SELECT key, 1, 'remove', a + 1, NULL, 'old' FROM b UNION ALL SELECT key, 1, 'add', NULL, a + 1, 'new' FROM b UNION ALL SELECT key, 1, 'add', NULL, a + 2, t FROM b""",
    "classify_changes": """
WITH c AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'deletion' WHEN 1 THEN 'file_rename' WHEN 2 THEN 'new_code' WHEN 3 THEN 'signature' WHEN 4 THEN 'type_definition'
  WHEN 5 THEN 'import' WHEN 6 THEN 'documentation' ELSE CASE WHEN p_size % 2 = 0 THEN 'type_definition' ELSE 'implementation' END END AS class FROM part)
SELECT p_partkey, class, CAST(CASE class WHEN 'deletion' THEN 1.5 WHEN 'signature' THEN 1.3 WHEN 'type_definition' THEN 1.2 WHEN 'file_rename' THEN 1.1 WHEN 'import' THEN 0.9
  WHEN 'new_code' THEN 0.8 WHEN 'implementation' THEN 0.7 ELSE 0.3 END AS DOUBLE) AS weight FROM c""",
    "expand_context": f"""
WITH RECURSIVE {_SPARSE}, n AS (SELECT src AS node FROM edge UNION SELECT dst FROM edge),
reach(node, depth) AS (SELECT CAST(unnest([10, 11, 12, 13]) AS BIGINT), 0 UNION SELECT e.src, r.depth + 1 FROM reach r JOIN edge e ON e.dst = r.node WHERE r.depth < 2)
SELECT node AS symbol_id, min(depth) AS level, node % 5 = 0 AS is_test, CASE min(depth) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS score
FROM reach WHERE node IN (SELECT node FROM n) GROUP BY node""",
    "type_ancestors": f"WITH RECURSIVE {_TYPES} SELECT name, ancestor, min(depth) AS depth FROM up GROUP BY 1, 2",
    "type_depths": f"WITH RECURSIVE {_TYPES} SELECT t.name, coalesce(max(depth), 0) AS depth FROM t LEFT JOIN up USING (name) GROUP BY 1",
    "type_ends": f"""
WITH RECURSIVE {_TYPES} SELECT name, 'root' AS "end" FROM t WHERE parent IS NULL UNION ALL SELECT name, 'leaf' FROM t WHERE name NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)""",
    "link_parents": """
WITH p AS (SELECT p_partkey AS id, p_brand AS file, 'n' || (p_partkey % 11) AS name, CASE WHEN p_partkey % 2 = 1 THEN 'n' || (p_partkey % 7) END AS parent,
                  p_partkey % 200 AS a, p_partkey % 200 + p_size AS b FROM part),
r AS (SELECT c.id, o.id AS parent_id, row_number() OVER (PARTITION BY c.id ORDER BY CASE WHEN o.a <= c.a AND c.b <= o.b THEN 0 WHEN o.a <= c.b AND c.a <= o.b THEN 1 ELSE 2 END, o.b - o.a, o.a, o.b, o.id) AS k
      FROM p c JOIN p o ON c.file = o.file AND c.parent = o.name AND c.id <> o.id)
SELECT id, parent_id FROM r WHERE k = 1""",
    "resolve_unique": f"WITH {_UNIQUE} SELECT * FROM r",
    "called_by": f"WITH {_UNIQUE} SELECT callee_id AS symbol_id, string_agg(CAST(caller_id AS VARCHAR), ',' ORDER BY caller_id) AS callers, count(*) AS n FROM (SELECT DISTINCT callee_id, caller_id FROM r WHERE callee_id IS NOT NULL) GROUP BY 1",
    "merge_aliases": """
SELECT p_brand AS file, p_size AS start_line, min(p_partkey) AS id, arg_min(p_name, p_partkey) AS name, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS tags,
       max(p_partkey % 50) AS tokens, count(*) AS aliases FROM part GROUP BY 1, 2""",
    "cross_repo_links": """
WITH k AS (SELECT p_brand AS repo, CAST(substr(p_brand, 7, 2) AS INTEGER) AS o, p_name || ' ' || (p_partkey % 9) AS name FROM part),
u AS (SELECT p_brand AS repo, CAST(substr(p_brand, 7, 2) AS INTEGER) AS o, p_name || ' ' || (p_partkey * 5 % 9) AS name FROM part),
f AS (SELECT name, min(o) AS o, arg_min(repo, o) AS target_repo FROM k GROUP BY 1)
SELECT DISTINCT u.repo, u.name, 'call' AS kind, f.target_repo FROM u JOIN f USING (name)
WHERE f.o < u.o AND NOT EXISTS (SELECT 1 FROM k WHERE k.repo = u.repo AND k.name = u.name)""",
    "hierarchy_summaries": """
SELECT 'f' AS file, 'R' || n_regionkey AS parent, count(*) AS children,
       'R' || n_regionkey || ':' || chr(10) || string_agg('- method ' || n_name, chr(10) ORDER BY n_nationkey) AS summary
FROM nation GROUP BY n_regionkey HAVING count(*) >= 2""",
    "dead_code": """
WITH s AS (SELECT p_partkey AS p, p_brand AS file, CASE WHEN p_partkey % 10 = 0 THEN 'test_' ELSE 's' END || p_partkey AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'constant' END AS kind FROM part)
SELECT file, name, kind, round(least(0.5::DOUBLE + CASE WHEN p % 2 = 0 THEN 0.3 ELSE 0 END + CASE kind WHEN 'function' THEN 0.1 WHEN 'class' THEN 0.05 ELSE 0.15 END, 0.95), 6) AS confidence
FROM s WHERE p % 10 <> 0 AND NOT (p % 7 = 0 AND p % 2 = 1) AND p NOT IN (SELECT s_suppkey * 7 FROM supplier)""",
    "tests_by_name": """
WITH s AS (SELECT p_partkey AS p, 'src/m' || p_partkey || '.py' AS path, 'm' || p_partkey AS stem FROM part),
t AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'tests/m' || p_partkey || 'x.py' WHEN 1 THEN 'a/test_m' || p_partkey || '.py' ELSE 'a/xm' || p_partkey || '_test.go' END AS test FROM part)
SELECT path, test FROM s JOIN t ON contains(test, stem || '_test.') OR contains(test, 'test_' || stem) OR contains(test, stem || '.test.') OR contains(test, stem || '.spec.')
  OR contains(test, 'test/' || stem) OR contains(test, 'tests/' || stem) OR contains(test, '__tests__/' || stem)""",
    "unreachable_code": """
SELECT CAST(p_partkey AS VARCHAR) AS path, 5 AS line, 2 AS terminator_line, 'y()' AS snippet FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 1""",
    "code_measures": "SELECT p_partkey, 2 * p_size + 1 AS loc, p_size AS depth FROM part",
    "remote_urls": """
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' END AS provider, CASE s_suppkey % 3 WHEN 0 THEN 'o' || s_suppkey WHEN 1 THEN 'g' END AS owner,
       CASE s_suppkey % 3 WHEN 0 THEN 'r' WHEN 1 THEN 'p' || s_suppkey END AS name FROM supplier""",
    "fixed_chunks": f"""
WITH RECURSIVE sized AS (SELECT 1 AS one, doc_id, CAST({estimate('text', 'claude')} AS BIGINT) AS tokens FROM documents),
{_next_fit('sized', 'one', 'doc_id', 8000)},
place AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, tokens, CAST(chunk AS BIGINT) AS chunk FROM fold JOIN place USING (r)""",
    "chunk_neighbours": """
SELECT n_regionkey, n_nationkey AS chunk, n_name AS focus, count(*) OVER (PARTITION BY n_regionkey) AS total,
       'Previous: ' || lag(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS previous,
       'Next: Chunk ' || (lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1) AS next FROM nation""",
    "character_vectors": """
WITH c AS (SELECT item_id, unnest(range(1, length(text) + 1)) AS i, text FROM benchmark),
b AS (SELECT item_id, CAST(unicode(substr(text, i, 1)) % 384 AS INTEGER) AS bucket, sum(1.0::DOUBLE / i) AS w FROM c GROUP BY 1, 2),
n AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM b GROUP BY 1)
SELECT item_id, bucket, round(CAST(CAST(w / norm AS FLOAT) AS DOUBLE), 4) AS x FROM b JOIN n USING (item_id)""",
    "rollup_sources": "SELECT lang, source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)",
}

_SIZES = f"count(*) AS blocks, CAST(sum({estimate('text', 'claude')}) AS BIGINT) AS tokens"
_MASKED = f"""WITH row_text AS (
  SELECT doc_id, i, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
hit AS ({" UNION ".join(f"SELECT doc_id, i, unnest(regexp_extract_all(text, {q(p)}, {int(g)})) AS v FROM row_text" for _, _, p, g in T.SECRET_PATTERNS)}),
found AS (SELECT doc_id, i, list(v ORDER BY length(v) DESC, v) AS vs FROM hit GROUP BY 1, 2),
masked AS (
  SELECT doc_id, i, CASE WHEN vs IS NULL THEN text ELSE list_reduce(list_prepend(text, vs), lambda t, v: replace(t, v, {_mask('v')})) END AS text
  FROM row_text LEFT JOIN found USING (doc_id, i))"""
_SEMANTIC = f"""n AS (SELECT path, split_part(path, '/', 1) AS m, tokens, row_number() OVER (ORDER BY path) AS r FROM
  (SELECT source || '/' || doc_id AS path, CAST({estimate('text', 'claude')} AS BIGINT) AS tokens FROM documents)),
f(r, path, tokens, m, chunk, overlap, used) AS (
  SELECT r, path, tokens, m, 0::BIGINT, false, tokens FROM n WHERE r = 1
  UNION ALL
  SELECT n.r, n.path, n.tokens, n.m, f.chunk + s::INTEGER, s AND f.tokens * 10 <= 8000,
         CASE WHEN NOT s THEN f.used + n.tokens WHEN f.tokens * 10 <= 8000 THEN f.tokens + n.tokens ELSE n.tokens END
  FROM f JOIN n ON n.r = f.r + 1, LATERAL (SELECT f.used > 0 AND (f.used + n.tokens > 8000 OR (n.m <> f.m AND f.used > 4000)) AS s))"""

ORACLE |= {
    "map_pagerank": _pagerank(_SPARSE, 20, True)
    + ", change AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.rank - b.rank)) AS c FROM r{k} a JOIN r{k - 1} b USING (node)" for k in range(1, 21))
    + "), stop AS (SELECT coalesce(min(k) FILTER (WHERE c < 1e-4), 20) AS k FROM change), every_round AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, node, rank FROM r{k}" for k in range(1, 21))
    + ") SELECT node, round(rank, 8) AS rank FROM every_round JOIN stop USING (k)",
    "compress_fillers": f"WITH {BLOCKS}, {_compressed('block')} SELECT doc_id, CAST(strlen(t) AS BIGINT) AS bytes, md5(t) AS digest"
    " FROM (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_ord) AS t FROM compressed GROUP BY 1)",
    "ingest_summary": f"""
WITH {BLOCKS}, {_STRIPPED}, b AS (SELECT doc_id, {_SIZES} FROM block GROUP BY 1), a AS (SELECT doc_id, {_SIZES} FROM deduplicated GROUP BY 1)
SELECT lang, count(*) AS documents, CAST(sum(coalesce(b.blocks, 0)) AS BIGINT) AS blocks_before, CAST(sum(coalesce(a.blocks, 0)) AS BIGINT) AS blocks_after,
       CAST(sum(coalesce(b.tokens, 0)) AS BIGINT) AS tokens_before, CAST(sum(coalesce(a.tokens, 0)) AS BIGINT) AS tokens_after
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) GROUP BY 1""",
    "ingest_full": f"""
WITH RECURSIVE {BLOCKS}, {_STRIPPED}, {_compressed('deduplicated')}, s AS (SELECT doc_id, block_ord, text, {SCORE} AS importance FROM compressed),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, block_ord) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM s),
p AS (SELECT *, CASE WHEN n < 3 OR r <= ceil(n / 3.0) THEN 0 WHEN r <= 2 * ceil(n / 3.0) THEN 2 ELSE 1 END AS part FROM r),
placed AS (SELECT doc_id, block_ord, text, row_number() OVER (PARTITION BY doc_id ORDER BY part, block_ord) AS ord FROM p),
{_redacted('placed')}, sized AS (SELECT *, CAST({estimate('text', 'claude')} AS BIGINT) AS tokens FROM redacted),
{_next_fit('sized', 'doc_id', 'ord', 4000)}
SELECT doc_id, ord, block_ord, CAST(chunk AS BIGINT) AS chunk, sized.tokens AS tokens, md5(text) AS digest FROM sized JOIN fold ON g = doc_id AND r = ord""",
    "pii_all_kinds": f"""
{_PII_VALID}, ranked AS (SELECT *, CASE kind WHEN 'phone' THEN 9 WHEN 'intl_phone' THEN 5 ELSE 10 END AS k FROM found)
SELECT doc_id, line, kind, value FROM ranked f
WHERE NOT EXISTS (SELECT 1 FROM ranked g WHERE g.doc_id = f.doc_id AND g.line = f.line AND g.kind <> f.kind AND (contains(g.value, f.value) OR contains(f.value, g.value)) AND g.k > f.k)""",
    "pii_redact_all": f"""
WITH source AS (SELECT doc_id, text FROM documents), {_redacted('source')}
SELECT doc_id, CAST(len(regexp_extract_all(text, '\\[REDACTED-')) AS INTEGER) AS n_redacted, md5(text) AS digest FROM redacted""",
    "secret_redact": f"{_MASKED} SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY i)) AS digest FROM masked GROUP BY 1",
    "emit_json": f"""
WITH {_FILES} SELECT ord, CAST(CASE WHEN language IS NULL THEN json_object('path', path, 'content', content)
  ELSE json_object('path', path, 'language', language, 'content', content) END AS VARCHAR) AS text FROM f""",
    "semantic_chunks": f"WITH RECURSIVE {_SEMANTIC} SELECT path, tokens, chunk, overlap FROM f",
    "dependency_chunks": f"""
WITH RECURSIVE {_TYPES}, d AS (SELECT t.name AS path, t.parent, length(t.name)::BIGINT AS tokens, coalesce(max(depth), 0) AS level FROM t LEFT JOIN up USING (name) GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (ORDER BY level, path) AS r FROM d),
f(r, path, tokens, chunk, used, inside) AS (
  SELECT r, path, tokens, 0::BIGINT, tokens, [path] FROM n WHERE r = 1
  UNION ALL
  SELECT n.r, n.path, n.tokens, f.chunk + s::INTEGER, CASE WHEN s THEN n.tokens ELSE f.used + n.tokens END, CASE WHEN s THEN [n.path] ELSE list_append(f.inside, n.path) END
  FROM f JOIN n ON n.r = f.r + 1, LATERAL (SELECT f.used + n.tokens > 50 AND NOT coalesce(list_contains(f.inside, n.parent), false) AS s))
SELECT path, tokens, chunk FROM f""",
    "truncated": f"""
WITH p AS (SELECT doc_id, text, unnest(range(1, least(length(text), 1500) + 1)) AS i FROM documents WHERE text <> ''),
over AS (SELECT doc_id, min(i) AS i FROM (SELECT doc_id, i, left(text, i) AS t FROM p) WHERE {estimate('t', 'claude')} > 100 GROUP BY 1),
c AS (SELECT d.doc_id, d.text, CASE WHEN i IS NULL OR {estimate('d.text', 'claude')} <= 100 THEN NULL ELSE left(d.text, i - 1) END AS head FROM documents d LEFT JOIN over USING (doc_id)),
b AS (SELECT *, length(regexp_extract(head, '(?s)^(.*)[ \n]', 1)) AS blank FROM c)
SELECT doc_id, md5(CASE WHEN head IS NULL THEN text WHEN blank > 0 THEN left(head, blank) ELSE head END) AS digest FROM b""",
    "pack_pages": f"""
WITH RECURSIVE {_PATHS}, files AS (
  SELECT path || '#' || page_id AS path, html, 0 AS page_id FROM path JOIN pages USING (page_id)),
sized AS (SELECT path, {_rank_cases()} AS importance, CAST({estimate('html', 'claude')} AS BIGINT) AS t FROM files
  WHERE NOT list_contains(string_split(path, '/'), 'tests') AND NOT starts_with(path, 'tests')),
n AS (SELECT *, row_number() OVER (ORDER BY importance DESC, path) AS r FROM sized),
f(r, total, action, used) AS (
  SELECT r, CASE WHEN t <= 99000 THEN t ELSE 99000 END, CASE WHEN t <= 99000 THEN 'keep' ELSE 'truncate' END, CASE WHEN t <= 99000 THEN t ELSE 99000 END FROM n WHERE r = 1
  UNION ALL
  SELECT n.r, CASE WHEN f.total + t <= 99000 THEN f.total + t WHEN f.total + 100 < 99000 THEN 99000 ELSE f.total END,
         CASE WHEN f.total + t <= 99000 THEN 'keep' WHEN f.total + 100 < 99000 THEN 'truncate' ELSE 'drop' END,
         CASE WHEN f.total + t <= 99000 THEN t WHEN f.total + 100 < 99000 THEN 99000 - f.total ELSE 0 END
  FROM f JOIN n ON n.r = f.r + 1)
SELECT path, importance, t AS tokens, action, CAST(used AS BIGINT) AS used FROM n JOIN f USING (r)""",
}

_NL = "chr(10)"


def text_of(*pieces: str) -> str:
    """SQL for pieces one after the other: literals, and after a ``$`` expressions."""
    return " || ".join(f"({p[1:]})" if p.startswith("$") else q(p).replace("\n", f"' || {_NL} || '") for p in pieces)


_CODE = f"""code AS (
  SELECT *, {text_of('import m', '$q % 25', '.f', '$q', chr(10) + 'import os' + chr(10) * 2 + 'class C', '$p', '(B', '$p % 5', '):' + chr(10) + '    \"\"\"Makes ', '$p',
  '. More.\"\"\"' + chr(10) + '    def run(self, a: int, b=2) -> str:' + chr(10) + '        if a and b:' + chr(10) + '            return helper', '$p',
  '(a)  # call' + chr(10) + '        return \"\"' + chr(10) * 2 + 'def helper', '$p', '(v):' + chr(10) + '    return v' + chr(10))} AS content
  FROM (SELECT p_partkey AS p, p_partkey * 7 % 211 AS q, 'src/m' || (p_partkey % 25) || '/f' || p_partkey || '.py' AS path FROM part)),
link AS (SELECT a.path, 'm' || (a.q % 25) || '.f' || a.q AS source, b.path AS resolved FROM code a LEFT JOIN code b ON b.p = a.q)"""
_FILE_EDGES = "edge AS (SELECT DISTINCT path AS src, resolved AS dst FROM link WHERE resolved IS NOT NULL AND resolved <> path)"
_NAMED = f"""{_SPARSE}, kinds AS (SELECT *, CASE WHEN src % 2 = 0 THEN 'call' ELSE 'reference' END AS edge_type FROM edge),
s AS (SELECT p_partkey AS symbol_id, p_brand || '.py' AS file, p_name AS name, p_size AS start_line FROM part)"""
_SHAPES = [
    "src/a{}/main.py", "node_modules/x{}/a.js", "a/b{}.min.js", "src/tests/t{}.py", "docs/d{}.md", "img/i{}.png", "x{}/__tests__/a.test.ts", "README{}.md",
    "lib/core/c{}/mod.rs", "x/api/routes/r{}.go", "x{}/package.json", "a/utils/u{}.rb", "vendor/v{}/lib/l.c", "cmd/x{}/y.go", "app/examples/e{}.java", "CHANGELOG{}",
]


def _by_shape(values: list) -> str:
    """The value of a part's shape; texts with the part's number."""
    listed = "[" + ", ".join(q(v) if isinstance(v, str) else str(v).lower() for v in values) + "][p_partkey % 16 + 1]"
    return f"replace({listed}, '{{}}', CAST(p_partkey AS VARCHAR))" if isinstance(values[0], str) else listed


def _globbed(globs: list[str]) -> str:
    own = [g.replace("**", "*") for g in globs] + [g[3:].replace("**", "*") for g in globs if g.startswith("**/")]
    return "(" + " OR ".join(f"path GLOB {q(g)}" for g in own) + ")"


_SHAPED = f"shaped AS (SELECT p_partkey, {_by_shape(_SHAPES)} AS path FROM part)"
_MODULES = [
    "a{}.main", "node_modules/x{}/a", "a/b{}.min", "tests.t{}", "docs::d{}", "img::i{}", "x{}/__tests__/a.test", "README{}", "lib::core::c{}", "x/api/routes", "x{}::package",
    "a::utils::u{}", "vendor::v{}::lib::l", "x{}", "app.examples", "CHANGELOG{}",
]
_QUALIFIED = [
    "src::a{}::main", "node_modules::x{}::a", "a::b{}.min", "src::tests::t{}", "docs::d{}.md", "img::i{}.png", "x{}::__tests__::a.test", "README{}.md", "lib::core::c{}::mod",
    "x::api::routes::r{}", "x{}::package.json", "a::utils::u{}", "vendor::v{}::lib::l", "cmd::x{}::y", "app::examples::e{}", "CHANGELOG{}",
]
_DOTTED = [
    "a{}.main", "node_modules.x{}.a", "a.b{}.min", "tests.t{}", "docs.d{}", "img.i{}", "x{}.__tests__.a.test", "README{}", "core.c{}.mod", "x.api.routes.r{}", "x{}.package",
    "a.utils.u{}", "vendor.v{}.lib.l", "cmd.x{}.y", "examples.e{}", "CHANGELOG{}",
]
_REPOSITORY = [
    "src::a{}::main", "node_modules::x{}::a", "a::b{}.min", "src::tests::t{}", "docs::d{}.md", "img::i{}.png", "x{}::__tests__::a.test", "README{}.md", "lib::core::c{}",
    "x::api::routes::r{}", "x{}::package.json", "a::utils::u{}", "vendor::v{}::lib::l.c", "cmd::x{}::y", "app::examples::e{}", "CHANGELOG{}",
]


def _greedy(rows: str, order: str, start: str, budget: int) -> str:
    """Tables n (``rows`` in an order, as r) and f (r, total, kept): what still fits, in order."""
    return f"""n AS (SELECT *, row_number() OVER (ORDER BY {order}) AS r FROM {rows}),
f(r, total, kept) AS (
  SELECT r, CASE WHEN {start} + tokens <= {budget} THEN {start} + tokens ELSE {start} END, {start} + tokens <= {budget} FROM n WHERE r = 1
  UNION ALL
  SELECT n.r, CASE WHEN f.total + n.tokens <= {budget} THEN f.total + n.tokens ELSE f.total END, f.total + n.tokens <= {budget} FROM f JOIN n ON n.r = f.r + 1)"""


_PREAMBLE = "'Use this diff context to understand changes. Start with changed file snippets, then dependent symbols/files/tests. Impact: ' || lv || '.'"
_CONTEXTS = f"""c AS (
  SELECT n_nationkey, n_nationkey AS k, n_name AS n, CASE WHEN n_nationkey % 2 = 0 THEN 'low' ELSE 'high' END AS lv,
         n_nationkey % 3 = 0 AS has_diff, n_nationkey % 5 = 0 AS has_history, n_nationkey % 4 <> 0 AS has_snippet FROM nation)"""


def _context(*pieces: str) -> str:
    """SQL for the text of each context: literals, after ``$`` expressions, after ``?name:`` pieces only where a context has it."""
    out = []
    for p in pieces:
        if p.startswith("?"):
            name, _, body = p[1:].partition(":")
            parts = [f"${x[1:]}" if x.startswith("$") else x for x in body.split("\0")]
            out.append(f"(CASE WHEN has_{name} THEN {text_of(*parts)} ELSE '' END)")
        else:
            out.append(text_of(p))
    return f"WITH {_CONTEXTS} SELECT n_nationkey, {' || '.join(out)} AS text FROM c"


def _cut(rows: str, budget: str, most: int) -> str:
    """Table over (id, i): the first length at which a text (id, text) of ``rows`` has more than ``budget`` tokens."""
    return f"""p AS (SELECT id, text, {budget} AS b, unnest(range(1, least(length(text), {most}) + 1)) AS i FROM {rows}),
over AS (SELECT id, min(i) AS i FROM (SELECT id, i, b, left(text, i) AS t FROM p) WHERE {estimate('t', 'claude')} > b GROUP BY 1)"""


_CHUNK_TEXTS = f"""piece AS (
  SELECT path, 'C' || p AS name, 'class' AS kind, NULL::VARCHAR AS parent, array_to_string(string_split(content, {_NL})[4:9], {_NL}) AS t FROM code
  UNION ALL SELECT path, 'run', 'method', 'C' || p, array_to_string(string_split(content, {_NL})[6:9], {_NL}) FROM code
  UNION ALL SELECT path, 'helper' || p, 'function', NULL, array_to_string(string_split(content, {_NL})[11:12], {_NL}) FROM code)"""
_OLD = "(SELECT p_partkey % 11 AS k, 'f' || p_partkey AS name, p_brand || '.py' AS file FROM part)"
_BREAKING = f"""change AS (
  SELECT name, file, 'removed' AS change, 'critical' AS severity, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM {_OLD} WHERE k = 2
  UNION ALL SELECT name, file, 'return_type_changed', 'high', 'str', 'int' FROM {_OLD} WHERE k = 3
  UNION ALL SELECT name, file, 'parameter_added', 'high', '2', '3' FROM {_OLD} WHERE k = 4
  UNION ALL SELECT name, file, 'parameter_removed', 'high', '2', '1' FROM {_OLD} WHERE k = 5
  UNION ALL SELECT name, file, 'async_changed', 'high', 'sync', 'async' FROM {_OLD} WHERE k = 6
  UNION ALL SELECT name, file, 'parameter_type_changed', 'high', 'a: int', 'a: str' FROM {_OLD} WHERE k = 6
  UNION ALL SELECT name, file, 'parameter_type_changed', 'high', 'b', 'x' FROM {_OLD} WHERE k = 6
  UNION ALL SELECT name, file, 'generic_changed', 'high', '0', '2' FROM {_OLD} WHERE k = 7
  UNION ALL SELECT name, 'moved.py', 'moved', 'medium', file, 'moved.py' FROM {_OLD} WHERE k = 8
  UNION ALL SELECT name, file, 'visibility_reduced', 'critical', '3', '0' FROM {_OLD} WHERE k = 9
  UNION ALL SELECT name, file, 'type_constraint_changed', 'medium', NULL, 'Base' FROM {_OLD} WHERE k = 10)"""

ORACLE |= {
    "breaking_changes": f"WITH {_BREAKING} SELECT * FROM change",
    "breaking_summary": f"""
WITH {_BREAKING} SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
  count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(DISTINCT file) AS files, count(DISTINCT name) AS symbols FROM change""",
    "parsed_symbols": f"""
WITH {_CODE}
SELECT path AS file, 'm' || (q % 25) || '.f' || q AS name, 'import' AS kind, NULL::VARCHAR AS signature, NULL::VARCHAR AS docstring, 1 AS start_line, 1 AS end_line,
       NULL::VARCHAR AS parent, 'public' AS visibility, '' AS calls, NULL::VARCHAR AS extends FROM code
UNION ALL SELECT path, 'os', 'import', NULL, NULL, 2, 2, NULL, 'public', '', NULL FROM code
UNION ALL SELECT path, 'C' || p, 'class', 'class C' || p || '(B' || (p % 5) || ')', 'Makes ' || p || '. More.', 4, 9, NULL, 'public', '', 'B' || (p % 5) FROM code
UNION ALL SELECT path, 'run', 'method', 'def run(self, a: int, b=2) -> str', NULL, 6, 9, 'C' || p, 'public', 'helper' || p, NULL FROM code
UNION ALL SELECT path, 'helper' || p, 'function', 'def helper' || p || '(v)', NULL, 11, 12, NULL, 'public', '', NULL FROM code""",
    "import_links": f"WITH {_CODE} SELECT path, source, resolved, resolved IS NULL AS is_external FROM link UNION ALL SELECT path, 'os', NULL, true FROM code",
    "comment_removal": f"WITH {_CODE} SELECT path, md5(replace(content, '  # call', '')) AS digest FROM code",
    "signature_lines": f"""
WITH {_CODE} SELECT path, 'class C' || p || '(B' || (p % 5) || '):' || {_NL} || '    def run(self, a: int, b=2) -> str:' || {_NL} || 'def helper' || p || '(v):' || {_NL} AS text FROM code""",
    "key_symbols": f"""
WITH {_CODE} SELECT path, {text_of('// class: C', '$p', chr(10) + 'class C', '$p', '(B', '$p % 5', ')' + chr(10) + '// function: helper', '$p', chr(10) + 'def helper', '$p', '(v)' + chr(10))} AS text FROM code""",
    "key_symbols_in_context": f"""
WITH {_CODE}, l AS (SELECT path, p, string_split(content, {_NL}) AS ls FROM code)
SELECT path, {text_of('// class: C', '$p', chr(10), f'$array_to_string(ls[2:6], {_NL})', chr(10) + '// function: helper', '$p', chr(10), f'$array_to_string(ls[9:12], {_NL})', chr(10))} AS text FROM l""",
    "type_signatures": f"""
WITH {_CODE} SELECT path AS file, 'run' AS name, 6 AS start_line, unnest(['return', 'self', 'a', 'b']) AS parameter, unnest(['str', NULL, 'int', NULL]) AS type, unnest([-1, 0, 1, 2]) AS ord FROM code
UNION ALL SELECT path, 'helper' || p, 11, unnest(['return', 'v']), NULL, unnest([-1, 0]) FROM code""",
    "python_complexity": f"""
WITH {_CODE} SELECT path AS file, 'run' AS name, 6 AS start_line, 3 AS cyclomatic, 1 AS nesting, 3 AS parameters, 2 AS returns FROM code
UNION ALL SELECT path, 'helper' || p, 11, 1, 0, 1, 1 FROM code""",
    "branch_counts": f"WITH {_CODE} SELECT path, 3 AS complexity FROM code",
    "text_references": f"WITH {_CODE} SELECT path AS file, 8 AS line, 'helper' || p AS name, 'helper' || p AS symbol_id FROM code",
    "call_sites": f"""
WITH {_CODE} SELECT path AS file, 8 AS line, 'helper3' AS symbol_id, array_to_string(string_split(content, {_NL})[7:9], {_NL}) AS context FROM code WHERE p = 3""",
    "index_files": _pagerank(f"{_CODE}, {_FILE_EDGES}", 30, False, "SELECT path AS node FROM code")
    + f""" SELECT path, 'python' AS language, sha256(content) AS content_hash, 12 AS lines, {estimate('content', 'claude')} AS tokens, round(rank / (SELECT max(rank) FROM r30), 8) AS importance
FROM code JOIN r30 ON node = path""",
    "index_symbols": f"""
WITH {_CODE} SELECT path || ':4:C' || p AS symbol_id, path AS file, 'C' || p AS name, 'class' AS kind, NULL::VARCHAR AS parent_id FROM code
UNION ALL SELECT path || ':6:run', path, 'run', 'method', path || ':4:C' || p FROM code UNION ALL SELECT path || ':11:helper' || p, path, 'helper' || p, 'function', NULL FROM code""",
    "index_edges": f"WITH {_CODE}, {_FILE_EDGES} SELECT src, dst, 'import' AS edge_type FROM edge UNION ALL SELECT path || ':6:run', path || ':11:helper' || p, 'call' FROM code",
    "find_symbol": "SELECT DISTINCT p_brand || '.py' AS file, p_size AS start_line, p_name AS name FROM part WHERE p_name = 'red widget'",
    "callers_of": f"WITH {_NAMED} SELECT * FROM s WHERE symbol_id IN (SELECT src FROM kinds JOIN s ON dst = symbol_id WHERE name = 'red widget')",
    "callees_of": f"WITH {_NAMED} SELECT * FROM s WHERE symbol_id IN (SELECT dst FROM kinds JOIN s ON src = symbol_id WHERE name = 'red widget')",
    "references_of": f"WITH {_NAMED} SELECT DISTINCT src AS symbol_id, edge_type FROM kinds JOIN s ON dst = symbol_id WHERE name = 'red widget'",
    "cycle_paths": """
WITH g AS (SELECT p_partkey AS p FROM part WHERE p_partkey % 5 = 0)
SELECT p || '>' || (p + 1) || '>' || (p + 2) AS cycle FROM g UNION ALL SELECT p || '>' || (p + 1) || '>' || (p + 2) || '>' || (p + 3) || '>' || (p + 4) FROM g""",
    "dependency_stats": f"""
WITH RECURSIVE {_CODE}, {_FILE_EDGES}, reach(a, b) AS (SELECT src, dst FROM edge UNION SELECT r.a, e.dst FROM reach r JOIN edge e ON e.src = r.b),
component AS (SELECT x.a AS node, least(x.a, min(x.b)) AS name FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)
SELECT (SELECT count(*) FROM code) AS files, (SELECT count(*) FROM edge) AS edges, (SELECT count(DISTINCT source) FROM link WHERE resolved IS NULL) + 1 AS external,
       (SELECT count(DISTINCT name) FROM component) AS cycles""",
    "cache_stats": """
SELECT count(*) AS files, CAST(sum(o_custkey) AS BIGINT) AS tokens, CAST(sum(o_orderkey) AS BIGINT) AS bytes,
       CAST(date_diff('second', max(o_orderdate)::TIMESTAMP, TIMESTAMP '2030-01-01 00:00:00') AS BIGINT) AS age_seconds FROM orders""",
    "multi_repo_stats": """
WITH l AS (SELECT p_brand AS repo, count(*) AS links FROM part WHERE p_brand < 'Brand#2' GROUP BY ROLLUP (p_brand)),
s AS (SELECT p_brand AS repo, count(*) AS symbols, count(DISTINCT p_name) AS names FROM part GROUP BY ROLLUP (p_brand))
SELECT s.repo, symbols, names, coalesce(links, 0) AS links FROM s LEFT JOIN l ON s.repo IS NOT DISTINCT FROM l.repo""",
    "lazy_context": f"""
WITH {_CODE}, d0 AS (SELECT path FROM code WHERE path LIKE 'src/m1/%'),
d1 AS (SELECT DISTINCT resolved AS path FROM link JOIN d0 USING (path) WHERE resolved IS NOT NULL AND resolved NOT IN (SELECT path FROM d0)),
d2 AS (SELECT DISTINCT resolved AS path FROM link JOIN d1 USING (path) WHERE resolved IS NOT NULL AND resolved NOT IN (SELECT path FROM d0 UNION SELECT path FROM d1))
SELECT path, 0 AS depth FROM d0 UNION ALL SELECT path, 1 FROM d1 UNION ALL SELECT path, 2 FROM d2""",
    "context_impact": f"""
WITH {_CODE}, {_FILE_EDGES}, d0 AS (SELECT unnest(['src/m3/f3.py', 'src/m7/f7.py']) AS path),
d1 AS (SELECT DISTINCT src AS path FROM edge JOIN d0 ON dst = path WHERE src NOT IN (SELECT path FROM d0)),
d2 AS (SELECT DISTINCT src AS path FROM edge JOIN d1 ON dst = path WHERE src NOT IN (SELECT path FROM d0 UNION SELECT path FROM d1)),
d AS (SELECT path, 0 AS level FROM d0 UNION ALL SELECT path, 1 FROM d1 UNION ALL SELECT path, 2 FROM d2),
t AS (SELECT count(*) FILTER (WHERE level = 1) AS a, count(*) FILTER (WHERE level > 1) AS b FROM d)
SELECT path, level, false AS is_test, CASE WHEN a > 20 OR b > 50 THEN 'critical' WHEN a > 10 OR b > 20 THEN 'high' WHEN a > 3 OR b > 5 THEN 'medium' ELSE 'low' END AS impact FROM d, t""",
    "context_budget": f"""
WITH RECURSIVE x AS (
  SELECT printf('d%08d', doc_id) AS path, CASE WHEN doc_id % 10 = 0 THEN 'changed' WHEN doc_id % 10 < 7 THEN 'dependent' ELSE 'test' END AS role,
         CAST(n_chars % 97 AS DOUBLE) AS relevance, CAST({estimate('text', 'claude')} AS BIGINT) AS tokens FROM documents),
o AS (SELECT *, CASE role WHEN 'dependent' THEN 0 ELSE 1 END AS tier FROM x WHERE role <> 'changed'), s AS (SELECT CAST(sum(tokens) AS BIGINT) AS t FROM x WHERE role = 'changed'),
{_greedy('o', 'tier, relevance DESC, path', '(SELECT t FROM s)', 120_000)}
SELECT * FROM x WHERE role = 'changed' UNION ALL SELECT path, role, relevance, tokens FROM n JOIN f USING (r) WHERE kept""",
    "diff_budget": f"""
WITH RECURSIVE x AS (
  SELECT printf('f%06d', item_id % 13) AS path, CASE WHEN item_id % 3 = 0 THEN 'test' ELSE 'dependent' END AS role, (item_id % 4) / 4.0::DOUBLE AS relevance, CAST(item_id AS INTEGER) AS ord,
         ['changed symbol', 'dependent symbol', 'diff hunk', 'file removed', 'other'][item_id % 5 + 1] AS reason, CAST({estimate('text', 'claude')} AS BIGINT) AS tokens,
         (item_id % 4) / 4.0::DOUBLE + [0.3::DOUBLE, 0.2, 0.1, 0.25, 0.0][item_id % 5 + 1] AS score FROM benchmark),
{_greedy('x', "score DESC, tokens, CASE role WHEN 'dependent' THEN 0 ELSE 1 END, path, ord", '100', 1200)}
SELECT path, role, relevance, ord, reason, tokens FROM n JOIN f USING (r) WHERE kept""",
    "default_ignores": f"""
WITH {_SHAPED} SELECT p_partkey, {_globbed(T.DEFAULT_IGNORES)} AS ignored, {_globbed(T.DEFAULT_IGNORES + T.TEST_IGNORES)} AS without_tests,
  {_globbed(T.DEFAULT_IGNORES + T.DOC_IGNORES)} AS without_docs FROM shaped""",
    "gitignored": f"""
WITH {_SHAPED} SELECT * FROM shaped
WHERE NOT (path LIKE '%.js' OR path LIKE 'docs/%' OR (regexp_matches(path, '(^|/)tests(/|$)') AND NOT regexp_matches(path, '^src/(.*/)?tests/'))
  OR regexp_matches(path, '^x[^/]*/package\\.json(/|$)') OR regexp_matches(path, '^lib/(.*/)?mod\\.rs(/|$)') OR regexp_matches(path, '^vendor/(.*/)?v1[^/]/'))""",
    "path_ranks": f"""
SELECT p_partkey, {_by_shape([-5000, 1000, 1000, 2000, 2500, 1000, 3000, 2500, -4800, 400, -2000, 1000, 200, 1000, 2500, 1000])} AS fast,
       CAST({_by_shape([100, 50, 50, 60, 10, 50, 20, 10, 80, 75, 90, 30, 80, 50, 10, 50])} AS DOUBLE) AS priority FROM part""",
    "test_predicates": "SELECT p_partkey, t AS wide, t AS named, t AS chunked, t AS streamed FROM (SELECT p_partkey, p_partkey % 16 IN (3, 6) AS t FROM part)",
    "module_paths": f"""
SELECT p_partkey, {_by_shape(_MODULES)} AS module, 'r::' || {_by_shape(_QUALIFIED)} || '::P::f' AS qualified, {_by_shape(_DOTTED)} AS dotted, {_by_shape(_REPOSITORY)} AS repository FROM part""",
    "truncated_contents": f"""
WITH RECURSIVE n AS (
  SELECT doc_id, text, CAST({estimate('text', 'claude')} AS BIGINT) AS t, row_number() OVER (ORDER BY n_chars % 7 DESC, doc_id) AS r FROM documents),
f(doc_id, r, total, action, used) AS (
  SELECT doc_id, r, least(t, 29000), CASE WHEN t <= 29000 THEN 'keep' ELSE 'truncate' END, least(t, 29000) FROM n WHERE r = 1
  UNION ALL
  SELECT n.doc_id, n.r, CASE WHEN f.total + t <= 29000 THEN f.total + t WHEN f.total + 100 < 29000 THEN 29000 ELSE f.total END,
         CASE WHEN f.total + t <= 29000 THEN 'keep' WHEN f.total + 100 < 29000 THEN 'truncate' ELSE 'drop' END,
         CASE WHEN f.total + t <= 29000 THEN t WHEN f.total + 100 < 29000 THEN 29000 - f.total ELSE 0 END
  FROM f JOIN n ON n.r = f.r + 1),
x AS (SELECT f.doc_id AS id, text, used FROM f JOIN documents USING (doc_id) WHERE action = 'truncate'), {_cut('x', 'used', 200_000)},
h AS (SELECT id, left(text, i - 1) AS head FROM x JOIN over USING (id)),
done AS (SELECT id, CASE WHEN contains(head, {_NL}) THEN regexp_extract(head, '(?s)^(.*\\n)', 1) ELSE head END || {_NL} || {_NL} || '... [truncated]' AS t FROM h)
SELECT doc_id AS path, action, CAST(used AS BIGINT) AS used, CASE action WHEN 'keep' THEN md5(text) WHEN 'truncate' THEN md5(done.t) END AS digest
FROM f JOIN documents USING (doc_id) LEFT JOIN done ON id = doc_id""",
    "truncated_output": f"""
WITH x AS (SELECT item_id AS id, '<file>' || replace(text, '. ', '.</file>' || {_NL} || '<file>') || '</file>' AS text FROM benchmark), {_cut('x', '30', 400)},
c AS (SELECT x.id, x.text, CASE WHEN {estimate('x.text', 'claude')} <= 30 THEN NULL ELSE left(x.text, i - 1) END AS head FROM x LEFT JOIN over USING (id)),
b AS (SELECT *, length(regexp_extract(head, '(?s)^(.*)[ \\n]', 1)) AS blank FROM c),
h AS (SELECT id, text, CASE WHEN blank > 0 THEN left(head, blank) ELSE head END AS head FROM b),
e AS (SELECT *, regexp_extract(head, '(?s)^(.*</file>)', 1) AS whole FROM h)
SELECT id AS item_id, CASE WHEN head IS NULL THEN text ELSE CASE WHEN strlen(whole) > strlen(head) // 2 THEN whole ELSE head END
  || {_NL} || {_NL} || '<!-- Output truncated to fit token limit -->' || {_NL} END AS text FROM e""",
    "settings_checksum": f"""
WITH {_VERSIONS}, d AS (SELECT sha256(location_key || chr(0) || h) AS x FROM now),
e AS (SELECT count(*) AS entries, sha256({" || '-' || ".join(f"CAST(sum(CAST('0x' || substr(x, {k}, 8) AS BIGINT)) AS VARCHAR)" for k in (1, 9, 17, 25))}) AS c FROM d),
s AS (SELECT sha256('{{"limit":1000,"model":"claude"}}') AS settings) SELECT entries, settings, sha256(settings || c) AS checksum FROM e, s""",
    "audit_chains": "SELECT o_custkey AS log, count(*) AS events, count(*) AS hashes FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1",
    "document_counts": f"""
SELECT doc_id || '.md' AS path, CAST(2 AS BIGINT) AS sections, CAST(2 AS BIGINT) AS blocks, CAST({estimate("'one two'", 'claude')} + {estimate("('three ' || doc_id)", 'claude')} AS BIGINT) AS tokens FROM documents""",
    "markdown_blocks": f"""
WITH n AS (SELECT n_nationkey || '.md' AS path, 'Head ' || n_nationkey AS title, n_name FROM nation)
SELECT path, 'paragraph' AS block_type, 'First ' || n_name || ' line' AS text, title FROM n UNION ALL SELECT path, 'list', 'a' || {_NL} || 'b', title FROM n
UNION ALL SELECT path, 'code', 'select 1', title FROM n UNION ALL SELECT path, 'blockquote', 'said', 'Sub' FROM n""",
    "embed_chunks": f"""
WITH {_CODE}, {_CHUNK_TEXTS} SELECT path AS file, name, kind, parent, 0 AS part, {estimate('t', 'claude')} AS tokens, md5(t) AS digest FROM piece""",
    "map_symbols": f"""
WITH {_SPARSE} SELECT a.p_brand AS src_module, b.p_brand AS dst_module, count(*) AS weight
FROM edge JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE a.p_brand <> b.p_brand GROUP BY ALL""",
    "sample_shares": "SELECT doc_id FROM documents WHERE CAST('0x' || substr(md5('42|' || doc_id), 1, 8) AS BIGINT) < 858993459",
    "diff_json": _context(
        '{"preamble":"', f"${_PREAMBLE}", '","changed_files":[{"path":"', "$n", '.py","language":"python","tokens":', "$k", ',"diff_content":',
        "$CASE WHEN has_diff THEN '\"-a\\n+b\"' ELSE 'null' END", ',"history":[', '?history:{"hash":"ab12","author":"A","date":"2024","message":"say x"}', '],"snippets":[',
        '?snippet:{"start_line":1,"end_line":\0$k\0,"reason":"changed \\"symbol\\"","content":"\0$n\0\\nx"}',
        ']}],"dependent_files":[{"path":"b.py","reason":"imports it","relevance":0.5,"snippets":[]}],"changed_symbols":[{"name":"', "$n",
        '","kind":"function","file":"a.py","line":', "$k", '}],"dependent_symbols":[{"name":"g","kind":"class","file":"b.py","line":', "$k",
        ',"reason":"calls it","relevance":0.7}],"related_tests":[{"path":"t.py","snippets":[{"start_line":1,"end_line":', "$k",
        ',"reason":"changed \\"symbol\\"","content":"', "$n", '\\nx"}]}],"call_chains":["f → ', "$n", '"],"impact":{"level":"', "$lv", '","description":"About ', "$n",
        '","direct_files":', "$k", ',"transitive_files":', "$2 * k", ',"affected_symbols":3,"affected_tests":1},"tokens":', "$10 * k", "}",
    ),
    "diff_markdown": _context(
        "# Diff Context\n\n> ", f"${_PREAMBLE}", "\n\n## Impact Summary\n\n**Level:** ", "$lv", "\n\nAbout ", "$n", "\n\n- Direct files: ", "$k", "\n- Transitive files: ", "$2 * k",
        "\n- Affected symbols: 3\n- Affected tests: 1\n- Total tokens: ", "$10 * k", "\n\n## Changed Files\n\n### `", "$n", ".py`\n\n- Language: python\n- Tokens: ", "$k", "\n\n",
        "?history:**Recent History**\n\n| Commit | Author | Date | Message |\n|--------|--------|------|--------|\n| `ab12` | A | 2024 | say x |\n\n",
        "?diff:```diff\n-a\n+b\n```\n\n", '?snippet:**Snippets**\n\n- changed "symbol" (lines 1-\0$k\0)\n\n```text\n\0$n\0\nx\n```\n\n',
        "## Changed Symbols\n\n| Symbol | Kind | File | Line |\n|--------|------|------|------|\n| `", "$n", "` | function | a.py | ", "$k",
        " |\n\n## Dependent Symbols\n\n| Symbol | Kind | File | Line | Relevance |\n|--------|------|------|------|-----------|\n| `g` | class | b.py | ", "$k",
        " | 0.70 |\n\n## Dependent Files\n\n| File | Reason | Relevance |\n|------|--------|----------|\n| `b.py` | imports it | 0.50 |\n\n## Related Tests\n\n### `t.py`\n\n"
        '- changed "symbol" (lines 1-', "$k", ")\n\n```text\n", "$n", "\nx\n```\n\n## Call Graph\n\n- f → ", "$n", "\n\n",
    ),
    "diff_yaml": _context(
        "# Diff Context\n\npreamble: |\n  ", f"${_PREAMBLE}", "\n\nimpact:\n  level: ", "$lv", '\n  description: "About ', "$n", '"\n  direct_files: ', "$k", "\n  transitive_files: ", "$2 * k",
        "\n  affected_symbols: 3\n  affected_tests: 1\ntotal_tokens: ", "$10 * k", '\n\nchanged_files:\n  - path: "', "$n", '.py"\n    language: python\n    tokens: ', "$k", "\n",
        '?history:    history:\n      - hash: "ab12"\n        author: "A"\n        date: "2024"\n        message: "say x"\n', "?diff:    diff: |\n      -a\n      +b\n",
        '?snippet:    snippets:\n      - start_line: 1\n        end_line: \0$k\0\n        reason: "changed \\"symbol\\""\n        content: |\n          \0$n\0\n          x\n',
        '\nchanged_symbols:\n  - name: "', "$n", '"\n    kind: function\n    file: "a.py"\n    line: ', "$k",
        '\n\ndependent_symbols:\n  - name: "g"\n    kind: class\n    file: "b.py"\n    line: ', "$k", '\n    reason: "calls it"\n    relevance: 0.70\n\ndependent_files:\n'
        '  - path: "b.py"\n    reason: "imports it"\n    relevance: 0.50\n\nrelated_tests:\n  - path: "t.py"\n    snippets:\n      - start_line: 1\n        end_line: ', "$k",
        '\n        reason: "changed \\"symbol\\""\n        content: |\n          ', "$n", '\n          x\n\ncall_chains:\n  - "f → ', "$n", '"\n',
    ),
    "diff_toon": _context(
        "DIFF|", "$lv", "|d", "$k", "t", "$2 * k", "s3T", "$10 * k", "\nPRE|", f"${_PREAMBLE}", "\nFILES:\nF|", "$n", ".py|python|", "$k", "\n", "?history:H|ab12|A|2024|say x\n",
        "?diff:D{\n-a\n+b\n}D\n", '?snippet:N|1|\0$k\0|changed "symbol"\nC{\n\0$n\0\nx\n}C\n', "SYMS:\nS|", "$n", "|function|a.py|", "$k", "\nDEPSYMS:\nS|g|class|b.py|", "$k",
        '|0.7\nDEPS:\nP|b.py|0.5\nTESTS:\nT|t.py\nN|1|', "$k", '|changed "symbol"\nC{\n', "$n", "\nx\n}C\n",
    ),
    "diff_plain": _context(
        "=== DIFF CONTEXT ===\n\n", f"${_PREAMBLE}", "\n\nImpact: ", "$lv", " - About ", "$n", "\nStats: ", "$k", " direct files, ", "$2 * k", " transitive, 3 symbols, 1 tests\nTotal tokens: ",
        "$10 * k", "\n\n--- CHANGED FILES ---\n\n", "$n", ".py (python, ", "$k", " tokens)\n", "?history:Recent history:\n  ab12 (A, 2024) say x\n", "?diff:-a\n+b\n",
        '?snippet:Snippets:\n- changed "symbol" (lines 1-\0$k\0)\n\0$n\0\nx\n', "\n--- CHANGED SYMBOLS ---\n", "$n", " (function) in a.py line ", "$k",
        "\n\n--- DEPENDENT SYMBOLS ---\ng (class) in b.py line ", "$k", " (relevance: 0.70)\n\n--- DEPENDENT FILES ---\nb.py - imports it (relevance: 0.50)\n\n--- RELATED TESTS ---\nt.py\n"
        'Snippets:\n- changed "symbol" (lines 1-', "$k", ")\n", "$n", "\nx\n",
    ),
    "diff_xml": _context(
        '<?xml version="1.0" encoding="UTF-8"?>\n<diff_context>\n  <summary>\n    <preamble>', f"${_PREAMBLE}", '</preamble>\n    <impact level="', "$lv", '">About ', "$n",
        '</impact>\n    <stats files="', "$3 * k", '" symbols="3" tests="1"/>\n  </summary>\n  <changed_files>\n    <file path="', "$n", '.py" language="python" tokens="', "$k", '"',
        "$CASE WHEN has_history OR has_diff OR has_snippet THEN '>' ELSE '/>' END", "\n",
        '?history:      <history>\n        <commit hash="ab12" date="2024" author="A">\n          say x\n        </commit>\n      </history>\n',
        "?diff:      <diff>\n<![CDATA[\n-a\n+b]]>\n      </diff>\n",
        '?snippet:      <snippets>\n        <snippet start="1" end="\0$k\0" reason="changed &quot;symbol&quot;">\n<![CDATA[\n\0$n\0\nx]]>\n        </snippet>\n      </snippets>\n',
        "$CASE WHEN has_history OR has_diff OR has_snippet THEN '    </file>' || chr(10) ELSE '' END",
        '  </changed_files>\n  <changed_symbols>\n    <symbol name="', "$n", '" kind="function" file="a.py" line="', "$k",
        '"/>\n  </changed_symbols>\n  <dependent_symbols>\n    <symbol name="g" kind="class" file="b.py" line="', "$k",
        '" relevance="0.70" reason="calls it"/>\n  </dependent_symbols>\n  <dependent_files>\n    <file path="b.py" reason="imports it" relevance="0.50"/>\n  </dependent_files>\n'
        '  <related_tests>\n    <test path="t.py">\n      <snippets>\n        <snippet start="1" end="', "$k", '" reason="changed &quot;symbol&quot;">\n<![CDATA[\n', "$n",
        "\nx]]>\n        </snippet>\n      </snippets>\n    </test>\n  </related_tests>\n  <call_graph>\n    <chain>f → ", "$n", "</chain>\n  </call_graph>\n</diff_context>\n",
    ),
}

_SNIPPETS = f"""l AS (SELECT path, p, string_split(content, {_NL}) AS ls FROM code),
snippet AS (
  SELECT path AS file, 'C' || p AS name, 'class' AS kind, 4 AS start_line, 2 AS a, 11 AS b, 1.0::DOUBLE * 0.7 + 0.5 * 0.3 AS importance, ls FROM l
  UNION ALL SELECT path, 'run', 'method', 6, 4, 11, 0.5::DOUBLE * 0.7 + 0.5 * 0.3, ls FROM l UNION ALL SELECT path, 'helper' || p, 'function', 11, 9, 12, 0.5::DOUBLE * 0.7 + 0.5 * 0.3, ls FROM l),
sized AS (
  SELECT file, name, start_line, importance, CAST({estimate('t', 'claude')} AS BIGINT) AS tokens
  FROM (SELECT *, '// ' || kind || ': ' || name || ' (lines ' || a || '-' || b || ')' || {_NL} || array_to_string(ls[a:b], {_NL}) AS t FROM snippet))"""

ORACLE |= {
    "within_limits": """
SELECT doc_id, CASE WHEN strlen(text) > 2000 THEN 'file_size' WHEN list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) > 300 THEN 'line_length' END AS reason FROM documents""",
    "file_chunks": "SELECT doc_id AS ord, row_number() OVER (ORDER BY doc_id) - 1 AS chunk FROM documents",
    "symbol_chunks": f"""
WITH RECURSIVE {_CODE}, {_SNIPPETS}, n AS (SELECT *, row_number() OVER (ORDER BY importance DESC, tokens, file, start_line, name) AS r FROM sized),
f(r, chunk, used) AS (
  SELECT r, 0::BIGINT, tokens FROM n WHERE r = 1
  UNION ALL
  SELECT n.r, f.chunk + (f.used + n.tokens > 400)::INTEGER, CASE WHEN f.used + n.tokens > 400 THEN n.tokens ELSE f.used + n.tokens END FROM f JOIN n ON n.r = f.r + 1)
SELECT file, name, tokens, chunk FROM n JOIN f USING (r)""",
    "cross_references": """
WITH s AS (SELECT 'f' || p_partkey AS name, p_brand AS file, CAST(substr(p_brand, 7, 2) AS INTEGER) % 6 AS chunk, 'f' || (p_partkey * 7 % 211) AS call,
                  CASE WHEN p_partkey % 3 = 0 THEN 'f' || (p_partkey % 5) END AS ext FROM part),
u AS (SELECT chunk, call AS name FROM s UNION SELECT chunk, ext FROM s WHERE ext IS NOT NULL),
d AS (SELECT DISTINCT name, file, chunk AS other_chunk FROM s)
SELECT u.chunk, name, other_chunk, file FROM u JOIN d USING (name) WHERE u.chunk <> other_chunk
QUALIFY row_number() OVER (PARTITION BY u.chunk ORDER BY name, other_chunk, file) <= 25""",
    "changed_symbols": """
SELECT DISTINCT p_partkey AS symbol_id FROM part JOIN supplier ON p_brand = 'Brand#' || (s_suppkey % 25 + 1)
WHERE p_partkey % 200 <= s_suppkey * 3 % 200 + 5 AND p_partkey % 200 + p_size >= s_suppkey * 3 % 200""",
    "updated_importance": "SELECT p_type AS file, round((0.5::DOUBLE + avg(p_size / 50.0::DOUBLE)) / 2, 9) AS importance FROM part GROUP BY 1",
    "proto_contracts": """
WITH n AS (SELECT n_name || '.proto' AS path, 'api.n' || n_nationkey AS package, n_nationkey AS k FROM nation)
SELECT path, package, 'service' AS kind, 'S' || k AS name FROM n UNION ALL SELECT path, package, 'rpc', 'Get' || k FROM n
UNION ALL SELECT path, package, 'message', 'A' FROM n UNION ALL SELECT path, package, 'enum', 'E' || k FROM n""",
    "doc_tags": """
SELECT n_nationkey, 'param' AS tag, 'x' AS name, 'the ' || n_name AS text FROM nation UNION ALL SELECT n_nationkey, 'returns', 'a', 'number' FROM nation
UNION ALL SELECT n_nationkey, 'raises', 'ValueError', 'if ' || n_nationkey FROM nation""",
    "base64_runs": "SELECT item_id, text || ' ' || left(repeat('aB3', 50), 50) || '...[BASE64_TRUNCATED] end' AS text FROM benchmark",
    "folder_tokens": f"""
WITH {_SHAPED}, s AS (SELECT string_split(path, '/') AS d, p_partkey % 10 AS tokens FROM shaped),
f AS (SELECT array_to_string(d[1:k], '/') AS folder, tokens FROM (SELECT d, tokens, unnest(range(1, least(len(d) - 1, 3) + 1)) AS k FROM s))
SELECT folder, count(*) AS files, CAST(sum(tokens) AS BIGINT) AS tokens FROM f GROUP BY 1""",
    "window_ranks": """
WITH r AS (SELECT p_partkey, p_brand, p_size::DOUBLE AS score FROM part)
SELECT *, CAST(rank() OVER w AS INTEGER) AS rank, CAST(dense_rank() OVER w AS INTEGER) AS dense_rank, round(percent_rank() OVER w, 9) AS percent_rank, CAST(ntile(4) OVER o AS INTEGER) AS quantile,
       sum(score) OVER (o ROWS UNBOUNDED PRECEDING) AS running, round(avg(score) OVER (o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS around
FROM r WINDOW w AS (PARTITION BY p_brand ORDER BY score DESC), o AS (PARTITION BY p_brand ORDER BY score DESC, p_partkey)""",
    "global_ranks": "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part",
    "exported_symbols": f"WITH {_CODE} SELECT path AS file, 'C' || p AS name, 'class' AS kind FROM code UNION ALL SELECT path, 'helper' || p, 'function' FROM code",
    "limited_call_graph": f"""
WITH {_SPARSE}, n AS (SELECT DISTINCT node FROM (SELECT src AS node FROM edge UNION SELECT dst FROM edge) ORDER BY node LIMIT 150)
SELECT DISTINCT src, dst FROM edge WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) ORDER BY src, dst LIMIT 120""",
    "chunk_headers": """
SELECT n_regionkey, n_nationkey AS chunk, '# Chunk ' || (n_nationkey + 1) || ' of ' || count(*) OVER (PARTITION BY n_regionkey) || ': ' || n_name AS header FROM nation""",
    "type_relatives": f"WITH RECURSIVE {_TYPES} SELECT ancestor AS name, name AS descendant, min(depth) AS depth FROM up GROUP BY 1, 2 HAVING min(depth) <= 2",
    "retrieval_tags": """
SELECT p_partkey, ['async,getter', 'async,parser', 'async,test,auth', 'async,handler', 'async,setter', 'async,constructor'][p_partkey % 6 + 1] || CASE WHEN p_partkey % 2 = 1 THEN ',type' ELSE '' END AS tags FROM part""",
}
