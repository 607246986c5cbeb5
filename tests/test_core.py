"""Operators on small literal fixtures, and their invariants."""

import io
import json
import random
import string
import subprocess
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.functions import tokens as K
from sievework.operators import chunking, context, corpus, detect, distill, emit, graph, rank, state, transform
from sievework.plans import ingest
from sievework.sources import code, documents, scan
from sievework.streaming import watch


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, column, **values):
    names, row = list(values), tuple(values.values())
    return spark.createDataFrame([row], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'long'}" for n, v in zip(names, row, strict=True))).select(column.alias("x")).first().x


# --- text


@pytest.mark.parametrize("text, expected", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n\n", ["a", "b", ""]), ("\n", [""])])
def test_lines(spark, text, expected):
    assert one(spark, X.lines(F.col("t")), t=text) == expected


def test_empty_lines(spark):
    assert one(spark, X.remove_empty_lines(F.col("t")), t="a\n \n\nb") == "a\nb"
    assert one(spark, X.remove_empty_lines(F.col("t"), True), t="a\n \nb") == "1:a\n3:b"
    assert one(spark, X.remove_empty_lines(F.col("t")), t="1:a\n2: \n3:b") == "a\nb"
    assert one(spark, X.remove_empty_lines(F.col("t"), True), t="1:a\n2: \n3:b") == "1:a\n3:b"


def test_base64(spark):
    run = "A" * 150 + "+" + "B" * 100
    assert one(spark, X.truncate_base64(F.col("t")), t=f"x {run} y") == f"x {run[:50]}...[BASE64_TRUNCATED] y"
    assert one(spark, X.truncate_base64(F.col("t")), t="A" * 250) == "A" * 250
    assert one(spark, X.truncate_base64(F.col("t")), t="data:image/png;base64,AAAA==") == "data:image/png;base64,[BASE64_TRUNCATED]"


@pytest.mark.parametrize("secret, masked", [("", ""), ("12345678", "********"), ("123456789", "12*****89"), ("a" * 40, "aaaa" + "*" * 32 + "aaaa")])
def test_mask(spark, secret, masked):
    assert one(spark, X.mask(F.col("t")), t=secret) == masked


def test_paths_and_globs(spark):
    assert one(spark, X.normalize_path(F.col("t")), t="./a/../b//c/./d") == "b/c/d"
    for pattern, path, hit in (("*.rs", "src/a.rs", True), ("src/**/*.ts", "src/a/b/c.ts", True), ("src/**/*.ts", "lib/a.ts", False), ("a?c", "abc", True)):
        assert one(spark, F.col("t").rlike(X.glob_regex(pattern)), t=path) is hit
    for pattern, path, hit in (("tests", "src/tests/a.py", True), ("src/", "src/a", True), ("", "a", False), ("*.md", "docs/a.md", True), ("test", "latest/a", False)):
        assert one(spark, corpus.excluded_by(F.col("t"), [pattern]), t=path) is hit


def test_normalize_and_nfc(spark):
    assert one(spark, X.normalize_lines(F.col("t")), t="\r\n\na  \r\nb\t\n\n") == "a\nb"
    df = spark.createDataFrame([("e\u0301",), (None,), ("abc",)], "t string").select(X.nfc_udf()("t").alias("x"))
    assert [r.x for r in df.collect()] == ["é", None, "abc"]


def test_identifiers_and_sentences(spark):
    assert one(spark, X.split_identifier(F.col("t")), t="parseHTTPResponse_v2Fast") == ["parse", "HTTP", "Response", "v2", "Fast"]
    assert one(spark, X.first_sentence(F.col("t")), t="One v1.2 here. Two.") == "One v1.2 here."
    assert one(spark, X.ellipsis(F.col("t"), 8), t="123456789") == "12345..."


# --- tokens


def python_estimate(text, model):
    return int(transform.prefix_tokens(text.encode(), model)[-1]) if text else 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=200).filter(lambda t: "\0" not in t and t.isprintable() or t.isascii()), min_size=1, max_size=20))
def test_estimates_agree(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for model in ("claude", "gemini", "cl100k"):
        found = [r.x for r in df.select(K.estimate(F.col("t"), model).alias("x")).collect()]
        assert found == [python_estimate(t, model) for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet=string.printable + "éß漢😀", max_size=400), st.integers(1, 60))
def test_truncation(text, budget):
    cut = transform.truncate(text, budget)
    assert text.startswith(cut)
    assert python_estimate(cut, "claude") <= budget
    assert transform.truncate(cut, budget) == cut


def test_exact_counts(spark):
    names = pytest.importorskip("public_tokenizers")
    count = K.exact_count_udf(names.path("byte_bpe_50k.tiktoken"), names.PATTERN)
    df = spark.createDataFrame([("hello world",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(count("t").alias("x")).collect()] == [2, 0, 0]


# --- detection

SECRETS = {
    "AKIA" + "ABCDEFGH12345678": ("aws_credential", "critical"),
    "ghp_" + "a1B2" * 9: ("github_token", "critical"),
    "xoxb-" + "1234567890-1234567890-" + "a" * 24: ("access_token", "high"),
    "hf_" + "x9" * 17: ("access_token", "high"),
    "postgres://" + "user:pw@host/db": ("connection_string", "high"),
    "AIza" + "b" * 35: ("api_key", "critical"),
}


def test_secrets(spark):
    data = [(i, f"value {s} end") for i, s in enumerate(SECRETS)]
    found = {r.doc_id: (r.kind, r.severity) for r in detect.secret_findings(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found == dict(enumerate(SECRETS.values()))
    skipped = [(1, "# " + data[0][1]), (2, "an example " + data[0][1]), (3, "placeholder " + data[0][1]), (4, data[0][1] + " xxxxx"), (5, None)]
    assert detect.secret_findings(spark.createDataFrame(skipped, "doc_id long, text string")).isEmpty()


def test_anthropic_shaped_keys_match_twice(spark):
    data = [(1, "k " + "sk-ant-" + "a" * 45)]
    assert detect.secret_findings(spark.createDataFrame(data, "doc_id long, text string")).count() == 2


def test_unquoted_values_in_source(spark):
    data = [(1, "a.py", "password = compute_it(now)"), (2, "a.py", 'password = "longsecretvalue"'), (3, "a.env", "password = longsecretvalue")]
    df = spark.createDataFrame(data, "doc_id long, path string, text string")
    assert {r.doc_id for r in detect.secret_findings(df, path="path").collect()} == {2, 3}
    assert {r.doc_id for r in detect.secret_findings(df, path="path", allow=["longsecret"]).collect()} == set()


def test_secret_redaction(spark):
    text = "# " + list(SECRETS)[1] + "\nok"
    out = spark.createDataFrame([(text,), (None,)], "t string").select(detect.redact_secrets_udf()("t").alias("x")).collect()
    assert out[0].x == "# ghp_" + "*" * 32 + "a1B2\nok" and out[1].x is None


PII = {
    "ssn": ("123-45-6789", "000-45-6789"),
    "credit_card": ("4111 1111 1111 1111", "4111 1111 1111 1112"),
    "email": ("a.b+c@example.org", "a@b"),
    "ip_address": ("10.0.255.1", "10.0.256.1"),
    "iban": ("GB82WEST12345698765432", "GB82WEST12345698765433"),
    "uk_nino": ("AB 12 34 56 C", "DB 12 34 56 C"),
    "intl_phone": ("+49 30 1234567", "+49"),
    "ipv6_address": ("2001:db8:0:0:0:ff00:42:8329", "2001:db8"),
    "eu_vat": ("DE123456789", "DE12345678"),
}


def test_pii_kinds(spark):
    good = [(i, f"see {v[0]} now") for i, v in enumerate(PII.values())]
    found = {}
    for r in detect.pii_findings(spark.createDataFrame(good, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, set()).add((r.kind, r.value))
    for i, (kind, (value, _)) in enumerate(PII.items()):
        assert (kind, value) in found[i], kind
    bad = spark.createDataFrame([(i, f"see {v[1]} now") for i, v in enumerate(PII.values())], "doc_id long, text string")
    kinds = list(PII)
    assert all(kinds[r.doc_id] != r.kind for r in detect.pii_findings(bad).collect())


def test_pii_expressions_agree_with_scanner(spark):
    data = [(i, f"a {v[k]} b") for i, v in enumerate(PII.values()) for k in (0, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    by_expression = {(r.doc_id, r.kind, r.value) for r in detect.pii_matches(df, list(PII)).collect()}
    assert {tuple(r[i] for i in (0, 2, 3)) for r in detect.pii_findings(df).collect()} <= by_expression


def test_overlapping_phones(spark):
    df = spark.createDataFrame([(1, "call +1-555-123-4567 today")], "doc_id long, text string")
    assert [r.kind for r in detect.pii_findings(df).collect()] == ["phone"]


def test_pii_redaction(spark):
    text = f"{PII['ssn'][0]} {PII['ssn'][1]} {PII['email'][0]} {PII['iban'][0]}"
    out = spark.createDataFrame([(text,)], "t string").select(detect.redact_pii_udf()("t").alias("x")).first().x
    assert out == "[REDACTED-SSN] 000-45-6789 [REDACTED-EMAIL] [REDACTED-IBAN]"
    again = spark.createDataFrame([(1, out)], "doc_id long, text string")
    assert {r.kind for r in detect.pii_findings(again).collect()} <= {"intl_phone"}


def test_licenses(spark):
    data = [(1, "x\nGNU Affero General Public License"), (2, "MIT License\nmit"), (3, "nothing"), (4, "gplv2"), (5, None)]
    found = {r.doc_id: (r.license, r.line, r.risk) for r in detect.license_files(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found == {1: ("agpl3", 2, "critical"), 2: ("mit", 1, "low"), 4: ("gpl2", 1, "high")}
    heads = spark.createDataFrame([(1, "// SPDX-License-Identifier: LGPL-3.0"), (2, "# Licensed under GPL"), (3, "licensed under gpl")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in detect.license_headers(heads).collect()} == {1: "gpl3", 2: "gpl3"}


# --- distillation


@pytest.mark.parametrize("text, gone", [
    ("", True), ("  ", True), ("- 42 -", True), ("42", True), ("2024", True), ("20240", False), ("page anything", True), ("3 / 10", True), ("/", True),
    ("ok", False), ("All Rights Reserved, me", True), ("a real sentence", False), ("12345 / x", False),
])
def test_worthless(spark, text, gone):
    assert one(spark, distill.is_worthless(F.col("t")), t=text) is gone


@pytest.mark.parametrize("text, expected", [
    ("In order to win, act.", "To win, act."), ("We act in order to win.", "We act to win."), ("It is important to note that cats sleep.", "Cats sleep."),
    ("So it seems that x  y", "So X y"), ("Done. Prior to that", "Done. Before that"), ("in order to in order to go", "To to go"), ("plain", "plain"),
])
def test_compress(spark, text, expected):
    df = spark.createDataFrame([(1, 0, "paragraph", text)], "doc_id long, block_ord int, block_type string, text string")
    assert distill.compress(df).first().text == expected


def test_levels_never_grow(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    blocks = distill.line_blocks(docs)
    counts = [distill.distill(blocks, level).count() for level in distill.LEVELS]
    assert counts == sorted(counts, reverse=True)


def test_titles(spark):
    blocks = spark.createDataFrame([(1, "Key Terms", "paragraph", "x" * 60), (2, "Introduction", "paragraph", "x" * 60), (3, None, "table", "a")], "doc_id long, title string, block_type string, text string")
    found = {r.doc_id: round(r.importance, 3) for r in distill.score_sections(blocks, ["doc_id"], "title").collect()}
    assert found == {1: 0.7, 2: 0.35, 3: 0.9}


# --- folds


def test_pack_and_budget(spark):
    data = [("g", i, t, imp) for i, (t, imp) in enumerate([(3, 1.0), (3, 0.5), (5, 0.5), (9, 0.9), (1, 0.1)])] + [("h", 0, 7, 1.0)]
    df = spark.createDataFrame(data, "g string, ord long, tokens long, importance double")
    assert rows(corpus.pack_chunks(df, ["g"], ["ord"], "tokens", 7, "ord").select("g", "ord", "chunk")) == [("g", 0, 0), ("g", 1, 0), ("g", 2, 1), ("g", 3, 2), ("g", 4, 3), ("h", 0, 0)]
    big = df.withColumn("tokens", F.col("tokens") * 100)
    done = {(r.g, r.ord): (r.action, r.used) for r in corpus.enforce_budget(big, ["g"], "importance", "ord", "tokens", 2400).collect()}
    assert done[("g", 0)] == ("keep", 300) and done[("g", 3)] == ("keep", 900) and done[("g", 1)] == ("truncate", 200)
    assert done[("g", 2)] == ("drop", 0) and done[("g", 4)] == ("drop", 0)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 900), min_size=1, max_size=30), st.integers(1000, 5000))
def test_budget_is_never_exceeded(spark, tokens, budget):
    df = spark.createDataFrame([(0, i, t, float(i % 3)) for i, t in enumerate(tokens)], "g long, ord long, tokens long, importance double")
    assert sum(r.used for r in corpus.enforce_budget(df, ["g"], "importance", "ord", "tokens", budget).collect()) <= max(0, budget - 1000)


# --- graphs


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 2)], "src long, dst long")
    assert abs(sum(r.rank for r in graph.pagerank(edges).collect()) - 1) < 1e-9
    assert max(r.rank for r in graph.file_importance(edges).collect()) == 1.0
    assert graph.map_pagerank(edges).count() == 4


def test_cycles_levels_and_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (6, 6)], "src long, dst long")
    assert rows(graph.cycles(edges)) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    acyclic = spark.createDataFrame([(1, 2), (1, 3), (3, 2), (2, 4)], "src long, dst long")
    assert rows(graph.topological_levels(acyclic)) == [(1, 0), (2, 2), (3, 1), (4, 3)]
    assert rows(graph.topological_levels(edges.filter("src < 3"))) == [(1, None), (2, None), (3, None)]
    assert rows(graph.closure(acyclic).filter("src = 1")) == [(1, 2, 1), (1, 3, 1), (1, 4, 2)]


# --- state


def test_batches_and_chain(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "k long").repartition(5)
    assert rows(state.batches(df, ["k"], 30)) == sorted([(i, i // 30) for i in range(100)], key=repr)
    log = spark.createDataFrame([(1, "", "a"), (2, "a", "b"), (3, "x", "c")], "seq long, prev_hash string, hash string")
    assert [r.seq for r in state.verify_chain(log).collect()] == [3]


# --- documents

MARKDOWN = """---
a: b
---
# Title
Intro line
next
## Part
- one
- two
  more

| h | =x |
|---|---|
| 1 | 2 |

```python
# not a heading
```
> quoted
---
"""


def blocks(found):
    return [(r["title"], r["block_type"], r["text"]) for r in found]


def test_markdown():
    assert blocks(documents.parse_markdown(MARKDOWN)) == [
        ("Title", "paragraph", "Intro line next"), ("Part", "list", "one\ntwo more"), ("Part", "table", "h | '=x\n1 | 2"),
        ("Part", "code", "# not a heading"), ("Part", "blockquote", "quoted"), ("Part", "break", None),
    ]
    assert documents.parse_markdown(MARKDOWN)[1]["breadcrumb"] == "Title > Part"


def test_plain():
    found = documents.parse_plain("Intro\n\nHEAD\n\ntext a\ntext b\n\nUnder\n-----\n1.2 Sub part\n\n* x\n  y\n* z\n")
    assert blocks(found) == [(None, "paragraph", "Intro"), ("HEAD", "paragraph", "text a text b"), ("Under", "empty", None), ("Sub part", "list", "x y\nz")]
    assert (found[-1]["level"], found[-1]["number"]) == (2, "1.2")


def test_html_and_csv():
    found = documents.parse_html("<head><title>t</title></head><body><nav>n</nav><h1>A &amp; B</h1><p>x<br>y<p>z</p><ul><li>1<li>2</ul><table><tr><th>a</th><td>b</td></tr></table><pre>c &lt;</pre><footer>f</footer></body>")
    assert blocks(found) == [("A & B", "paragraph", "x y"), ("A & B", "paragraph", "z"), ("A & B", "list", "1\n2"), ("A & B", "table", "a | b"), ("A & B", "code", "c <")]
    table = json.loads(documents.parse_csv('# c\na;b\n"x;1";=2\nonly\n')[0]["payload"])
    assert table == {"headers": ["a", "b"], "rows": [["x;1", "'=2"], ["only", ""]]}
    assert documents.html_metadata('<title>T</title><meta name="Author" content="M">') == {"title": "T", "author": "M"}


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_and_errors(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    word = office({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>'})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = office({"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {s}><si><t>k</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>'})
    files = [("a.docx", word), ("b.xlsx", book), ("c.docx", b"no zip"), ("d.md", b"# X\ny"), ("e", None)]
    found = documents.parse_documents(spark.createDataFrame(files, "path string, content binary"))
    kinds = {(r.path, r.title, r.block_type, r.text) for r in found.collect()}
    assert {("a.docx", "H", "paragraph", "body"), ("b.xlsx", "S", "table", "k | 5"), ("d.md", "X", "paragraph", "y")} <= kinds
    assert [r.block_type for r in found.filter("path = 'c.docx'").collect()] == ["error"]
    assert rows(documents.document_titles(found)) == [("a.docx", "H"), ("b.xlsx", "S"), ("d.md", "X")]


# --- code

PYTHON = '''import os
from a.b import c

class Base(Root, Mixin):
    """Doc."""
    def run(self, x, *rest):
        if x and rest:
            for y in rest:
                return helper(y)
        return None

def _hidden():
    pass
'''


def test_python_symbols(spark):
    files = spark.createDataFrame([("m.py", "python", PYTHON), ("bad.py", "python", "def ("), ("x.rs", "rust", "pub fn go(a: u8) {\n  call(a);\n}\nstruct S {\n}\n")], "path string, language string, content string")
    found = {(r.file, r.name): r for r in code.parse_symbols(files).collect()}
    run = found[("m.py", "run")]
    assert (run.kind, run.parent, run.start_line, run.end_line, run.calls) == ("method", "Base", 6, 10, ["helper"])
    assert (found[("m.py", "Base")].extends, found[("m.py", "Base")].implements, found[("m.py", "Base")].docstring) == ("Root", ["Mixin"], "Doc.")
    assert found[("m.py", "_hidden")].visibility == "protected"
    assert (found[("x.rs", "go")].visibility, found[("x.rs", "go")].calls, found[("x.rs", "go")].end_line) == ("public", ["call"], 3)
    assert ("x.rs", "S") in found
    assert rows(code.imports(files)) == [("m.py", "a.b"), ("m.py", "os")]
    measures = {r.name: r for r in code.complexity(files).collect()}
    assert (measures["run"].cyclomatic, measures["run"].nesting, measures["run"].parameters, measures["run"].returns) == (4, 2, 3, 2)


def test_import_resolution(spark):
    found = spark.createDataFrame([("src/a.ts", "./b"), ("m.py", "pkg.mod"), ("m.py", "os")], "path string, source string")
    files = spark.createDataFrame([("src/b.ts",), ("src/b.js",), ("pkg/mod.py",)], "path string")
    assert {(r.source, r.resolved, r.is_external) for r in code.resolve_imports(found, files).collect()} == {("./b", "src/b.ts", False), ("pkg.mod", "pkg/mod.py", False), ("os", None, True)}


def test_code_text(spark):
    body = "def f():\n    return 1\n\n    x = 2\n    returned = 3\nelse:\n    y()\n"
    found = code.unreachable(spark.createDataFrame([("f", body)], "path string, content string")).collect()
    assert [(r.line, r.terminator_line, r.snippet) for r in found] == [(4, 2, "x = 2")]
    assert one(spark, code.brace_depth(F.col("t")), t="a{b{c}}{") == 2
    assert one(spark, code.lines_of_code(F.col("t")), t="a\n\n# b\nc // d") == 2
    tags = one(spark, code.doc_tags(F.col("t")), t="Hi\n * @param {int} x the x\n @returns it")
    assert [(t.tag, t.name) for t in tags] == [("param", "x"), ("returns", "it")]


@pytest.mark.parametrize("language, text, expected", [
    ("python", "a = '#' # b\n# c\nd\n", "a = '#'\nd\n"), ("rust", "x /* y */ z\n/* a\nb */ c\nd // e", "x  z\n c\nd\n"), ("html", "<a><!-- b\n--></a>", "<a>\n</a>\n"),
    ("sql", "select 1 -- x", "select 1\n"), ("go", 's := "//" + t', 's := "//" + t\n'),
])
def test_comments(language, text, expected):
    assert transform.remove_comments(text, language) == expected


def test_signatures_and_compression():
    assert transform.signatures("class A:\n  def f(): pass\nx = 1", "python") == "class A:\n  def f(): pass\n"
    assert transform.signatures("\n".join(map(str, range(99))), "python").count("\n") == 49
    assert "repeated 100 times" in transform.semantic_compress("abc " * 100)
    assert transform.semantic_compress("aaaa bbbb\n\n12345 67890 !!!", threshold=0.99) == "aaaa bbbb\n\n12345 67890 !!!"


# --- scan


def test_read_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.bin2").write_bytes(bytes(range(32)) * 10)
    (tmp_path / "node_modules/c.js").write_text("y")
    files = scan.read_files(spark, str(tmp_path))
    assert [(r.path, r.language, r.content) for r in files.collect()] == [("src/a.py", "python", "x = 1\n")]
    assert rows(scan.tree(files)) == [("src", 1, 6)]
    assert scan.listing(files).columns == ["path", "size_bytes", "modified", "language", "lines"]


DIFF = """diff --git a/x b/x
--- a/x
+++ b/x
@@ -1,3 +1,3 @@
 a
-b
+B
 c
@@ -10 +10,2 @@
 k
+l
"""


def test_diff_lines(spark):
    found = scan.diff_lines(spark.createDataFrame([("x", DIFF)], "key string, diff string"))
    assert rows(found.select("hunk", "kind", "old_line", "new_line", "text")) == sorted([
        (1, "context", 1, 1, "a"), (1, "remove", 2, None, "b"), (1, "add", None, 2, "B"), (1, "context", 3, 3, "c"), (2, "context", 10, 10, "k"), (2, "add", None, 11, "l"),
    ], key=repr)


def test_remotes_and_contracts(spark):
    assert tuple(one(spark, scan.remote_parts(F.col("t")), t="https://github.com/o/r.git")) == ("github", "o", "r", None)
    assert tuple(one(spark, scan.remote_parts(F.col("t")), t="gitlab:o/r@dev")) == ("gitlab", "o", "r", "dev")
    assert one(spark, scan.remote_parts(F.col("t")), t="plain/path") is None
    proto = spark.createDataFrame([("a.proto", "package p.v1; // message No\nservice S { rpc Get(A) returns (B); }\nmessage A {}")], "path string, content string")
    assert rows(scan.contracts(proto)) == [("a.proto", "p.v1", "message", "A"), ("a.proto", "p.v1", "rpc", "Get"), ("a.proto", "p.v1", "service", "S")]


def test_git_log(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x.org", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init")
    for k in range(3):
        (tmp_path / f"f{k % 2}").write_text(str(k))
        git("add", ".")
        git("commit", "-m", f"m{k}")
    log = scan.git_log(spark, str(tmp_path), 2)
    assert {(r.message, r.status, r.path) for r in log.collect()} == {("m0", "A", "f0"), ("m1", "A", "f1"), ("m2", "M", "f0")}
    assert {(r.path, r.commits, r.recent) for r in scan.file_history(log).collect()} == {("f0", 2, 2), ("f1", 1, 1)}


# --- chunking and context


def test_chunk_strategies(spark):
    files = spark.createDataFrame([(0, "a/x", 3), (1, "b/y", 4), (2, "a/z", 5), (3, "b/w", 2)], "ord long, path string, tokens long")
    number = lambda df: {r.path: r.chunk for r in df.collect()}
    assert number(chunking.fixed_chunks(files, 7)) == {"a/x": 0, "b/y": 0, "a/z": 1, "b/w": 1}
    assert number(chunking.file_chunks(files)) == {"a/x": 0, "b/y": 1, "a/z": 2, "b/w": 3}
    assert number(chunking.module_chunks(files, 7)) == {"a/x": 0, "a/z": 1, "b/w": 0, "b/y": 0}
    assert number(chunking.semantic_chunks(files, 12)) == {"a/x": 0, "a/z": 0, "b/w": 1, "b/y": 1}
    imports = spark.createDataFrame([("a/x", "b/y")], "path string, resolved string")
    assert number(chunking.dependency_chunks(files, imports, 100)) == dict.fromkeys(["a/x", "b/y", "a/z", "b/w"], 0)
    neighbours = chunking.with_neighbours(spark.createDataFrame([(0, "p"), (1, "q")], "chunk long, focus string")).orderBy("chunk").collect()
    assert [(r.total, r.previous, r.next) for r in neighbours] == [(2, None, "Next: Chunk 2"), (2, "Previous: p", None)]


def test_symbol_chunks(spark):
    files = spark.createDataFrame([("m.py", "python", PYTHON, 0.5)], "path string, language string, content string, importance double")
    symbols = code.parse_symbols(files).withColumn("importance", F.lit(0.5))
    snippets = chunking.symbol_snippets(symbols, files)
    text = {r.name: r.text for r in snippets.collect()}
    assert text["_hidden"].startswith("// function: _hidden (lines 10-13)\n        return None\n\ndef _hidden")
    assert chunking.symbol_chunks(snippets, 10_000).select("chunk").distinct().count() == 1
    placed = spark.createDataFrame([("a", 0), ("b", 1)], "path string, chunk long")
    two = spark.createDataFrame([("a", "f", ["g"], None, None), ("b", "g", None, "f", ["h"])], "file string, name string, calls array<string>, extends string, implements array<string>")
    assert rows(chunking.cross_references(two, placed)) == [(0, "g", 1, "b"), (1, "f", 0, "a")]


def test_split_long(spark):
    text = "\n".join(f"line number {i} with words" for i in range(50)) + "\n" + "y" * 3000
    parts = chunking.split_long(spark.createDataFrame([(1, text), (2, None)], "k long, t string"), "k", "t", 60).collect()
    assert all(python_estimate(p.t, "claude") <= 60 for p in parts) and len(parts) > 10
    assert {p.k for p in parts} == {1}


def test_changes(spark):
    cases = [("deleted", None, None, "deletion"), ("modified", "+fn x() {", None, "signature"), ("modified", "-class A", None, "type_definition"), ("modified", "+import x", None, "import"), ("modified", "+# a\n-# b\n c", None, "documentation"), ("modified", "+x = 1", "class", "type_definition"), ("modified", None, "function", "implementation")]
    for change, diff, kind, expected in cases:
        assert one(spark, context.classify_change(F.col("c"), F.col("d"), F.col("k")), c=change, d=diff, k=kind) == expected
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "src long, dst long")
    symbols = spark.createDataFrame([(1, "a.py"), (2, "b.py"), (3, "test_c.py"), (4, "d.py")], "symbol_id long, file string")
    found = context.expand_context(spark.createDataFrame([(1,)], "symbol_id long"), edges, symbols, 2)
    assert rows(found) == [(1, 0, False, 1.0), (2, 1, False, 0.7), (3, 2, True, 0.4)]


def test_types(spark):
    types = spark.createDataFrame([("C", "B"), ("B", "A"), ("A", None), ("D", "B")], "name string, parent string")
    assert rows(context.ancestors(types)) == [("B", "A", 1), ("C", "A", 2), ("C", "B", 1), ("D", "A", 2), ("D", "B", 1)]
    assert rows(context.hierarchy_depth(types)) == [("A", 0), ("B", 1), ("C", 2), ("D", 2)]
    assert tuple(context.common_ancestor(types, "C", "D").first()) == ("B", 1)
    assert rows(rank.type_roots(types)) == [("A",)] and rows(rank.type_leaves(types)) == [("C",), ("D",)]


def test_embed_relations(spark):
    parts = spark.createDataFrame([(1, "f", "Outer", None, 1, 50), (2, "f", "Outer", None, 60, 70), (3, "f", "m", "Outer", 5, 9), (4, "f", "n", "Outer", 90, 95)], "id long, file string, name string, parent string, start_line int, end_line int")
    assert rows(context.link_parents(parts)) == [(3, 1), (4, 2)]
    calls = spark.createDataFrame([(1, "a", "f"), (1, "a", "g"), (1, "a", "h")], "caller_id long, file string, name string")
    symbols = spark.createDataFrame([(10, "a", "f"), (11, "b", "f"), (12, "b", "g"), (13, "b", "h"), (14, "b", "h")], "symbol_id long, file string, name string")
    resolved = context.resolve_unique(calls, symbols, spark.createDataFrame([("a", "b")], "file string, imported string"))
    assert rows(resolved) == [(1, "f", 10), (1, "g", 12), (1, "h", None)]
    assert rows(context.called_by(resolved).select("symbol_id", "n")) == [(10, 1), (12, 1)]
    aliases = spark.createDataFrame([("b", "r", "f", 1, 2, "h", "B", ["x"], 5), ("a", "r", "f", 1, 2, "h", "A", ["y", "x"], 4)], "id string, repo string, file string, start_line int, end_line int, full_hash string, name string, tags array<string>, tokens int")
    merged = context.merge_aliases(aliases).first()
    assert (merged.id, merged.name, merged.tags, merged.tokens, merged.aliases) == ("a", "A", ["x", "y"], 5, ["a", "b"])
    uses = spark.createDataFrame([("r2", 2, "f", "call"), ("r1", 1, "z", "call")], "repo string, repo_ord int, name string, kind string")
    known = spark.createDataFrame([("r1", 1, "f"), ("r2", 2, "z")], "repo string, repo_ord int, name string")
    assert rows(context.cross_repo_links(uses, known)) == [("r2", "f", "call", "r1")]


# --- output, plans, streams


def test_formats(spark):
    files = spark.createDataFrame([(0, "a<b>.py", "python", "x = '```'\n]]>"), (1, "e", None, None)], "ord long, path string, language string, content string")
    for form in emit.FORMATS:
        assert emit.emit(files, form).filter("text IS NOT NULL").count() == 2
    assert json.loads(emit.emit(files, "json").orderBy("ord").first().text)["content"] == "x = '```'\n]]>"
    assert emit.emit(files, "markdown").orderBy("ord").first().text.count("````") == 2
    assert "vector(3)" in emit.pgvector_schema("t", 3)
    with pytest.raises(ValueError):
        emit.pgvector_schema("t", 1)


def test_pack_plan(spark):
    data = [(f"src/f{i}.py", "word " * 300) for i in range(10)] + [("tests/t.py", "x"), ("main.py", "y")]
    done = ingest.pack(spark.createDataFrame(data, "path string, content string"), 2500, exclude=["tests"])
    assert done.count() == 11 and done.agg(F.sum("used")).first()[0] <= 1500
    assert done.filter("path = 'main.py'").first().action == "keep"


def test_streaming(spark, tmp_path):
    source, manifest = str(tmp_path / "in"), str(tmp_path / "manifest")
    seen = []
    for texts in ([(1, "a"), (2, "b")], [(2, "B"), (3, "c"), (1, "a")]):
        spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        stream = watch.watch_documents(spark, source, "doc_id long, text string")
        query = watch.keep_manifest(stream, manifest, str(tmp_path / "cp"), lambda diff, n: seen.append(sorted((r.location_key, r.status) for r in diff.collect())))
        query.awaitTermination()
    assert seen == [[("1", "added"), ("2", "added")], [("2", "modified"), ("3", "added")]]
    assert spark.read.parquet(f"{manifest}/v=1").count() == 3


def test_stream_windows(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql("SELECT 'a' AS k, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 'a', timestamp'2024-01-01 00:00:00.2' UNION ALL SELECT 'a', timestamp'2024-01-01 01:00:00'").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("k string, ts timestamp").parquet(path)
    query = watch.debounced(stream, "k", "ts").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.n for r in spark.table("bursts").collect()] == [2]
    docs = stream.withColumn("text", F.lit("same"))
    query = watch.first_seen(docs, "ts").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("firsts").count() == 1 and watch.progress(query)


def test_random_text_survives(spark):
    rng = random.Random(0)
    data = [(i, "".join(chr(rng.choice([rng.randrange(32, 127), 10, 233, 0x4E2D, 0x1F600])) for _ in range(300))) for i in range(40)] + [(99, None), (100, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for found in (detect.secret_findings(docs), detect.pii_findings(docs), detect.license_files(docs), ingest.ingest(docs)):
        found.count()


def test_places(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(50)], "k long, s long").repartition(4)
    ranked = sorted((r.rank, r.k) for r in rank.rank_all(df, "s", "k").collect())
    assert [k for _, k in ranked] == sorted(range(50), key=lambda k: (-(k % 4), k)) and [r for r, _ in ranked] == list(range(1, 51))
