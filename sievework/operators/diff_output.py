"""The context of a change as text, in six formats.

A context is one row, as its budget bounds it:

* level, description, direct_files, transitive_files, affected_symbols, affected_tests, total_tokens
* changed_files: (path, language, tokens, diff_content, history (hash, author, date, message), snippets)
* changed_symbols: (name, kind, file, line); dependent_symbols also reason, relevance
* dependent_files: (path, reason, relevance, snippets); related_tests: (path, snippets)
* call_chains: arrays of names; snippets: (start_line, end_line, reason, content)

Each format is a set of templates over these; all of it is expressions, so many
contexts are formatted in parallel.
"""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import escape_xml, lines

_SNIPPETS = "array<struct<start_line:int,end_line:int,reason:string,content:string>>"
#: Columns of a context.
CONTEXT = (
    "level string, description string, direct_files int, transitive_files int, affected_symbols int, affected_tests int, total_tokens int, "
    f"changed_files array<struct<path:string,language:string,tokens:int,diff_content:string,history:array<struct<hash:string,author:string,date:string,message:string>>,snippets:{_SNIPPETS}>>, "
    "changed_symbols array<struct<name:string,kind:string,file:string,line:int>>, "
    "dependent_symbols array<struct<name:string,kind:string,file:string,line:int,reason:string,relevance:double>>, "
    f"dependent_files array<struct<path:string,reason:string,relevance:double,snippets:{_SNIPPETS}>>, "
    f"related_tests array<struct<path:string,snippets:{_SNIPPETS}>>, call_chains array<array<string>>"
)
PREAMBLE = "Use this diff context to understand changes. Start with changed file snippets, then dependent symbols/files/tests. Impact: {level}."


def fill(template: str, value: Callable[[str], Column]) -> Column:
    """A template's text with the fields of a row: ``{name}``, ``{name:q}`` with escaped quotes, ``{name:x}`` as XML, ``{name:2}`` with 2 decimals."""
    parts = []
    for text, name, form, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is None:
            continue
        field = value(name)
        if form == "q":
            field = F.replace(field.cast("string"), F.lit('"'), F.lit('\\"'))
        elif form == "x":
            field = escape_xml(field.cast("string"))
        elif form:
            field = F.format_string(f"%.{form}f", field.cast("double"))
        parts.append(F.coalesce(field.cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def _each(rows: Column, made: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.array_join(F.transform(rows, made), ""), F.lit(""))


def _fields(struct: Column) -> Callable[[str], Column]:
    return lambda name: struct[name]


def _ended(text: Column) -> Column:
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def _indented(text: Column, blanks: int) -> Column:
    return _each(lines(text), lambda line: F.concat(F.lit(" " * blanks), line, F.lit("\n")))


def _some(rows: Column, text: Column) -> Column:
    """``text`` if there are any rows."""
    return F.when(F.size(rows) > 0, text).otherwise(F.lit(""))


def _listed(name: str, template: str, head: str = "", end: str = "") -> Column:
    rows = F.col(name)
    return _some(rows, F.concat(F.lit(head), _each(rows, lambda r: fill(template, _fields(r))), F.lit(end)))


def _chains(template: str, head: str, end: str = "") -> Column:
    rows = F.col("call_chains")
    return _some(rows, F.concat(F.lit(head), _each(rows, lambda c: fill(template, lambda _: F.array_join(c, " → "))), F.lit(end)))


def _head(template: str) -> Column:
    return fill(template, lambda name: fill(PREAMBLE, F.col) if name == "preamble" else F.col(name))


def _markdown() -> Column:
    snippet = lambda s: F.concat(fill("- {reason} (lines {start_line}-{end_line})\n\n```text\n", _fields(s)), _ended(s["content"]), F.lit("```\n\n"))

    def file(f: Column) -> Column:
        history = F.concat(
            F.lit("**Recent History**\n\n| Commit | Author | Date | Message |\n|--------|--------|------|--------|\n"),
            _each(f["history"], lambda h: fill("| `{hash}` | {author} | {date} | {message} |\n", _fields(h))), F.lit("\n"),
        )
        diff = F.concat(F.lit("```diff\n"), _ended(f["diff_content"]), F.lit("```\n\n"))
        return F.concat(
            fill("### `{path}`\n\n- Language: {language}\n- Tokens: {tokens}\n\n", _fields(f)), _some(f["history"], history), F.coalesce(diff, F.lit("")),
            _some(f["snippets"], F.concat(F.lit("**Snippets**\n\n"), _each(f["snippets"], snippet))),
        )

    own = lambda f: _some(f["snippets"], F.concat(fill("### `{path}` Snippets\n\n", _fields(f)), _each(f["snippets"], snippet)))
    test = lambda f: F.concat(
        fill("### `{path}`\n\n", _fields(f)), F.when(F.size(f["snippets"]) > 0, _each(f["snippets"], snippet)).otherwise("- No focused snippets selected\n\n")
    )
    return F.concat(
        _head(
            "# Diff Context\n\n> {preamble}\n\n## Impact Summary\n\n**Level:** {level}\n\n{description}\n\n- Direct files: {direct_files}\n- Transitive files: "
            "{transitive_files}\n- Affected symbols: {affected_symbols}\n- Affected tests: {affected_tests}\n- Total tokens: {total_tokens}\n\n## Changed Files\n\n"
        ),
        _each(F.col("changed_files"), file),
        _listed("changed_symbols", "| `{name}` | {kind} | {file} | {line} |\n", "## Changed Symbols\n\n| Symbol | Kind | File | Line |\n|--------|------|------|------|\n", "\n"),
        _listed(
            "dependent_symbols", "| `{name}` | {kind} | {file} | {line} | {relevance:2} |\n",
            "## Dependent Symbols\n\n| Symbol | Kind | File | Line | Relevance |\n|--------|------|------|------|-----------|\n", "\n",
        ),
        _listed("dependent_files", "| `{path}` | {reason} | {relevance:2} |\n", "## Dependent Files\n\n| File | Reason | Relevance |\n|------|--------|----------|\n", "\n"),
        _each(F.col("dependent_files"), own),
        _some(F.col("related_tests"), F.concat(F.lit("## Related Tests\n\n"), _each(F.col("related_tests"), test))),
        _chains("- {chain}\n", "## Call Graph\n\n", "\n"),
    )


def _yaml() -> Column:
    snippet = lambda s: F.concat(
        fill('      - start_line: {start_line}\n        end_line: {end_line}\n        reason: "{reason:q}"\n        content: |\n', _fields(s)), _indented(s["content"], 10)
    )
    snippets = lambda f: _some(f["snippets"], F.concat(F.lit("    snippets:\n"), _each(f["snippets"], snippet)))
    commit = '      - hash: "{hash}"\n        author: "{author}"\n        date: "{date}"\n        message: "{message:q}"\n'

    def file(f: Column) -> Column:
        history = F.concat(F.lit("    history:\n"), _each(f["history"], lambda h: fill(commit, _fields(h))))
        diff = F.concat(F.lit("    diff: |\n"), _indented(f["diff_content"], 6))
        about = fill('  - path: "{path}"\n    language: {language}\n    tokens: {tokens}\n', _fields(f))
        return F.concat(about, _some(f["history"], history), F.when(f["diff_content"].isNotNull(), diff).otherwise(""), snippets(f))

    def section(name: str, head: str, template: str) -> Column:
        return _some(F.col(name), F.concat(F.lit(head), _each(F.col(name), lambda f: F.concat(fill(template, _fields(f)), snippets(f)))))

    symbol = '  - name: "{name}"\n    kind: {kind}\n    file: "{file}"\n    line: {line}\n'
    return F.concat(
        _head(
            "# Diff Context\n\npreamble: |\n  {preamble}\n\nimpact:\n  level: {level}\n  description: \"{description:q}\"\n  direct_files: {direct_files}\n  transitive_files: "
            "{transitive_files}\n  affected_symbols: {affected_symbols}\n  affected_tests: {affected_tests}\ntotal_tokens: {total_tokens}\n\nchanged_files:\n"
        ),
        _each(F.col("changed_files"), file),
        _listed("changed_symbols", symbol, "\nchanged_symbols:\n"),
        _listed("dependent_symbols", symbol + '    reason: "{reason:q}"\n    relevance: {relevance:2}\n', "\ndependent_symbols:\n"),
        section("dependent_files", "\ndependent_files:\n", '  - path: "{path}"\n    reason: "{reason}"\n    relevance: {relevance:2}\n'),
        section("related_tests", "\nrelated_tests:\n", '  - path: "{path}"\n'),
        _chains('  - "{chain}"\n', "\ncall_chains:\n"),
    )


def _toon() -> Column:
    snippet = lambda s: F.concat(fill("N|{start_line}|{end_line}|{reason}\nC{{\n", _fields(s)), _ended(s["content"]), F.lit("}C\n"))

    def file(f: Column) -> Column:
        diff = F.concat(F.lit("D{\n"), _ended(f["diff_content"]), F.lit("}D\n"))
        history = _each(f["history"], lambda h: fill("H|{hash}|{author}|{date}|{message}\n", _fields(h)))
        return F.concat(fill("F|{path}|{language}|{tokens}\n", _fields(f)), history, F.coalesce(diff, F.lit("")), _each(f["snippets"], snippet))

    def section(name: str, head: str, template: str) -> Column:
        return _some(F.col(name), F.concat(F.lit(head), _each(F.col(name), lambda f: F.concat(fill(template, _fields(f)), _each(f["snippets"], snippet)))))

    return F.concat(
        _head("DIFF|{level}|d{direct_files}t{transitive_files}s{affected_symbols}T{total_tokens}\nPRE|{preamble}\nFILES:\n"),
        _each(F.col("changed_files"), file),
        _listed("changed_symbols", "S|{name}|{kind}|{file}|{line}\n", "SYMS:\n"),
        _listed("dependent_symbols", "S|{name}|{kind}|{file}|{line}|{relevance:1}\n", "DEPSYMS:\n"),
        section("dependent_files", "DEPS:\n", "P|{path}|{relevance:1}\n"),
        section("related_tests", "TESTS:\n", "T|{path}\n"),
    )


def _plain() -> Column:
    snippet = lambda s: F.concat(fill("- {reason} (lines {start_line}-{end_line})\n", _fields(s)), _ended(s["content"]))
    snippets = lambda f: _some(f["snippets"], F.concat(F.lit("Snippets:\n"), _each(f["snippets"], snippet)))

    def file(f: Column) -> Column:
        history = F.concat(F.lit("Recent history:\n"), _each(f["history"], lambda h: fill("  {hash} ({author}, {date}) {message}\n", _fields(h))))
        about = fill("\n{path} ({language}, {tokens} tokens)\n", _fields(f))
        return F.concat(about, _some(f["history"], history), F.coalesce(_ended(f["diff_content"]), F.lit("")), snippets(f))

    def section(name: str, head: str, template: str) -> Column:
        return _some(F.col(name), F.concat(F.lit(head), _each(F.col(name), lambda f: F.concat(fill(template, _fields(f)), snippets(f)))))

    return F.concat(
        _head(
            "=== DIFF CONTEXT ===\n\n{preamble}\n\nImpact: {level} - {description}\nStats: {direct_files} direct files, {transitive_files} transitive, "
            "{affected_symbols} symbols, {affected_tests} tests\nTotal tokens: {total_tokens}\n\n--- CHANGED FILES ---\n"
        ),
        _each(F.col("changed_files"), file),
        _listed("changed_symbols", "{name} ({kind}) in {file} line {line}\n", "\n--- CHANGED SYMBOLS ---\n"),
        _listed("dependent_symbols", "{name} ({kind}) in {file} line {line} (relevance: {relevance:2})\n", "\n--- DEPENDENT SYMBOLS ---\n"),
        section("dependent_files", "\n--- DEPENDENT FILES ---\n", "{path} - {reason} (relevance: {relevance:2})\n"),
        section("related_tests", "\n--- RELATED TESTS ---\n", "{path}\n"),
    )


def _xml() -> Column:
    cdata = lambda text: F.concat(F.lit("\n<![CDATA[\n"), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>\n"))
    snippet = lambda s: F.concat(
        fill('        <snippet start="{start_line}" end="{end_line}" reason="{reason:x}">', _fields(s)), cdata(s["content"]), F.lit("        </snippet>\n")
    )
    snippets = lambda f: _some(f["snippets"], F.concat(F.lit("      <snippets>\n"), _each(f["snippets"], snippet), F.lit("      </snippets>\n")))

    def element(start: str, f: Column, inside: Column, tag: str) -> Column:
        empty = inside == ""
        return F.concat(fill(start, _fields(f)), F.when(empty, "/>\n").otherwise(F.concat(F.lit(">\n"), inside, F.lit(f"    </{tag}>\n"))))

    def file(f: Column) -> Column:
        commit = '        <commit hash="{hash:x}" date="{date:x}" author="{author:x}">\n          {message:x}\n        </commit>\n'
        history = F.concat(F.lit("      <history>\n"), _each(f["history"], lambda h: fill(commit, _fields(h))), F.lit("      </history>\n"))
        diff = F.concat(F.lit("      <diff>"), cdata(f["diff_content"]), F.lit("      </diff>\n"))
        inside = F.concat(_some(f["history"], history), F.coalesce(diff, F.lit("")), snippets(f))
        return element('    <file path="{path:x}" language="{language:x}" tokens="{tokens}"', f, inside, "file")

    def section(name: str, start: str, tag: str) -> Column:
        return _some(F.col(name), F.concat(F.lit(f"  <{name}>\n"), _each(F.col(name), lambda f: element(start, f, snippets(f), tag)), F.lit(f"  </{name}>\n")))

    symbol = '    <symbol name="{name:x}" kind="{kind}" file="{file:x}" line="{line}"'
    files = (F.col("direct_files") + F.col("transitive_files")).cast("string")
    return F.concat(
        _head('<?xml version="1.0" encoding="UTF-8"?>\n<diff_context>\n  <summary>\n    <preamble>{preamble:x}</preamble>\n    <impact level="{level}">{description:x}</impact>\n'),
        F.lit('    <stats files="'), files, _head('" symbols="{affected_symbols}" tests="{affected_tests}"/>\n  </summary>\n  <changed_files>\n'),
        _each(F.col("changed_files"), file), F.lit("  </changed_files>\n"),
        _listed("changed_symbols", symbol + "/>\n", "  <changed_symbols>\n", "  </changed_symbols>\n"),
        _listed("dependent_symbols", symbol + ' relevance="{relevance:2}" reason="{reason:x}"/>\n', "  <dependent_symbols>\n", "  </dependent_symbols>\n"),
        section("dependent_files", '    <file path="{path:x}" reason="{reason:x}" relevance="{relevance:2}"', "file"),
        section("related_tests", '    <test path="{path:x}"', "test"),
        _chains("    <chain>{chain:x}</chain>\n", "  <call_graph>\n", "  </call_graph>\n"), F.lit("</diff_context>\n"),
    )


def _json() -> Column:
    impact = F.struct(*[F.col(n) for n in ("level", "description", "direct_files", "transitive_files", "affected_symbols", "affected_tests")])
    names = ["changed_files", "dependent_files", "changed_symbols", "dependent_symbols", "related_tests"]
    chains = F.transform("call_chains", lambda c: F.array_join(c, " → ")).alias("call_chains")
    whole = F.struct(fill(PREAMBLE, F.col).alias("preamble"), *names, chains, impact.alias("impact"), F.col("total_tokens").alias("tokens"))
    return F.to_json(whole, {"ignoreNullFields": "false"})


FORMATS = {"json": _json, "markdown": _markdown, "yaml": _yaml, "toon": _toon, "plain": _plain, "xml": _xml}


def format_context(contexts: DataFrame, form: str) -> DataFrame:
    """``contexts`` (see above, and any further columns) with ``text`` in a format; null lists are empty."""
    lists = {n: F.coalesce(n, F.array().cast(contexts.schema[n].dataType)) for n in ("changed_files", "changed_symbols", "dependent_symbols", "dependent_files", "related_tests", "call_chains")}
    return contexts.withColumns(lists).withColumn("text", FORMATS[form]())
