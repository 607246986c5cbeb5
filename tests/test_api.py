"""The one entry, and settings."""

import asyncio

import pytest
from pyspark.sql import functions as F

from sievework import api, config
from tests.test_core import rows

FILES = [
    ("src/app.py", "from src.lib import helper\n\n\ndef main(args):\n    return helper(args)\n"),
    ("src/lib.py", "def helper(v, w=1):\n    secret = 'token = \"abcdefghijklmnopqrstuvwx\"'\n    return v\n\n\ndef unused(v):\n    return v\n"),
    ("src/other.py", "from src.app import main\n\n\ndef run():\n    return main([])\n"), ("tests/test_lib.py", "from src.lib import helper\n\n\ndef test_helper():\n    assert helper(1)\n"),
    ("node_modules/x.py", "x = 1\n"), ("README.md", "Mail me@example.org now\n"),
]


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("code")
    for path, text in FILES:
        (folder / path).parent.mkdir(exist_ok=True)
        (folder / path).write_text(text)
    return api.CodeBase.below(spark, str(folder))


def test_searches(base):
    assert {r.path for r in base.files.collect()} == {p for p, _ in FILES} - {"node_modules/x.py"}
    assert [r["file"] for r in base.find_symbol("helper").collect()] == ["src/lib.py"]
    assert {r.name for r in base.callers("helper").collect()} == {"main", "test_helper"} and {r.name for r in base.callees("run").collect()} == {"main"}
    assert base.transitive_callers("helper").count() == 3 and base.references("main").count() == 1
    assert {(r["file"], r.line) for r in base.call_sites("helper").collect()} == {("src/app.py", 5), ("tests/test_lib.py", 5)}
    assert {r.name for r in base.dead_code().collect()} == {"unused", "run"} and base.cycles().isEmpty()
    assert rows(base.call_graph(100, 1).agg(F.count("*"))) == [(1,)]
    assert {r.name for r in base.exported().collect()} == {"main", "helper", "unused", "run", "test_helper"}


def test_findings_and_packs(base):
    assert [r.path for r in base.personal_data().collect()] == ["README.md"]
    assert [r.path for r in base.secrets().collect()] == ["src/lib.py"]
    packed = {r.path: r.text for r in base.pack("markdown", 10_000).collect()}
    assert set(packed) == {r.path for r in base.files.collect()} and "abcdefghijklmnopqrstuvwx" not in packed["src/lib.py"]
    assert base.pack("xml", 1010).count() < 5
    assert base.tokens().count() == 10 * 5 and base.languages().count() >= 1 and base.licenses().isEmpty()


def test_contexts_and_chunks(spark, base):
    changed = spark.createDataFrame([("src/lib.py",)], "path string")
    found = {r.path: r.role for r in base.changed_context(changed).collect()}
    assert found == {"src/lib.py": "changed", "src/app.py": "dependent", "src/other.py": "dependent", "tests/test_lib.py": "test"}
    assert set(found) == {r.path for r in base.impact(changed).collect()}
    for strategy in api.STRATEGIES:
        assert base.chunks(strategy, 30).agg(F.max("chunk")).first()[0] >= 1
    assert ("src/lib.py", "tests/test_lib.py") in rows(base.tests_of()) and base.embed().count() == 5
    assert base.map()["symbols"].count() >= 3 and base.key_symbols().count() == 5


def test_versions(spark, base):
    other = spark.createDataFrame([("src/lib.py", "python", "def helper(v):\n    return v\n")], "path string, language string, content string")
    changes = {(r.name, r.change) for r in api.CodeBase(other).breaking_changes(base).collect()}
    assert ("helper", "parameter_removed") in changes and ("unused", "removed") in changes


def test_async(base):
    assert asyncio.run(api.later(base.files.count)) == 5


def test_settings(tmp_path):
    (tmp_path / "sievework.toml").write_text('model = "gemini"\nbudget = 5\nexclude = ["a", "b"]\n')
    own = config.settings(str(tmp_path), {"SIEVEWORK_BUDGET": "7", "SIEVEWORK_TESTS": "no", "OTHER": "x"}, form="yaml", model=None)
    assert (own.model, own.budget, own.exclude, own.tests, own.form, own.docs) == ("gemini", 7, ("a", "b"), False, "yaml", True)
    assert config.settings(None, {}) == config.Settings()
    (tmp_path / "t").mkdir()
    (tmp_path / "t/sievework.toml").write_text(config.template())
    assert config.settings(str(tmp_path / "t"), {}) == config.Settings()
    for bad in ({"SIEVEWORK_NOTHING": "1"}, {"SIEVEWORK_DOCS": "perhaps"}, {"SIEVEWORK_BUDGET": "many"}):
        with pytest.raises(ValueError):
            config.settings(None, bad)


def test_paths_stay_inside():
    assert config.inside("/r/", "a/./b/../c") == "/r/a/c"
    for bad in ("../x", "a/../../x", "/etc/passwd"):
        with pytest.raises(ValueError):
            config.inside("/r", bad)
