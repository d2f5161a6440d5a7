import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from graphweight import cli, errors, incremental, report
from graphweight.extract.ecmascript import ecmascript_imports
from graphweight.extract.python_imports import python_imports
from graphweight.functions import scalar as X
from graphweight.functions import stats as M
from graphweight.operators import diff as D
from graphweight.project import checked_entry, load
from graphweight.resolve.node_paths import package_targets
from graphweight.resolve.python_paths import SearchPath, added_folders, pth_folders
from graphweight.session import Session
from graphweight.sources.git_tree import classify
from graphweight.streaming.watch import Watch


@pytest.mark.parametrize(
    ("source", "want", "hidden"),
    [
        ("import a from 'a'; import 'b'; import {type T} from 'c'; import {type T, u} from 'd'; import type {V} from 'e'", [("a", "static"), ("b", "static"), ("c", "type_only"), ("d", "static"), ("e", "type_only")], 0),
        ("export * from 'a'; export {type A} from 'b'; export type {B} from 'c'; export {x} ; export * as n from 'd'", [("a", "static"), ("b", "type_only"), ("c", "type_only"), ("d", "static")], 0),
        ("const a = await import('a'); import(`b`); import(c); function f() { return require('d') } require.resolve('e'); require('f' + g)", [("a", "dynamic"), ("d", "static")], 3),
        ("// import 'a'\n/* require('b') */ const s = \"import 'c'\"; const r = /require('d')/; const t = `${require('e')} import 'f'`", [("e", "static")], 0),
        ("x = a / b; y = require('z') / 2; <p>Don't</p>; import q from \"q\"", [("z", "static"), ("q", "static")], 0),
        ("import type from 'a'; import type, {B} from 'b'; import D, * as E from 'c'; o.require('no'); import.meta.url", [("a", "static"), ("b", "static"), ("c", "static")], 0),
        ("class A { m() { return require('k') } }", [("k", "static")], 0),
        ("const a = { import: 1, require }; export const b = 2; export default function () {}", [], 0),
    ],
)
def test_ecmascript(source, want, hidden):
    assert ecmascript_imports(source) == (want, hidden, None)


@pytest.mark.parametrize(
    ("source", "want", "hidden"),
    [
        ("import a.b, c as d\nfrom e import f\nfrom . import g, h\nfrom ..i import j\nfrom . import *\nfrom __future__ import k", [("a.b", "static"), ("c", "static"), ("e", "static"), (".g", "static"), (".h", "static"), ("..i", "static")], 0),
        ("def f():\n  import a\nclass B:\n  import c\n  async def m(self):\n    import d", [("a", "dynamic"), ("c", "static"), ("d", "dynamic")], 0),
        ("if typing.TYPE_CHECKING:\n  import a\nelse:\n  import b\nif x:\n  import c", [("a", "type_only"), ("b", "type_only"), ("c", "static")], 0),
        ("importlib.import_module('a')\n__import__(n)\nimportlib.import_module(f'x{y}')\nimport_module('no')", [("a", "dynamic")], 2),
    ],
)
def test_python(source, want, hidden):
    assert python_imports(source) == (want, hidden, None)


def test_python_that_does_not_parse():
    found, _, warning = python_imports("import a\nfrom b.c import (\ndef x(")
    assert ("a", "static") in found and warning


def test_python_search():
    path = SearchPath(("/p", "/p/src"), ("/s",))
    decide = lambda spec, *there: path.decide("/p/x", spec, {t: t.rstrip("/") for t in there})
    assert decide("a", "/p/src/a.py", "/s/a/__init__.py") == "/p/src/a.py"
    assert decide("a", "/p/a/", "/s/a.py") == "/s/a.py"
    assert decide("a", "/p/a/") == "/p/a"
    assert decide("a.b", "/p/a/", "/p/a/__init__.py", "/p/src/a/b.py", "/p/src/a/") is None  # tied to the first root
    assert decide("a.b", "/p/a/", "/p/src/a/", "/p/src/a/b.py") == "/p/src/a/b.py"  # namespace
    assert decide("a.f", "/s/a/", "/s/a/f.<ext>") == "/s/a/f.<ext>"
    assert decide("..m", "/p/m.py") == "/p/m.py" and decide(".", "/p/x/__init__.py") == "/p/x/__init__.py"


def test_sys_path_and_pth(tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "t").mkdir()
    conf = tmp_path / "t" / "conftest.py"
    conf.write_text("import os, sys\nfrom pathlib import Path\nroot = Path(__file__).resolve().parent.parent\nsys.path.insert(0, str(root / 'lib'))\nsys.path.append(os.path.join(os.path.dirname(__file__), '..', 'none'))")
    assert added_folders(str(conf)) == [str(tmp_path / "lib")]
    (tmp_path / "x.pth").write_text("# no\nimport os\nlib\n/nowhere\n")
    assert pth_folders(str(tmp_path)) == [str(tmp_path / "lib")]


def test_package_targets():
    assert package_targets('{"main": "lib/m.js"}', "")[:2] == ["lib/m.ts", "lib/m.tsx"]
    exports = json.dumps({"exports": {".": {"types": "./t.d.ts", "import": "./m.mjs", "default": "./d.js"}, "./f/*": "./src/*.js", "./no": None}})
    assert package_targets(exports, "") == ["m.mjs", "d.js"] and package_targets(exports, "f/x") == ["src/x.js"] and package_targets(exports, "no") == package_targets(exports, "y") == []


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    files = {
        "package.json": '{"name":"test-project","version":"1.0.0"}',
        "index.ts": "import {a} from './a'; import './b'; import('./c')",
        "a.ts": "import _ from 'lodash'; import fs from 'fs'; import {x} from '@w/lib'",
        "b.ts": "import './a.js'; import data from './d.json'",
        "c.ts": "export const c = 1",
        "d.json": "{}",
        "unused.ts": "import 'zod'",
        "node_modules/lodash/package.json": '{"name":"lodash","main":"index.js"}',
        "node_modules/lodash/index.js": "module.exports = require('./_base')",
        "node_modules/lodash/_base.js": "",
        "node_modules/@w/lib/package.json": '{"exports":{".":{"import":"./m.mjs"}}}',
        "node_modules/@w/lib/m.mjs": "export const x = 1",
        "node_modules/zod/index.js": "",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    git("tag", "-am", "t", "v1")
    return root


@pytest.fixture(scope="module")
def session(spark, project):
    return Session.open(spark, str(project / "index.ts"), use_cache=False)


def test_project_graph(session, project):
    rel = lambda rows: {session.relative(r["path"]) for r in rows}
    nodes = session.graph.nodes.collect()
    assert rel(nodes) == {"index.ts", "a.ts", "b.ts", "c.ts", "d.json", "node_modules/lodash/index.js", "node_modules/lodash/_base.js", "node_modules/@w/lib/m.mjs"}
    assert {r["name"] for r in session.packages().collect()} == {"lodash", "@w/lib"}
    assert rel(session.importers("a.ts").collect()) == {"index.ts", "b.ts"}
    assert [r[0] for r in session.loaded.unresolved.collect()] == ["fs"]
    assert session.trace().summary().first()["dynamic_only_module_count"] == 1
    assert session.info("lodash")["file_count"] == 2 and session.info("nope") is None
    with pytest.raises(errors.EntryNotInGraph):
        session.set_entry("unused.ts")
    with pytest.raises(errors.EntryNotFound):
        session.set_entry("none.ts")


def test_reports(session):
    t = report.trace_report(session)
    assert t.body["entry"].endswith("/index.ts") and {p["name"] for p in t.body["heavy_packages"]} == {"lodash", "@w/lib"}
    assert t.body["static_module_count"] == 7 and t.body["total_modules_with_cost"] == 3
    assert "edge_kinds" not in json.loads(t.json(1))["heavy_packages"][0] and json.loads(t.json())["format_version"] == 2
    chain = report.chain_report(session, "lodash")
    assert chain.body["chains"][0]["modules"] == ["index.ts", "a.ts", "lodash"] and chain.body["hop_count"] == 2
    assert json.loads(chain.json(1))["chains"] == [["index.ts", "a.ts", "lodash"]]
    cut = report.cut_report(session, "lodash")
    assert [p["module"] for p in cut.body["cut_points"]] == ["a.ts"]
    assert report.chain_report(session, "nope").text() == "nope is not in the graph.\n"
    assert report.packages_report(session, 1).body["package_count"] == 2


def test_shell(session):
    shell = cli.Shell(session)
    assert "a.ts" in shell.run("imports index.ts") and "(dynamic)" in shell.run("imports index.ts")
    assert shell.run("bogus").startswith("error: unknown command") and shell.run("chain --nope x").startswith("error: unknown option")
    assert shell.run("set dynamic").startswith("dynamic on") and shell.run("unset dynamic").startswith("dynamic off")
    assert shell.run("quit") is None and "commands" in shell.run("")
    assert shell.complete("lo", "chain") == ["lodash"] and shell.complete("im") == ["importers", "imports"]
    assert cli.parse_command("trace --top x --ignore a b --json").options == {"ignore": ("a", "b"), "json": True}


def test_shell_prompt(session, tmp_path, monkeypatch, capsys):
    import builtins

    monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path))
    lines = iter(["imports index.ts", "quit"])
    monkeypatch.setattr(builtins, "input", lambda prompt: next(lines))
    shell = cli.Shell(session)
    assert shell.loop() == 0 and "a.ts" in capsys.readouterr().out
    assert cli.history_file() == tmp_path / "graphweight" / "history" and cli.history_file().exists()
    assert shell.completed("chain lo", 6, "lo") == ["lodash"] and shell.completed("im", 0, "im") == ["importers", "imports"]
    monkeypatch.setenv("XDG_DATA_HOME", "/proc/none")
    assert cli.history_file() is None


def test_completions(tmp_path):
    import subprocess

    script = tmp_path / "c.sh"
    script.write_text(cli.completions("bash"))
    ask = lambda *words: subprocess.run(["bash", "-c", 'source "$0"; COMP_WORDS=(graphweight "$@"); COMP_CWORD=$#; _graphweight; echo "${COMPREPLY[@]}"', str(script), *words], capture_output=True, text=True, check=True).stdout.split()
    assert ask("d") == ["diff"] and ask("trace", "--to") == ["--top", "--top-modules"] and ask("repl", "--max") == []
    assert "-l max-weight" in cli.completions("fish") and cli.completions("zsh").startswith("autoload")


def test_snapshots_and_git(spark, session, project, tmp_path, capsys):
    path = str(tmp_path / "s.json")
    D.save_snapshot(session.snapshot(), path)
    assert D.load_snapshot(spark, path).first()["static_weight"] == session.trace().summary().first()["static_weight"]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(errors.SnapshotParse):
        D.load_snapshot(spark, str(tmp_path / "bad.json"))
    assert classify(path, str(project)) == "snapshot" and classify("v1", str(project)) == "ref"
    with pytest.raises(errors.DiffFileNotFound):
        classify("no/such.json", str(project))
    assert cli.main(["diff", "v1", path, "--entry", str(project / "index.ts"), "--json", "--format-version", "2"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["weight_delta"] == 0 and found["shared_count"] == 2


def test_cache_and_watch(spark, project):
    entry = checked_entry(str(project / "index.ts"))
    first = incremental.refreshed(spark, entry, str(project))
    watch = Watch(spark, str(project), "typescript")
    assert not first.from_cache and incremental.refreshed(spark, entry, str(project)).from_cache and not watch.dirty
    (project / "c.ts").write_text("export const c = 1234567890")
    assert {(os.path.basename(r[0]), r[1]) for r in watch.events().collect()} == {("c.ts", "modify")}
    again = incremental.refreshed(spark, entry, str(project))
    assert again.from_cache and again.graph.nodes.where("path like '%/c.ts'").first()["size_bytes"] == 27
    (project / "c.ts").write_text("import './unused'")
    assert not incremental.refreshed(spark, entry, str(project)).from_cache


def test_cli_errors(spark, project, tmp_path, capsys):
    entry = str(project / "index.ts")
    assert cli.main(["trace", entry, "--chain", "a", "--cut", "b"], spark) == 1 and "cannot be used together" in capsys.readouterr().err
    assert cli.main(["trace", entry, "--top", "-2"], spark) == 1
    assert cli.main(["trace", str(tmp_path)], spark) == 1 and cli.main(["trace", str(tmp_path / "x.ts")], spark) == 1
    (tmp_path / "x.rb").write_text("")
    assert cli.main(["trace", str(tmp_path / "x.rb")], spark) == 1 and "unsupported" in capsys.readouterr().err


def test_python_project(spark, tmp_path):
    for name, text in {"pyproject.toml": "", "main.py": "import pkg.mod\nfrom pkg import util\nimport os", "src/pkg/__init__.py": "from . import util", "src/pkg/mod.py": "from .util import f\ndef g():\n  import lib", "src/pkg/util.py": "", "site/lib/__init__.py": "import lib.fast", "site/lib/fast.cpython-311.so": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    loaded = load(spark, str(tmp_path / "main.py"), sites=[str(tmp_path / "site")])
    nodes = {r["path"].removeprefix(str(tmp_path) + "/"): r["package"] for r in loaded.graph.nodes.collect()}
    assert nodes == {"main.py": None, "src/pkg/__init__.py": None, "src/pkg/mod.py": None, "src/pkg/util.py": None, "site/lib/__init__.py": "lib", "site/lib/fast.cpython-311.so": "lib"}
    assert [r[0] for r in loaded.unresolved.collect()] == ["os"]


def test_scalars(spark):
    rows = spark.createDataFrame([(2_500_000, "5MB"), (999_999, " 1.5KB "), (2500, "100B"), (12, "7"), (0, "x")], "n long, t string")
    assert [tuple(r) for r in rows.select(X.format_size(F.col("n")), X.parse_size(F.col("t"))).collect()] == [("2.5 MB", 5_000_000), ("1000 KB", 1500), ("2 KB", 100), ("12 B", 7), ("0 B", None)]
    one = spark.range(1)
    assert one.select(X.node_package(F.lit("/r/node_modules/.pnpm/a@1/node_modules/@s/b/x.js"))).first()[0] == "@s/b"
    assert one.select(X.package_relative_path(F.lit("/r/.pnpm/c@5/node_modules/c/index.js"), F.lit("c"))).first()[0] == "c/index.js"
    assert [X_ for X_ in one.select(X.is_node_builtin(F.lit("node:fs")), X.is_node_builtin(F.lit("fs/promises")), X.is_node_builtin(F.lit("lodash"))).first()] == [True, False, False]


def test_student():
    assert M.two_tailed_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert M.two_tailed_p(0.0, 5) == 1.0 and M.two_tailed_p(float("nan"), 3) == 1.0
    assert M.two_tailed_p(12.706, 1) == pytest.approx(0.05, abs=1e-5)
