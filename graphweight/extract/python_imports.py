"""Imports of Python source."""

from __future__ import annotations

import ast
import re

Found = tuple[list[tuple[str, str]], int, str | None]

_LINE = re.compile(r"^[ \t]*(?:import[ \t]+(?P<names>[\w., \t]+)|from[ \t]+(?P<dots>\.*)[ \t]*(?P<module>[\w.]*)[ \t]+import[ \t]+(?P<items>[^#\n]+))", re.M)


class _Imports(ast.NodeVisitor):
    """Collects (specifier, kind) in source order; functions make imports dynamic, TYPE_CHECKING blocks type-only."""

    def __init__(self) -> None:
        self.found: list[tuple[str, str]] = []
        self.unresolvable = 0
        self.in_function = self.type_checking = False

    @property
    def kind(self) -> str:
        return "type_only" if self.type_checking else "dynamic" if self.in_function else "static"

    def visit_Import(self, node: ast.Import) -> None:
        self.found += [(alias.name, self.kind) for alias in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if not node.level and node.module == "__future__":
            return
        dots = "." * node.level
        if node.module:
            self.found.append((dots + node.module, self.kind))
        else:
            self.found += [(dots + alias.name, self.kind) for alias in node.names if alias.name != "*"]

    def _function(self, node: ast.AST) -> None:
        before, self.in_function = self.in_function, True
        self.generic_visit(node)
        self.in_function = before

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_If(self, node: ast.If) -> None:
        before, test = self.type_checking, ast.unparse(node.test)
        self.type_checking = before or test == "TYPE_CHECKING" or test.endswith(".TYPE_CHECKING")
        self.generic_visit(node)
        self.type_checking = before

    def visit_Call(self, node: ast.Call) -> None:
        if ast.unparse(node.func) in ("importlib.import_module", "__import__"):
            texts = [a.value for a in node.args if isinstance(a, ast.Constant) and isinstance(a.value, str)]
            if texts:
                self.found.append((texts[0], "dynamic"))
            else:
                self.unresolvable += 1
        self.generic_visit(node)


def _by_line(source: str) -> list[tuple[str, str]]:
    out = []
    for m in _LINE.finditer(source):
        if m["names"]:
            out += [(n.split()[0], "static") for n in m["names"].split(",") if n.strip()]
        elif m["module"]:
            out += [] if m["module"] == "__future__" and not m["dots"] else [(m["dots"] + m["module"], "static")]
        elif m["dots"]:
            out += [(m["dots"] + n.split()[0], "static") for n in m["items"].strip("() \t").split(",") if n.strip() and n.strip() != "*"]
    return out


def python_imports(source: str) -> Found:
    """(specifier, kind) pairs, number of imports that cannot be told, warning. A file that does not parse is read line by line."""
    try:
        parsed = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return _by_line(source), 0, f"does not parse: {error}"
    visitor = _Imports()
    try:
        visitor.visit(parsed)
    except RecursionError:
        return _by_line(source), 0, "nested too deeply"
    return visitor.found, visitor.unresolvable, None
