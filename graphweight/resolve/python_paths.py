"""Python modules: search path and resolution."""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from .probing import EXTENSION_SUFFIX

# Where virtual environments and tests are looked for.
VENVS = (".venv", "venv", ".env", "env")
TEST_FOLDERS = ("test", "tests", "testing", "spec", "specs")
SKIPPED = frozenset("__pycache__ .git .hg .svn .tox .nox .venv venv node_modules build dist".split())


@dataclass(frozen=True)
class SearchPath:
    """Folders in the order of search: source roots first, then site folders."""

    sources: tuple[str, ...]
    sites: tuple[str, ...] = ()

    @property
    def roots(self) -> tuple[str, ...]:
        return self.sources + self.sites

    def _relative(self, folder: str, specifier: str) -> list[str]:
        name = specifier.lstrip(".")
        for _ in range(len(specifier) - len(name) - 1):
            folder = os.path.dirname(folder)
        base = "/".join([folder, *name.split(".")]) if name else folder
        return [f"{base}/__init__.py", *([f"{base}.py"] if name else [])]

    def _forms(self, base: str, site: bool) -> list[str]:
        return [f"{base}/__init__.py", *([base + EXTENSION_SUFFIX] if site else []), f"{base}.py"]

    def probes(self, folder: str, specifier: str) -> list[str]:
        """All paths that bear on a specifier."""
        if specifier.startswith("."):
            return self._relative(folder, specifier)
        parts, out = specifier.split("."), []
        for i, root in enumerate(self.roots):
            for k in range(1, len(parts) + 1):
                base = "/".join([root, *parts[:k]])
                out += [f"{base}/", f"{base}/__init__.py"]
            out += self._forms(base, i >= len(self.sources))
        return out

    def decide(self, folder: str, specifier: str, found: dict[str, str]) -> str | None:
        """The file of a specifier, given which of its probes exist.

        A folder with __init__.py on the way ties the search to its root; without one, all roots that have the
        folder stay open (a namespace). In them the module is looked for, then a folder of that name.
        """
        if specifier.startswith("."):
            return next((found[p] for p in self._relative(folder, specifier) if p in found), None)
        parts, open_ = specifier.split("."), list(enumerate(self.roots))
        for k in range(1, len(parts)):
            at = lambda root: "/".join([root, *parts[:k]])  # noqa: B023, E731
            packages = [(i, r) for i, r in open_ if f"{at(r)}/__init__.py" in found]
            open_ = packages[:1] or [(i, r) for i, r in open_ if f"{at(r)}/" in found]
            if not open_:
                return None
        for i, root in open_:
            for p in self._forms("/".join([root, *parts]), i >= len(self.sources)):
                if p in found:
                    return found[p]
        return next((found[p] for _, root in open_ if (p := "/".join([root, *parts]) + "/") in found), None)


def venv_sites(root: str) -> list[str]:
    """site-packages of the project's virtual environment, by its pyvenv.cfg."""
    for name in VENVS:
        try:
            with open(os.path.join(root, name, "pyvenv.cfg"), encoding="utf-8") as file:
                m = re.search(r"(?m)^\s*version(?:_info)?\s*=\s*(\d+\.\d+)", file.read())
        except OSError:
            continue
        places = ([os.path.join(root, name, "lib", f"python{m[1]}", "site-packages")] if m else []) + [os.path.join(root, name, "Lib", "site-packages")]
        found = [p for p in places if os.path.isdir(p)]
        if found:
            return found
    return []


def pth_folders(site: str) -> list[str]:
    """Folders that the .pth files of a site folder add."""
    out = []
    for name in sorted(n for n in os.listdir(site) if n.endswith(".pth")):
        with open(os.path.join(site, name), encoding="utf-8", errors="replace") as file:
            for line in map(str.strip, file):
                if line and not line.startswith(("#", "import ", "import\t")):
                    folder = os.path.normpath(os.path.join(site, line))
                    if os.path.isdir(folder):
                        out.append(folder)
    return out


class _Folders(ast.NodeVisitor):
    """Folders that a file puts on sys.path, as far as they follow from __file__ and strings."""

    def __init__(self, path: str):
        self.path, self.names, self.found = path, {}, []

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            if isinstance(target, ast.Name):
                self.names[target.id] = node.value
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        name = ast.unparse(node.func)
        at = {"sys.path.insert": 1, "sys.path.append": 0}.get(name)
        if at is not None and len(node.args) > at and (value := self.value(node.args[at])) is not None:
            self.found.append(value)
        self.generic_visit(node)

    def value(self, node: ast.AST, depth: int = 0) -> str | None:
        if depth > 30:
            return None
        of = lambda x: self.value(x, depth + 1)
        match node:
            case ast.Constant(value=str(text)):
                return text
            case ast.Name(id="__file__"):
                return self.path
            case ast.Name(id=name) if name in self.names:
                return of(self.names[name])
            case ast.Attribute(value=inner, attr="parent"):
                return None if (x := of(inner)) is None else os.path.dirname(x)
            case ast.BinOp(left=left, op=ast.Div(), right=right):
                x, y = of(left), of(right)
                return None if x is None or y is None else os.path.join(x, y)
            case ast.Call(func=ast.Attribute(value=inner, attr="resolve" | "as_posix" | "absolute"), args=[]):
                return of(inner)
            case ast.Call(func=function, args=args) if args:
                name, values = ast.unparse(function), [of(a) for a in args]
                if None in values:
                    return None
                if name in ("os.path.dirname", "path.dirname", "dirname"):
                    return os.path.dirname(values[0])
                if name in ("os.path.join", "path.join", "join"):
                    return os.path.join(*values)
                if name in ("Path", "pathlib.Path", "str", "os.path.abspath", "os.path.realpath", "os.path.normpath", "abspath", "realpath"):
                    return os.path.join(*values)
        return None


def added_folders(path: str) -> list[str]:
    """Existing folders that a file adds to sys.path."""
    try:
        with open(path, encoding="utf-8") as file:
            source = file.read()
        if "sys.path" not in source or "__file__" not in source:
            return []
        visitor = _Folders(os.path.abspath(path))
        visitor.visit(ast.parse(source))
    except (OSError, ValueError, SyntaxError, RecursionError):
        return []
    return [p for p in (os.path.normpath(x) for x in visitor.found if os.path.isabs(x)) if os.path.isdir(p)]


def conftests(root: str) -> list[str]:
    out = [p for p in [os.path.join(root, "conftest.py")] if os.path.isfile(p)]
    for name in TEST_FOLDERS:
        for folder, below, files in os.walk(os.path.join(root, name)):
            below[:] = sorted(d for d in below if d not in SKIPPED)
            out += [os.path.join(folder, "conftest.py")] * ("conftest.py" in files)
    return out


def search_path(root: str, sites: list[str] | None = None, is_dir: Callable[[str], bool] = os.path.isdir) -> SearchPath:
    """The project's root, its src and lib, what conftest files add; the site folders, what .pth files and vendoring packages add."""
    sources = [root, *(p for n in ("src", "lib") if is_dir(p := os.path.join(root, n))), *(f for c in conftests(root) for f in added_folders(c))]
    sites = venv_sites(root) if sites is None else list(sites)
    for add in (pth_folders, lambda s: [f for n in sorted(os.listdir(s)) if os.path.isfile(p := os.path.join(s, n, "__init__.py")) for f in added_folders(p)]):
        sites += [f for s in list(sites) if os.path.isdir(s) for f in add(s)]
    unique = lambda xs: tuple(dict.fromkeys(xs))
    return SearchPath(unique(sources), tuple(s for s in unique(sites) if s not in sources))
