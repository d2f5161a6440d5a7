"""Imports of TypeScript and JavaScript source, from its tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .python_imports import Found

_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\A#![^\n]*|<!--[^\n]*)+", re.S)
_NAME = re.compile(r"[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*")
_NUMBER = re.compile(r"\.?\d[\w.]*")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: After these a slash begins a regular expression and a quote a string, though they are words.
_OPERATORS = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())

Token = tuple[str, str]  # kind: name, string, number, regex, template, or the character itself


def tokens(source: str) -> Iterator[Token]:
    """Tokens of a source, with those inside of template expressions. Quotes that do not close on their line are skipped."""
    at, n = 0, len(source)
    braces: list[int] = []  # open braces inside each template expression
    before: Token = (";", ";")

    def template(at: int) -> tuple[int, bool]:
        """Where a template's text ends, and whether an expression begins there."""
        while at < n:
            c = source[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1, False
            elif c == "$" and source.startswith("{", at + 1):
                return at + 2, True
            else:
                at += 1
        return n, False

    while at < n:
        if m := _SPACE.match(source, at):
            at = m.end()
            continue
        c, token = source[at], None
        if m := _NAME.match(source, at):
            token, at = ("name", m[0]), m.end()
        elif c in "'\"":
            # a quote right after another word is an apostrophe in text between tags
            inside_word = at > 0 and before[0] == "name" and (source[at - 1].isalnum() or source[at - 1] in "_$") and before[1] not in _OPERATORS and before[1] not in ("from", "import", "default")
            if not inside_word and (m := _STRING.match(source, at)):
                token, at = ("string", m[0][1:-1]), m.end()
            else:
                at += 1
                continue
        elif m := _NUMBER.match(source, at):
            token, at = ("number", m[0]), m.end()
        elif c == "`":
            at, opened = template(at + 1)
            token = ("template", "")
            if opened:
                braces.append(0)
        elif c == "}" and braces and not braces[-1]:
            at, opened = template(at + 1)
            if not opened:
                braces.pop()
            before = ("template", "")
            continue
        elif c == "/" and (before[0] not in ("name", "number", "string", "regex", "template", ")", "]", "}") or before[0] == "name" and before[1] in _OPERATORS) and (m := _REGEX.match(source, at)):
            token, at = ("regex", m[0]), m.end()
        else:
            if braces and c in "{}":
                braces[-1] += 1 if c == "{" else -1
            token, at = (c, c), at + 1
        before = token
        yield token


_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", re.S)


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else m[4], text) if "\\" in text else text


def _clause(t: list[Token], i: int) -> tuple[int, list[bool]] | None:
    """The bindings of an import or export clause that begins at i: where `from` stands, and for each binding whether it is a type."""
    bindings: list[bool] = []
    whole = False
    if t[i] == ("name", "type") and (t[i + 1][0] in ("{", "*") or t[i + 1][0] == "name" and (t[i + 1][1] != "from" or t[i + 2] == ("name", "from"))):
        whole, i = True, i + 1
    while True:
        kind, value = t[i]
        if kind == "{":
            i += 1
            while t[i][0] not in ("}", "end"):
                first = i
                while t[i][0] not in (",", "}", "end"):
                    i += 1
                item = t[first:i]
                if item:
                    # `type a`, `type a as b`, `type as as b`; but `type`, `type as b` name a binding
                    is_type = item[0] == ("name", "type") and len(item) > 1 and (item[1] != ("name", "as") or len(item) in (2, 4))
                    bindings.append(whole or is_type)
                i += t[i][0] == ","
            if t[i][0] != "}":
                return None
            i += 1
        elif kind == "*":
            bindings.append(whole)
            i += 1
            if t[i] == ("name", "as"):
                i += 2
        elif kind == "name":
            bindings.append(whole)
            i += 1
        else:
            return None
        if t[i][0] == ",":
            i += 1
            continue
        return (i, bindings) if t[i] == ("name", "from") and t[i + 1][0] == "string" else None


def ecmascript_imports(source: str) -> Found:
    """(specifier, kind) pairs in source order, number of imports that cannot be told, no warning (tokens always come out).

    Static imports and re-exports are type-only if all of their bindings are; `import("x")` is dynamic; `require("x")` is static wherever it stands.
    """
    t = [*tokens(source), *[("end", "")] * 4]
    out: list[tuple[str, str]] = []
    unresolvable = 0
    for i, (kind, value) in enumerate(t):
        if kind != "name" or value not in ("import", "export", "require"):
            continue
        before, after = (t[i - 1] if i else (";", ";")), t[i + 1]
        if before[0] == "." and not (i > 2 and t[i - 2][0] == t[i - 3][0] == "."):
            continue
        if after[0] == "(":
            if value == "export" or before == ("name", "function"):
                continue
            literal = t[i + 2][0] == "string" and t[i + 3][0] in (")", ",")
            if literal:
                out.append((_plain(t[i + 2][1]), "dynamic" if value == "import" else "static"))
            elif t[i + 2][0] != ")":
                unresolvable += 1
        elif value == "import" and after[0] == "string":
            out.append((_plain(after[1]), "static"))
        elif value != "require" and after[0] in ("{", "*", "name"):
            found = _clause(t, i + 1)
            if found:
                at, bindings = found
                out.append((_plain(t[at + 1][1]), "type_only" if bindings and all(bindings) else "static"))
    return out, unresolvable, None
