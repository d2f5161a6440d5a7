"""Results as versioned JSON and as text."""

from __future__ import annotations

import json
import os
import sys
from collections import Counter
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from graphweight.errors import InvalidNumber
from graphweight.functions.scalar import size_text
from graphweight.operators import diff as D
from graphweight.operators.trace import TraceOptions
from graphweight.session import Session

VERSIONS = (1, 2)
TOP, TOP_MODULES, LIMIT = 10, 20, 10


def checked_number(name: str, n: int) -> int:
    if n < -1:
        raise InvalidNumber(name, n)
    return n


def wants_color(no_color: bool = False, stream: Any = None) -> bool:
    stream = stream or sys.stdout
    return not (no_color or os.environ.get("NO_COLOR") or os.environ.get("TERM") == "dumb") and stream.isatty()


def plural(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's'}"


def signed_size(n: int) -> str:
    return f"{'+' if n > 0 else '-' if n < 0 else ''}{size_text(abs(n))}"


@dataclass
class Report:
    kind: str
    body: dict[str, Any]
    lines: list[str] = field(default_factory=list)

    def json(self, version: int = 2) -> str:
        body = self.body if version > 1 else _first_version(self.kind, self.body)
        return json.dumps({"format_version": version, **body}, indent=2, ensure_ascii=False)

    def text(self) -> str:
        return "\n".join(self.lines) + "\n"


def _first_version(kind: str, body: dict[str, Any]) -> dict[str, Any]:
    """Version 1: chains are lists of names, and packages have no kinds of edges."""
    if kind == "trace":
        short = [{k: v for k, v in p.items() if k not in ("edge_kinds", "classification")} for p in body["heavy_packages"]]
        return {**body, "heavy_packages": short}
    if kind == "chain":
        return {**body, "chains": [c["modules"] for c in body["chains"]]}
    return body


class Names:
    """Names to show for modules: the package, else the path below the root; repeated ones of a chain in full."""

    def __init__(self, session: Session, paths: set[str]):
        from pyspark.sql import functions as F

        self.session = session
        rows = session.graph.nodes.where(F.col("path").isin(sorted(paths))).select("path", "package").collect() if paths else []
        self.package = {r["path"]: r["package"] for r in rows}

    def one(self, path: str) -> str:
        return self.package.get(path) or self.session.relative(path)

    def inside(self, path: str, package: str) -> str:
        parts, wanted = path.split("/"), package.split("/")
        for i in range(len(parts) - len(wanted), -1, -1):
            if parts[i : i + len(wanted)] == wanted:
                return "/".join(parts[i:])
        return parts[-1]

    def chain(self, paths: list[str]) -> list[str]:
        shown = [self.one(p) for p in paths]
        often = Counter(shown)
        return [self.inside(p, self.package[p]) if often[s] > 1 and self.package.get(p) else s for p, s in zip(paths, shown, strict=True)]


def _tagged(row: Any) -> dict[str, Any]:
    out = {"type": row["type"]}
    return out | {"first_dynamic_hop": row["first_dynamic_hop"]} if row["type"] == "mixed" else out


def trace_report(session: Session, options: TraceOptions = TraceOptions(), top_modules: int = TOP_MODULES) -> Report:
    trace = session.trace()
    summary = trace.summary(options.include_dynamic).first()
    heavy = [r for r in session.heavy_packages(options).collect()]
    heavy.sort(key=lambda r: (-r["total_size_bytes"], r["name"]))
    cost = session.modules_by_cost(options.include_dynamic)
    n_cost = cost.count()
    modules = cost.collect() if top_modules < 0 else cost.limit(top_modules).collect()
    names = Names(session, {p for r in heavy for p in r["chain"]} | {r["path"] for r in modules})
    body = {
        "entry": session.entry_label(),
        "static_weight_bytes": summary["static_weight"],
        "static_module_count": summary["static_module_count"],
        "dynamic_only_weight_bytes": summary["dynamic_only_weight"],
        "dynamic_only_module_count": summary["dynamic_only_module_count"],
        "heavy_packages": [
            {"name": r["name"], "total_size_bytes": r["total_size_bytes"], "file_count": r["file_count"], "chain": names.chain(r["chain"]), "edge_kinds": ["static"] * max(0, len(r["chain"]) - 1), "classification": {"type": "all_static"}} for r in heavy
        ],
        "modules_by_cost": [{"path": session.relative(r["path"]), "exclusive_size_bytes": r["exclusive_size_bytes"]} for r in modules],
        "total_modules_with_cost": n_cost,
    }
    lines = [body["entry"], f"Static weight: {size_text(body['static_weight_bytes'])} ({plural(body['static_module_count'], 'module')})"]
    if body["dynamic_only_module_count"]:
        lines.append(f"Dynamic only: {size_text(body['dynamic_only_weight_bytes'])} ({plural(body['dynamic_only_module_count'], 'module')})")
    if body["heavy_packages"]:
        lines += ["", "Heaviest packages:"]
        for p in body["heavy_packages"]:
            lines += [f"  {p['name']}  {size_text(p['total_size_bytes'])}  {plural(p['file_count'], 'file')}", *([f"    -> {' -> '.join(p['chain'])}"] if len(p["chain"]) > 1 else [])]
    if body["modules_by_cost"]:
        lines += ["", "Modules by exclusive weight:", *(f"  {m['path']}  {size_text(m['exclusive_size_bytes'])}" for m in body["modules_by_cost"])]
        if n_cost > len(modules):
            lines.append(f"  ... and {n_cost - len(modules)} more")
    return Report("trace", body, lines)


def chain_report(session: Session, target: str, include_dynamic: bool = False) -> Report:
    found, chains = session.chain(target, include_dynamic)
    rows = chains.orderBy("idx").collect()
    names = Names(session, {p for r in rows for p in r["modules"]})
    listed = [{"modules": names.chain(r["modules"]), "edge_kinds": [k.replace("type_only", "type-only") for k in r["edge_kinds"]], "classification": _tagged(r["classification"])} for r in rows]
    hops = len(rows[0]["modules"]) - 1 if rows else 0
    body = {"target": found.label, "found_in_graph": found.exists, "chain_count": len(rows), "hop_count": hops, "chains": listed}
    if not rows:
        lines = [f"{found.label} is in the graph but cannot be reached" + ("" if include_dynamic else " by static imports") + "." if found.exists else f"{found.label} is not in the graph."]
    else:
        lines = [f"{plural(len(rows), 'chain')} to {found.label} ({plural(hops, 'hop')}):", ""]
        for i, c in enumerate(listed, 1):
            parts = [c["modules"][0]]
            for name, kind in zip(c["modules"][1:], c["edge_kinds"], strict=True):
                parts.append(("~>" if kind == "dynamic" else "->") + f" {name}")
            lines.append(f"  {i}. {' '.join(parts)}")
    return Report("chain", body, lines)


def cut_report(session: Session, target: str, include_dynamic: bool = False, top: int = TOP) -> Report:
    found, chains, cuts, direct = session.cut(target, include_dynamic, top)
    rows, n = cuts.collect(), chains.count()
    names = Names(session, {r["path"] for r in rows})
    points = [{"module": names.one(r["path"]), "exclusive_size_bytes": r["exclusive_size_bytes"], "chains_broken": r["chains_broken"]} for r in rows]
    body = {"target": found.label, "found_in_graph": found.exists, "chain_count": n, "direct_import": direct, "cut_points": points}
    if not n:
        lines = [f"{found.label} is in the graph but cannot be reached." if found.exists else f"{found.label} is not in the graph."]
    elif direct:
        lines = [f"The entry imports {found.label} directly; nothing between them can be cut."]
    elif not points and top:
        lines = [f"No single cut point severs all chains to {found.label}."]
    else:
        lines = [f"Cut points for {found.label} ({plural(n, 'chain')}):", *(f"  {p['module']}  {size_text(p['exclusive_size_bytes'])}  breaks {p['chains_broken']}" for p in points)]
    return Report("cut", body, lines)


def diff_report(a: DataFrame, b: DataFrame, limit: int = LIMIT) -> Report:
    """Of two snapshots. The limit shortens the text alone."""
    body: dict[str, Any] = D.diff_summary(a, b).first().asDict()
    rows = D.diff_sections(a, b).collect()
    for section in D.SECTIONS:
        own = sorted((r for r in rows if r["section"] == section), key=lambda r: (-r["total_size_bytes"], r["name"]))
        body[section] = [{"name": r["name"], "total_size_bytes": r["total_size_bytes"]} for r in own]
    lines = [f"{body['entry_a']} -> {body['entry_b']}", f"Static weight: {size_text(body['weight_a'])} -> {size_text(body['weight_b'])} ({signed_size(body['weight_delta'])})"]
    if body["dynamic_weight_a"] or body["dynamic_weight_b"]:
        lines.append(f"Dynamic only: {size_text(body['dynamic_weight_a'])} -> {size_text(body['dynamic_weight_b'])} ({signed_size(body['dynamic_weight_delta'])})")
    for section, title in zip(D.SECTIONS, ("Only in the first", "Only in the second", "Dynamic, only in the first", "Dynamic, only in the second"), strict=True):
        if own := body[section]:
            shown = own if limit < 0 else own[:limit]
            lines += ["", f"{title}:", *(f"  {p['name']}  {size_text(p['total_size_bytes'])}" for p in shown), *([f"  ... and {len(own) - len(shown)} more"] if len(shown) < len(own) else [])]
    return Report("diff", body, [*lines, "", f"{plural(body['shared_count'], 'package')} shared"])


def packages_report(session: Session, top: int = TOP) -> Report:
    rows = session.packages().collect()
    shown = [{k: r[k] for k in ("name", "total_size_bytes", "file_count")} for r in (rows if top < 0 else rows[:top])]
    lines = [f"{plural(len(rows), 'package')}:", *(f"  {p['name']}  {size_text(p['total_size_bytes'])}  {plural(p['file_count'], 'file')}" for p in shown)] if rows else ["No packages."]
    if len(shown) < len(rows):
        lines.append(f"  ... and {len(rows) - len(shown)} more")
    return Report("packages", {"package_count": len(rows), "packages": shown}, lines)


def links_report(session: Session, rows: DataFrame, none: str) -> Report:
    """Imports or importers of a module: a JSON array, without a version."""
    found = [{"path": session.relative(r["path"]), "kind": r["kind"].replace("_", "-")} for r in rows.collect()]
    lines = [f"  {x['path']}" + ("" if x["kind"] == "static" else f" ({x['kind']})") for x in found] or [f"  ({none})"]
    out = Report("links", {"links": found}, lines)
    out.json = lambda version=2: json.dumps(found, indent=2, ensure_ascii=False)  # type: ignore[method-assign]
    return out


def load_status(session: Session) -> list[str]:
    """Lines for the error stream: where the graph came from, and what could not be told."""
    loaded, nodes = session.loaded, session.graph.nodes
    lines = [f"{'Loaded' if loaded.from_cache else 'Built'} graph of {plural(nodes.count(), 'module')}"]
    hidden = loaded.unresolvable.orderBy("path").collect()
    if hidden:
        lines.append(f"{plural(sum(r['count'] for r in hidden), 'import')} cannot be told:")
        lines += [f"  {session.relative(r['path'])} ({r['count']})" for r in hidden]
    return lines + [f"warning: {session.relative(r['path'])}: {r['message']}" for r in loaded.warnings.orderBy("path").collect()]
