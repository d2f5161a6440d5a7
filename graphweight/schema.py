"""Tables of a dependency graph."""

from __future__ import annotations

STATIC, DYNAMIC, TYPE_ONLY = "static", "dynamic", "type_only"
KINDS = (STATIC, DYNAMIC, TYPE_ONLY)

#: A module or other weighed thing; package is null for first-party ones.
NODES = "path string, size_bytes long, package string"
#: An import: ord is its place in the importing file.
EDGES = "src string, dst string, kind string, specifier string, ord long"
IMPORTS = "path string, ord int, specifier string, kind string"
FILES = "path string, is_dir boolean, size long, mtime_nanos decimal(38,0), content binary"
SNAPSHOT = "entry string, static_weight long, packages map<string,bigint>, dynamic_weight long, dynamic_packages map<string,bigint>"
