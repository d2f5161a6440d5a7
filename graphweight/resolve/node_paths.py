"""ECMAScript modules: resolution by Node's published algorithm."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweight.functions.scalar import NODE_BUILTINS

from .probing import resolved

# Extensions in the order of trial, what a written extension may stand for, conditions and main fields.
EXTENSIONS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".json", ".node")
STANDS_FOR = {".js": (".ts", ".tsx", ".js"), ".mjs": (".mts", ".mjs"), ".cjs": (".cts", ".cjs")}
CONDITIONS = frozenset(("node", "import", "require", "default"))
MAIN_FIELDS = ("module", "main")


def is_builtin(specifier: str) -> bool:
    name = specifier.removeprefix("node:")
    return name in NODE_BUILTINS or specifier.startswith("node:internal/")


def file_forms(base: str) -> list[str]:
    """Files that a path may name, in order: with other extensions for the written one, as it is, with an extension added, as folder."""
    stem, ext = os.path.splitext(base)
    swapped = [stem + e for e in STANDS_FOR.get(ext, ())]
    return [*swapped, base, *(base + e for e in EXTENSIONS), *(f"{base}/index{e}" for e in EXTENSIONS)]


def split_bare(specifier: str) -> tuple[str, str]:
    """Package and the path inside it."""
    parts = specifier.split("/")
    n = 2 if specifier.startswith("@") else 1
    return "/".join(parts[:n]), "/".join(parts[n:])


def _conditional(target: object) -> Iterable[str]:
    """Paths of an exports target, in the order of its conditions."""
    if isinstance(target, str):
        yield target
    elif isinstance(target, list):
        for x in target:
            yield from _conditional(x)
    elif isinstance(target, dict):
        for key, x in target.items():
            if key in CONDITIONS:
                yield from _conditional(x)


def _about(manifest: str | None) -> dict:
    try:
        about = json.loads(manifest or "{}")
    except ValueError:
        return {}
    return about if isinstance(about, dict) else {}


def _mapped(table: dict, key: str) -> list[str]:
    """Targets of a key in a map of exports or imports: its own entry, or the pattern with the longest part before its star."""
    if key in table:
        return list(_conditional(table[key]))
    best = max((k for k in table if "*" in k and key.startswith(k.split("*")[0]) and key.endswith(k.split("*", 1)[1]) and len(key) >= len(k) - 1), key=lambda k: (len(k.split("*")[0]), len(k)), default=None)
    if best is None:
        return []
    head, tail = best.split("*", 1)
    part = key[len(head) : len(key) - len(tail)]
    return [p.replace("*", part) for p in _conditional(table[best])]


def package_targets(manifest: str | None, inside: str) -> list[str]:
    """Paths below a package's folder that may answer for a path inside it; a manifest with exports answers alone."""
    about = _about(manifest)
    exports = about.get("exports")
    if exports is not None:
        if not isinstance(exports, dict) or not any(str(k).startswith(".") for k in exports):
            exports = {".": exports}
        return [os.path.normpath(p) for p in _mapped(exports, "./" + inside if inside else ".")]
    if inside:
        return file_forms(inside)
    mains = [os.path.normpath(about[f]) for f in MAIN_FIELDS if isinstance(about.get(f), str)]
    return [form for m in mains for form in file_forms(m)] + [f"index{e}" for e in EXTENSIONS]


def import_targets(manifest: str | None, specifier: str) -> list[str]:
    """What a package's own manifest names for a specifier that starts with a hash sign: paths from its folder (with ./ before them) or other packages."""
    imports = _about(manifest).get("imports")
    if not isinstance(imports, dict) or specifier == "#" or specifier.startswith("#/"):
        return []
    return ["./" + os.path.normpath(t) if t.startswith("./") else t for t in _mapped(imports, specifier) if not t.startswith(("../", "/", "#"))]


def folders_above(folder: str) -> list[str]:
    """The folder itself and those above it."""
    out = [folder]
    while folder not in ("/", ""):
        folder = os.path.dirname(folder)
        out.append(folder)
    return out


def package_folders(folder: str, name: str) -> list[str]:
    out = []
    while True:
        if os.path.basename(folder) != "node_modules":
            out.append(os.path.join(folder, "node_modules", name))
        if folder in ("/", ""):
            return out
        folder = os.path.dirname(folder)


def _is_path(specifier: str) -> bool:
    return specifier.startswith(("./", "../", "/")) or specifier in (".", "..")


def resolve_node(questions: DataFrame, fs: DataFrame, manifests: DataFrame) -> DataFrame:
    """questions(folder, specifier), fs(path, is_dir), manifests(path, content) of package.json files to folder, specifier, resolved.

    A bare specifier first meets the manifests of the package's folders above it (a join on their paths), and then
    asks for the files that these name; the nearest folder that has one answers. A specifier that starts with a hash
    sign is first put to the nearest manifest above the folder, which names files or packages in its place.
    """

    def base(folder: str, specifier: str) -> str:
        return os.path.normpath(os.path.join(folder, specifier))

    paths = resolved(
        questions.where(F.col("specifier").rlike(r"^(\.{0,2}/|\.{1,2}$)")),
        fs,
        lambda f, s: file_forms(base(f, s)),
        lambda f, s, found: next((found[p] for p in file_forms(base(f, s)) if p in found), None),
    )

    @F.udf("array<struct<rank:int,package:string,inside:string>>")
    def places(folder: str, specifier: str) -> list[tuple[int, str, str]]:
        if _is_path(specifier) or is_builtin(specifier) or not specifier:
            return []
        name, inside = split_bare(specifier)
        return [(i, p, inside) for i, p in enumerate(package_folders(folder, name))]

    @F.udf("array<string>")
    def targets(manifest: bytes | None, inside: str) -> list[str]:
        return package_targets(None if manifest is None else manifest.decode("utf-8", "replace"), inside)

    @F.udf("array<string>")
    def instead(manifest: bytes, specifier: str) -> list[str]:
        return import_targets(manifest.decode("utf-8", "replace"), specifier)

    packages = manifests.select(F.regexp_replace("path", "/package\\.json$", "").alias("package"), "content")
    bare = questions.select("folder", "specifier").distinct().where(~F.col("specifier").rlike(r"^(\.{0,2}/|\.{1,2}$)"))
    own = bare.where("specifier like '#%'").select("folder", "specifier", F.explode(F.udf(folders_above, "array<string>")("folder")).alias("package"))
    scope = own.join(packages, "package").groupBy("folder", "specifier").agg(F.max_by(F.struct("package", "content"), F.length("package")).alias("s"))
    named = scope.select("folder", "specifier", "s.package", F.posexplode(instead("s.content", "specifier")).alias("turn", "target"))
    below_scope = named.where("target like './%'").select("folder", "specifier", "turn", F.lit(0).alias("rank"), F.lit(0).alias("form"), "package", F.substring("target", 3, 1 << 30).alias("below"))
    put = named.where("target not like './%'").select("folder", "specifier", "turn", F.col("package").alias("from"), "target")
    put = put.unionByName(bare.where("specifier not like '#%'").select("folder", "specifier", F.lit(0).alias("turn"), F.col("folder").alias("from"), F.col("specifier").alias("target")))
    asked = put.select("folder", "specifier", "turn", F.explode(places("from", "target")).alias("p")).select("folder", "specifier", "turn", "p.*")
    folders = fs.where("is_dir").select(F.col("path").alias("package"))
    there = asked.join(folders, "package").join(packages, "package", "left")
    tried = there.select("folder", "specifier", "turn", "rank", "package", F.posexplode(targets("content", "inside")).alias("form", "below"))
    files = fs.where("not is_dir").select(F.col("path").alias("file"))
    found = tried.unionByName(below_scope).withColumn("file", F.concat_ws("/", "package", "below")).join(files, "file").groupBy("folder", "specifier").agg(F.min_by("file", F.struct("turn", "rank", "form")).alias("resolved"))
    return paths.unionByName(bare.join(found, ["folder", "specifier"], "left"))
