"""The tree of a git commit as tables."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphweight.errors import DiffFileNotFound, GitFailed, NotAGitRepo, NotARefOrSnapshot

from .local_tree import SHAPE


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True, check=False)
    if done.returncode:
        raise GitFailed(done.stderr.decode(errors="replace").strip() or " ".join(args))
    return done.stdout


def is_git_repo(path: str) -> bool:
    try:
        return git(path, "rev-parse", "--is-inside-work-tree").strip() == b"true"
    except (GitFailed, OSError):
        return False


def repo_root(path: str) -> str:
    try:
        return git(path, "rev-parse", "--show-toplevel").decode().strip()
    except (GitFailed, OSError) as error:
        raise NotAGitRepo(path) from error


def commit_of(repo: str, ref: str) -> str:
    """SHA of the commit that a ref (a tag is peeled) names."""
    return git(repo, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}").decode().strip()


def classify(arg: str, repo: str) -> str:
    """'snapshot' for an existing file, 'ref' for what names a commit; else an error that says which it looked like."""
    if os.path.isfile(arg):
        return "snapshot"
    try:
        commit_of(repo, arg)
        return "ref"
    except GitFailed as error:
        if "/" in arg or ".json" in arg:
            raise DiffFileNotFound(arg) from error
        if not is_git_repo(repo):
            raise NotAGitRepo(repo) from error
        raise NotARefOrSnapshot(arg) from error


def git_tree(spark: SparkSession, repo: str, ref: str, root: str) -> tuple[DataFrame, DataFrame]:
    """Listing (SHAPE; sizes of folders 0, no times) and blobs (path, blob) of a commit, with paths as they are under root. Links and submodules are left out."""
    sha = commit_of(repo, ref)
    rows, blobs, folders = [], [], {root}
    for line in git(repo, "ls-tree", "-r", "-l", "-z", "--full-tree", sha).split(b"\0"):
        if not line:
            continue
        about, name = line.split(b"\t", 1)
        mode, kind, blob, size = about.split()
        if kind != b"blob" or mode == b"120000":
            continue
        path = os.path.join(root, name.decode("utf-8", "surrogateescape"))
        rows.append((path, False, int(size), None))
        blobs.append((path, blob.decode()))
        folder = os.path.dirname(path)
        while folder not in folders:
            folders.add(folder)
            folder = os.path.dirname(folder)
    rows += [(f, True, 0, None) for f in sorted(folders)]
    return spark.createDataFrame(rows, SHAPE), spark.createDataFrame(blobs, "path string, blob string")


def blob_contents(blobs: DataFrame, repo: str) -> DataFrame:
    """blobs(path, blob) to path, content; each task asks one git process."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("blob").to_pylist()
            out = git(repo, "cat-file", "--batch", data="".join(f"{b}\n" for b in wanted).encode())
            contents, at = [], 0
            for _ in wanted:
                end = out.index(b"\n", at)
                size = int(out[at:end].split()[-1])
                contents.append(out[end + 1 : end + 1 + size])
                at = end + size + 2
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(contents, pa.binary())], names=["path", "content"])

    return blobs.select("path", "blob").mapInArrow(read, "path string, content binary")
