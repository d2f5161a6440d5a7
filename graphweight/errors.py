"""What can go wrong, with a hint where there is one."""

from __future__ import annotations


class GraphError(Exception):
    hint: str | None = None

    def __init__(self, *details: object):
        super().__init__(self.text.format(*details))
        self.details = details

    text = "{}"


def _kind(name: str, text: str, hint: str | None = None) -> type[GraphError]:
    return type(name, (GraphError,), {"text": text, "hint": hint, "__doc__": text})


EntryNotFound = _kind("EntryNotFound", "entry not found: {}", "give a path from the current folder or the project's root")
EntryIsDirectory = _kind("EntryIsDirectory", "entry is a directory: {}", "give a file, such as its index or main module")
EntryNotInGraph = _kind("EntryNotInGraph", "entry is not part of the graph: {}", "only files that the first entry reaches can be entries")
UnsupportedFileType = _kind("UnsupportedFileType", "unsupported file type: {}", "TypeScript, JavaScript and Python files can be traced")
SnapshotRead = _kind("SnapshotRead", "cannot read snapshot {}: {}")
SnapshotParse = _kind("SnapshotParse", "cannot parse snapshot {}: {}", "snapshots are written by --save")
SnapshotWrite = _kind("SnapshotWrite", "cannot write snapshot {}: {}")
MutuallyExclusive = _kind("MutuallyExclusive", "{} cannot be used together", "choose one")
TargetIsEntry = _kind("TargetIsEntry", "{} is the entry itself", "choose a package or another file")
NotAGitRepo = _kind("NotAGitRepo", "not inside a git repository: {}")
NotARefOrSnapshot = _kind("NotARefOrSnapshot", "not a snapshot file or a git ref: {}")
DiffFileNotFound = _kind("DiffFileNotFound", "snapshot file not found: {}")
EntryRequired = _kind("EntryRequired", "--entry is required to compare a git ref or the working tree")
GitFailed = _kind("GitFailed", "git failed: {}")
InvalidNumber = _kind("InvalidNumber", "{} must be -1 or more, not {}", "-1 stands for all")
InvalidSize = _kind("InvalidSize", "invalid size: {}", "valid are 5MB, 500KB, 100B")
OverThreshold = _kind("OverThreshold", "static weight {} is over the limit of {}")
CacheUnusable = _kind("CacheUnusable", "cache cannot be used: {}")
