"""Command line and interactive shell."""

from __future__ import annotations

import argparse
import os
import re
import shlex
import sys
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from graphweight import report as R
from graphweight.errors import EntryRequired, GraphError, InvalidSize, MutuallyExclusive, OverThreshold
from graphweight.operators import diff as D
from graphweight.operators.trace import TraceOptions
from graphweight.project import Tree, load, project_root
from graphweight.session import Session
from graphweight.sources.git_tree import classify, repo_root

SHELLS = ("bash", "fish", "zsh")
COMMANDS = "trace entry chain cut diff packages imports importers info set unset show help quit".split()


def size(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*(MB|KB|B)?\s*", text)
    if not m:
        raise InvalidSize(text)
    return int(float(m[1]) * {"MB": 1_000_000, "KB": 1_000}.get(m[2] or "B", 1))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="graphweight", description="Weighs what an entry file imports.")
    out.add_argument("--no-color", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--json", action="store_true")
    shared.add_argument("--format-version", type=int, choices=R.VERSIONS)
    shared.add_argument("--no-cache", action="store_true")
    shared.add_argument("-q", "--quiet", action="store_true")
    trace = commands.add_parser("trace", parents=[shared])
    trace.add_argument("entry")
    for name in ("diff", "save", "diff-from", "chain", "cut"):
        trace.add_argument(f"--{name}")
    trace.add_argument("--include-dynamic", action="store_true")
    trace.add_argument("--top", type=int, default=R.TOP)
    trace.add_argument("--top-modules", type=int, default=R.TOP_MODULES)
    trace.add_argument("--limit", type=int, default=R.LIMIT)
    trace.add_argument("--ignore", nargs="+", default=[])
    trace.add_argument("--max-weight")
    diff = commands.add_parser("diff", parents=[shared])
    diff.add_argument("a")
    diff.add_argument("b", nargs="?")
    diff.add_argument("--entry")
    diff.add_argument("--limit", type=int, default=R.LIMIT)
    packages = commands.add_parser("packages", parents=[shared])
    packages.add_argument("entry")
    packages.add_argument("--top", type=int, default=R.TOP)
    commands.add_parser("repl", parents=[shared]).add_argument("entry")
    commands.add_parser("completions").add_argument("shell", choices=SHELLS)
    return out


def completions(shell: str) -> str:
    """A script for the shell that completes commands, their options, and files for all else; made from the parser."""
    top = parser()
    commands = next(a for a in top._actions if isinstance(a, argparse._SubParsersAction)).choices
    options = {name: sorted(o for a in p._actions for o in a.option_strings if o.startswith("--")) for name, p in commands.items()}
    if shell == "fish":
        first = f"complete -c graphweight -n __fish_use_subcommand -f -a '{' '.join(commands)}'"
        rest = [f"complete -c graphweight -n '__fish_seen_subcommand_from {name}' -l {o[2:]}" for name, own in options.items() for o in own]
        return "\n".join([first, *rest]) + "\n"
    cases = "\n".join(f'    {name}) words="{" ".join(own)}" ;;' for name, own in options.items())
    body = f"""_graphweight() {{
  local words current="${{COMP_WORDS[COMP_CWORD]}}"
  case "${{COMP_WORDS[1]}}" in
{cases}
  esac
  [ "$COMP_CWORD" -eq 1 ] && words="{" ".join(commands)}"
  case "$COMP_CWORD:$current" in
    1:*|*:-*) COMPREPLY=($(compgen -W "$words" -- "$current")) ;;
    *) COMPREPLY=($(compgen -f -- "$current")) ;;
  esac
}}
complete -F _graphweight graphweight
"""
    return "autoload -U +X bashcompinit && bashcompinit\n" + body if shell == "zsh" else body


def emit(report: R.Report, args: argparse.Namespace) -> None:
    if args.json and not args.format_version:
        print("warning: --json without --format-version gives version 2", file=sys.stderr)
    print(report.json(args.format_version or 2) if args.json else report.text(), end="\n" if args.json else "")


def opened(spark: SparkSession, args: argparse.Namespace) -> Session:
    session = Session.open(spark, args.entry, use_cache=not args.no_cache)
    if not args.quiet:
        print(*R.load_status(session), sep="\n", file=sys.stderr)
    return session


def run_trace(spark: SparkSession, args: argparse.Namespace) -> int:
    modes = [f"--{m}" for m in ("chain", "cut", "diff", "diff-from") if getattr(args, m.replace("-", "_"))]
    if len(modes) > 1:
        raise MutuallyExclusive(" and ".join(modes))
    for name in ("top", "top_modules", "limit"):
        R.checked_number("--" + name.replace("_", "-"), getattr(args, name))
    limit = size(args.max_weight) if args.max_weight else None
    session = opened(spark, args)
    if args.save:
        D.save_snapshot(session.snapshot(), args.save)
    if args.chain:
        out = R.chain_report(session, args.chain, args.include_dynamic)
    elif args.cut:
        out = R.cut_report(session, args.cut, args.include_dynamic, args.top)
    elif args.diff_from:
        out = R.diff_report(D.load_snapshot(spark, args.diff_from), session.snapshot(), args.limit)
    elif args.diff:
        try:
            other = session.path_of(args.diff)
            if other == session.entry:
                print("warning: both sides are the same file", file=sys.stderr)
            out = R.diff_report(*session.diff_entry(args.diff), args.limit)
        except GraphError:
            out = R.diff_report(session.snapshot(), Session.open(spark, args.diff, use_cache=False).snapshot(), args.limit)
    else:
        out = R.trace_report(session, TraceOptions(args.include_dynamic, args.top, tuple(args.ignore)), args.top_modules)
    emit(out, args)
    if out.kind in ("chain", "cut"):
        return 0 if out.body["chain_count"] else 1
    weight = out.body.get("static_weight_bytes", 0) if out.kind == "trace" else 0
    if limit is not None and weight > limit:
        raise OverThreshold(R.size_text(weight), R.size_text(limit))
    return 0


def diff_side(spark: SparkSession, arg: str | None, entry: str | None) -> DataFrame:
    import os

    home = os.path.dirname(os.path.abspath(entry)) if entry else os.getcwd()
    kind = "tree" if arg is None else classify(arg, home)
    if kind == "snapshot":
        return D.load_snapshot(spark, arg)
    if not entry:
        raise EntryRequired()
    path = os.path.realpath(entry)
    root = project_root(path)
    tree = Tree.at_commit(spark, arg, repo_root(root)) if kind == "ref" else None
    return Session(spark, load(spark, path, root, tree)).snapshot()


def run_diff(spark: SparkSession, args: argparse.Namespace) -> int:
    R.checked_number("--limit", args.limit)
    emit(R.diff_report(diff_side(spark, args.a, args.entry), diff_side(spark, args.b, args.entry), args.limit), args)
    return 0


@dataclass(frozen=True)
class Settings:
    """Defaults of the shell's commands; options of one command replace them for it."""

    include_dynamic: bool = False
    top: int = R.TOP
    top_modules: int = R.TOP_MODULES
    ignore: tuple[str, ...] = ()
    json: bool = False


@dataclass(frozen=True)
class Command:
    name: str
    args: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)
    error: str | None = None


def parse_command(line: str) -> Command:
    """A shell line. Unknown commands and options, and missing arguments, are errors; numbers that are none are passed over."""
    try:
        words = shlex.split(line)
    except ValueError as error:
        return Command("error", error=str(error))
    if not words:
        return Command("help")
    name = {"?": "help", "exit": "quit"}.get(words[0], words[0])
    if name not in COMMANDS:
        return Command("error", error=f"unknown command: {words[0]}")
    args: list[str] = []
    options: dict = {}
    rest = words[1:]
    while rest:
        word = rest.pop(0)
        if name in ("set", "unset") or not word.startswith("--"):
            args.append(word)
        elif word in ("--json", "--include-dynamic", "--no-include-dynamic"):
            options[word.removeprefix("--no-").removeprefix("--").replace("-", "_")] = not word.startswith("--no-")
        elif word in ("--top", "--top-modules"):
            if rest and re.fullmatch(r"-?\d+", rest[0]):
                n = int(rest.pop(0))
                if n >= -1:
                    options[word[2:].replace("-", "_")] = n
        elif word == "--ignore":
            ignored = []
            while rest and not rest[0].startswith("--"):
                ignored.append(rest.pop(0))
            if ignored:
                options["ignore"] = tuple(ignored)
        else:
            return Command("error", error=f"unknown option: {word}")
    needed = {"entry": "a file", "chain": "a package or file", "cut": "a package or file", "diff": "a file", "imports": "a file", "importers": "a file", "info": "a package", "set": "an option", "unset": "an option"}
    if name in needed and not args:
        return Command("error", error=f"{name} needs {needed[name]}")
    return Command(name, tuple(args), options)


def history_file() -> Path | None:
    """Where the shell's lines are kept: below XDG_DATA_HOME or ~/.local/share; None if that cannot be written."""
    folder = Path(os.environ.get("XDG_DATA_HOME") or Path.home() / ".local" / "share") / "graphweight"
    try:
        folder.mkdir(parents=True, exist_ok=True)
    except OSError:
        return None
    return folder / "history"


class Shell:
    def __init__(self, session: Session):
        self.session, self.settings = session, Settings()

    def complete(self, prefix: str, command: str = "", limit: int = 20) -> list[str]:
        """Up to 20 completions in order: commands, packages and files, or options, by the command."""
        from pyspark.sql import functions as F

        if not command:
            return [c for c in sorted(COMMANDS) if c.startswith(prefix)][:limit]
        if command in ("set", "unset"):
            return [o for o in ("dynamic", "ignore", "top", "top-modules") if o.startswith(prefix)]
        out: list[str] = []
        nodes = self.session.graph.nodes
        if command in ("chain", "cut", "info"):
            out = [r[0] for r in nodes.where(F.col("package").startswith(prefix)).select("package").distinct().orderBy("package").limit(limit).collect()]
        if command in ("chain", "cut", "trace", "entry", "diff", "imports", "importers"):
            root = self.session.root.rstrip("/") + "/"
            out += [r[0].removeprefix(root) for r in nodes.where(F.col("path").startswith(root + prefix)).select("path").orderBy("path").limit(limit).collect()]
        return out[:limit]

    def set(self, name: str, *values: str) -> str:
        s = self.settings
        try:
            if name == "dynamic":
                self.settings = replace(s, include_dynamic=not s.include_dynamic if not values else values[0] in ("on", "true", "1", "yes"))
            elif name in ("top", "top-modules"):
                self.settings = replace(s, **{name.replace("-", "_"): R.checked_number(name, int(values[0]))})
            elif name == "ignore":
                self.settings = replace(s, ignore=tuple(values))
            else:
                return f"unknown option: {name}"
        except (ValueError, IndexError):
            return f"{name} needs a number"
        return self.show()

    def unset(self, name: str) -> str:
        field_ = {"dynamic": "include_dynamic", "top": "top", "top-modules": "top_modules", "ignore": "ignore"}.get(name)
        if not field_:
            return f"unknown option: {name}"
        self.settings = replace(self.settings, **{field_: getattr(Settings(), field_)})
        return self.show()

    def show(self) -> str:
        s = self.settings
        return f"dynamic {'on' if s.include_dynamic else 'off'}\ntop {s.top}\ntop-modules {s.top_modules}\nignore {' '.join(s.ignore) or '(none)'}"

    def run(self, line: str) -> str | None:
        """The answer to a line; None to leave."""
        command = parse_command(line)
        s = replace(self.settings, **command.options)
        args, session = command.args, self.session
        try:
            match command.name:
                case "error":
                    return f"error: {command.error}"
                case "quit":
                    return None
                case "help":
                    return "commands: " + ", ".join(COMMANDS)
                case "show":
                    return self.show()
                case "set":
                    return self.set(*args)
                case "unset":
                    return self.unset(args[0])
                case "entry":
                    session.set_entry(args[0])
                    return f"entry {session.entry_label()}"
                case "info":
                    row = session.info(args[0])
                    return f"{row['name']}  {R.plural(row['file_count'], 'file')}  {R.size_text(row['total_size_bytes'])}" if row else f"error: no such package: {args[0]}"
                case "trace":
                    own = session if not args else Session(session.spark, session.loaded)
                    if args:
                        own.set_entry(args[0])
                    out = R.trace_report(own, TraceOptions(s.include_dynamic, s.top, s.ignore), s.top_modules)
                case "chain":
                    out = R.chain_report(session, args[0], s.include_dynamic)
                case "cut":
                    out = R.cut_report(session, args[0], s.include_dynamic, s.top)
                case "diff":
                    out = R.diff_report(*session.diff_entry(args[0]), s.top)
                case "packages":
                    out = R.packages_report(session, s.top)
                case "imports":
                    out = R.links_report(session, session.imports(args[0]), "no imports")
                case "importers":
                    out = R.links_report(session, session.importers(args[0]), "no importers")
        except GraphError as error:
            return f"error: {error}" + (f"\nhint: {error.hint}" if error.hint else "")
        return out.json() if s.json else out.text().rstrip("\n")

    def completed(self, line: str, begin: int, prefix: str) -> list[str]:
        """Completions of the word that starts at a place of a line; the graph as it is now is asked."""
        before = line[:begin].split()
        return self.complete(prefix, before[0] if before else "")

    def _prompt(self) -> Path | None:
        """Completion by tab and the history of former shells, where there is a readline."""
        try:
            import readline
        except ImportError:  # not on every platform
            return None
        options: list[str] = []

        def completer(prefix: str, state: int) -> str | None:
            if state == 0:
                options[:] = self.completed(readline.get_line_buffer(), readline.get_begidx(), prefix)
            return options[state] if state < len(options) else None

        readline.set_completer(completer)
        readline.set_completer_delims(" ")
        readline.parse_and_bind("tab: complete")
        path = history_file()
        if path is not None and path.exists():
            readline.read_history_file(path)
        return path

    def loop(self) -> int:
        history = self._prompt()
        self.session.watch()
        try:
            while True:
                try:
                    line = input("> ")
                except (EOFError, KeyboardInterrupt):
                    return 0
                self.session.refresh()
                answer = self.run(line)
                if answer is None:
                    return 0
                print(answer)
        finally:
            if history is not None:
                import readline

                readline.write_history_file(history)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "completions":
        print(completions(args.shell), end="")
        return 0
    spark = spark or SparkSession.builder.appName("graphweight").getOrCreate()
    try:
        if args.command == "trace":
            return run_trace(spark, args)
        if args.command == "diff":
            return run_diff(spark, args)
        session = opened(spark, args)
        if args.command == "repl":
            return Shell(session).loop()
        emit(R.packages_report(session, R.checked_number("--top", args.top)), args)
        return 0
    except GraphError as error:
        print(f"error: {error}" + (f"\nhint: {error.hint}" if error.hint else ""), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
