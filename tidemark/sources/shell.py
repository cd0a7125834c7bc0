"""The operator shell: commands over an engine's tables, for scripts and people."""

from __future__ import annotations

import argparse
import difflib
import io
import re
import time
from collections.abc import Callable
from pathlib import Path

from tidemark import errors
from tidemark.sources import dump


class Shell:
    """run("db/list t key -i index") and so on; each command returns its output."""

    def __init__(self, engine) -> None:
        self.engine = engine
        self.commands: dict[str, Callable[[list[str]], str]] = {
            "db": self._db,
            "db/show": self._show,
            "db/insert": self._insert,
            "db/delete": self._delete,
            "db/cmp": self._cmp,
            "db/empty": self._empty,
            "db/watch": self._watch,
            "db/initialized": self._initialized,
            "db/dump": self._dump,
            **{f"db/{k}": (lambda args, k=k: self._query(k, args)) for k in ("get", "list", "prefix", "lowerbound")},
        }

    def run(self, line: str) -> str:
        name, *args = line.split()
        if name not in self.commands:
            raise ValueError(f"unknown command {name}")
        return self.commands[name](args)

    def _table(self, name: str):
        t = self.engine.table(name)
        if t is None:
            raise errors.TableNotRegistered(f"not found; there are {', '.join(x.name for x in self.engine.tables())}", name)
        return t

    @staticmethod
    def _options(args: list[str], *flags: str) -> argparse.Namespace:
        p = argparse.ArgumentParser(prog="db", exit_on_error=False, add_help=False)
        known = {"o": ("-o", {"default": ""}), "columns": ("--columns", {"default": ""}), "format": ("-f", {"default": "table", "dest": "format"}), "index": ("-i", {"default": "", "dest": "index"}), "delete": ("--delete", {"action": "store_true"}), "timeout": ("--timeout", {"default": "5s"}), "grep": ("--grep", {"default": ""})}
        for f in flags:
            p.add_argument(known[f][0], **known[f][1])
        p.add_argument("rest", nargs="*")
        return p.parse_intermixed_args(args)

    @staticmethod
    def _seconds(text: str) -> float:
        m = re.fullmatch(r"([\d.]+)(ms|s|m)?", text)
        if not m:
            raise ValueError(f"not a duration: {text}")
        return float(m[1]) * {"ms": 0.001, "s": 1, "m": 60, None: 1}[m[2]]

    @staticmethod
    def _out(text: str, path: str) -> str:
        if path:
            Path(path).write_text(text)
            return ""
        return text

    def _show_rows(self, table, frame, o) -> str:
        out = io.StringIO()
        dump.write_objects(table, frame, out, [c for c in o.columns.split(",") if c] or None, o.format)
        return self._out(out.getvalue(), o.o)

    def _db(self, args: list[str]) -> str:
        rows = self.engine.describe().collect()
        return dump.aligned([["Name", "Objects", "Zombies", "Indexes", "Initializers", "Lock", "Revision"], *[[str(x) for x in r] for r in rows]])

    def _show(self, args: list[str]) -> str:
        o = self._options(args, "o", "columns", "format")
        t = self._table(o.rest[0])
        return self._show_rows(t, self.engine.read().all(t), o)

    def _query(self, kind: str, args: list[str]) -> str:
        o = self._options(args, "o", "columns", "format", "index", "delete")
        t, key = self._table(o.rest[0]), o.rest[1] if len(o.rest) > 1 else ""
        q = t.spec.index(o.index).query_from_string(key)
        r = self.engine.read()
        found = {"get": r.get, "list": r.list, "prefix": r.prefix, "lowerbound": r.lower_bound}[kind](t, q)
        text = self._show_rows(t, found, o)
        if o.delete:
            with self.engine.write(t) as w:
                w.delete_where(t, found)
        return text

    def _files(self, args: list[str]) -> tuple:
        t, *paths = args
        table = self._table(t)
        return table, [x for p in paths for x in dump.read_objects(table, Path(p).read_text())]

    def _insert(self, args: list[str]) -> str:
        """All files in one transaction; any failure leaves none."""
        with self.engine.write(self._table(args[0])) as w:
            table, found = self._files(args)
            for x in found:
                w.insert(table, x)
        return ""

    def _delete(self, args: list[str]) -> str:
        with self.engine.write(self._table(args[0])) as w:
            table, found = self._files(args)
            for x in found:
                w.delete(table, x)
        return ""

    def _cmp(self, args: list[str]) -> str:
        """Compares with a file of aligned columns, which may be some of the table's, again and again until the time is up."""
        o = self._options(args, "timeout", "grep")
        table, want = self._table(o.rest[0]), [x.rstrip() for x in Path(o.rest[1]).read_text().splitlines() if x.strip()]
        names = re.split(r"\s{2,}", want[0].strip())
        until = time.time() + self._seconds(o.timeout)
        while True:
            frame, watch = self.engine.read().all_watch(table)
            out = io.StringIO()
            dump.write_objects(table, frame, out, names)
            lines = out.getvalue().splitlines()
            lines = lines[:1] + [x for x in lines[1:] if not o.grep or re.search(o.grep, x)]
            norm = lambda ls: [re.sub(r"\s{2,}", "  ", x.strip()) for x in ls]
            if norm(lines) == norm(want):
                return ""
            if time.time() >= until:
                raise AssertionError("table mismatch:\n" + "\n".join(x for x in difflib.ndiff(norm(want), norm(lines)) if x[0] != "?"))
            watch.wait(min(0.1, max(0.0, until - time.time())))

    def _empty(self, args: list[str]) -> str:
        for name in args:
            if n := self.engine.read().num_objects(self._table(name)):
                raise AssertionError(f"table {name} has {n} objects")
        return ""

    def _watch(self, args: list[str], rounds: int = 1, deleted: str = "deleted") -> str:
        """The changes of some rounds, ten a second at most; an endless stream is stream()."""
        return "".join(x for _, x in zip(range(rounds), self.stream(args[0]), strict=False))

    def stream(self, name: str):
        table = self._table(name)
        with self.engine.write(table) as w:
            changes = w.changes(table)
        try:
            while True:
                found, watch = changes.next(self.engine.read())
                lines = ["   ".join(["~" * c.deleted + x for x in dump.cells(table, c.obj)]) for c in found]
                yield "".join(x + "\n" for x in lines)
                time.sleep(0.1)
                watch.wait(1)
        finally:
            changes.close()

    def _initialized(self, args: list[str]) -> str:
        o = self._options(args, "timeout")
        until = time.time() + self._seconds(o.timeout)
        for t in [self._table(n) for n in o.rest] or self.engine.tables():
            done, watch = self.engine.read().initialized_watch(t)
            if not done and not watch.wait(max(0.0, until - time.time())):
                raise TimeoutError(f"table {t.name} waits for {', '.join(self.engine.read().pending_initializers(t))}")
        return ""

    def _dump(self, args: list[str]) -> str:
        o = self._options(args, "o")
        out = io.StringIO()
        dump.write_json(self.engine.read(), out, [self._table(n) for n in o.rest] or None)
        return self._out(out.getvalue(), o.o)

    def complete(self, text: str) -> list[str]:
        """Completions of the last word: commands, then table names, then columns of the table."""
        parts = text.split(" ")
        if len(parts) == 1:
            return sorted(c for c in self.commands if c.startswith(text))
        table = self.engine.table(parts[1]) if len(parts) > 2 else None
        names = dump.header(table) if table else [t.name for t in self.engine.tables()]
        return sorted(n for n in names if n.startswith(parts[-1]))
