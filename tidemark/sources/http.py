"""HTTP over an engine: dumps, queries and change streams, and a client for remote tables."""

from __future__ import annotations

import base64
import binascii
import io
import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from tidemark import errors
from tidemark.operators.access import REV
from tidemark.operators.index import REVISION, Query
from tidemark.sources import dump

#: Seconds after which an idle change stream sends an empty change.
KEEP_ALIVE = 30.0


class _Handler(BaseHTTPRequestHandler):
    engine: Any = None
    stopped: threading.Event

    def log_message(self, *args: Any) -> None:
        pass

    def _answer(self, code: int, body: str, kind: str = "application/json") -> None:
        data = body.encode()
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def _fail(self, code: int, message: str) -> None:
        self._answer(code, json.dumps({"err": message}) + "\n")

    def do_GET(self) -> None:
        parts = self.path.strip("/").split("/")
        if parts == ["dump"]:
            return self._dump(None)
        if parts == ["query"]:
            return self._query()
        if len(parts) == 2 and parts[0] in ("dump", "changes"):
            table = self.engine.table(parts[1])
            if table is None:
                return self._fail(404, f"table {parts[1]!r} not found")
            return self._dump([table]) if parts[0] == "dump" else self._changes(table)
        return self._fail(404, "not found")

    do_POST = do_GET

    def _dump(self, tables: list | None) -> None:
        out = io.StringIO()
        dump.write_json(self.engine.read(), out, tables)
        self._answer(200, out.getvalue())

    def _query(self) -> None:
        try:
            asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            key = base64.b64decode(asked.get("key") or "", validate=True)
        except (ValueError, binascii.Error) as e:
            return self._fail(400, str(e))
        table = self.engine.table(asked.get("table") or "")
        if table is None:
            return self._fail(404, f"table {asked.get('table')!r} not found")
        name = asked.get("index") or table.spec.primary.name
        try:
            table.spec.index(name)
        except errors.UnknownIndex as e:
            return self._fail(400, str(e))
        q = Query(name, key, int.from_bytes(key, "big") if name == REVISION else None)
        r = self.engine.read()
        found = r.lower_bound(table, q) if asked.get("lowerbound") else r.list(table, q)
        lines = (json.dumps({"rev": x[REV], "obj": dump.plain({c: x[c] for c in table.spec.columns})}) for x in found.toLocalIterator())
        self._answer(200, "".join(x + "\n" for x in lines), "application/x-ndjson")

    def _changes(self, table) -> None:
        with self.engine.write(table) as w:
            changes = w.changes(table)
        self.send_response(200)
        self.send_header("Content-Type", "application/x-ndjson")
        self.end_headers()
        last = time.time()
        try:
            while not self.stopped.is_set():
                found, watch = changes.next(self.engine.read())
                for c in found:
                    last = time.time()
                    self._line({"rev": c.rev, "deleted": c.deleted, "obj": dump.plain(c.obj)})
                if not watch.wait(0.2) and time.time() - last >= KEEP_ALIVE:
                    last = time.time()
                    self._line({"rev": 0, "deleted": False, "obj": None})
        except OSError:
            pass  # the client has gone
        finally:
            changes.close()

    def _line(self, x: dict) -> None:
        self.wfile.write((json.dumps(x) + "\n").encode())
        self.wfile.flush()


class Server:
    """Serves an engine; a context manager."""

    def __init__(self, engine, host: str = "127.0.0.1", port: int = 0) -> None:
        self._stopped = threading.Event()
        handler = type("Handler", (_Handler,), {"engine": engine, "stopped": self._stopped})
        self._server = ThreadingHTTPServer((host, port), handler)
        self._server.daemon_threads = True
        self.url = f"http://{host}:{self._server.server_address[1]}"

    def __enter__(self) -> Server:
        threading.Thread(target=self._server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_: Any) -> None:
        self._stopped.set()
        self._server.shutdown()
        self._server.server_close()


class RemoteTable:
    """A table behind a server; opener can be replaced by another transport with an open(request) method."""

    def __init__(self, url: str, name: str, opener: Any = None) -> None:
        self.url, self.name, self.opener = url.rstrip("/"), name, opener or urllib.request.build_opener()

    def set_transport(self, opener: Any) -> None:
        self.opener = opener

    def _rows(self, q: Query, lower: bool) -> Iterator[tuple[dict, int]]:
        body = json.dumps({"key": base64.b64encode(q.key).decode(), "table": self.name, "index": q.index, "lowerbound": lower}).encode()
        try:
            with self.opener.open(urllib.request.Request(f"{self.url}/query", data=body)) as got:
                for line in got:
                    x = json.loads(line)
                    yield x["obj"], x["rev"]
        except urllib.error.HTTPError as e:
            raise errors.TableError(json.loads(e.read()).get("err", str(e)), self.name) from e

    def get(self, q: Query) -> tuple[dict, int] | None:
        return next(self._rows(q, False), None)

    def list(self, q: Query) -> Iterator[tuple[dict, int]]:
        return self._rows(q, False)

    def lower_bound(self, q: Query) -> Iterator[tuple[dict, int]]:
        return self._rows(q, True)

    def changes(self) -> Iterator[dict]:
        """Changes as they come, without keep-alives."""
        with self.opener.open(f"{self.url}/changes/{self.name}") as got:
            for line in got:
                x = json.loads(line)
                if x["rev"]:
                    yield x
