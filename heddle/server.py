"""The engine over HTTP, for a trusted network: there is no authentication, so it binds to this machine unless told otherwise."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlparse

from pyspark.sql import functions as F

from .engine import Engine
from .functions import FUNCTIONS
from .lang.parser import parse
from .operators.registry import INPUTS, OPERATIONS, OUTPUTS, TRANSFORMS
from .operators.scalar import OPERATORS
from .stream import KEY, PART


class Endpoints:
    """What can be asked: a method for each path, with its query's values and its body."""

    def __init__(self, engine: Engine):
        self.engine, self.lock = engine, threading.Lock()

    def ask(self, path: str, query: dict[str, str], body: str) -> Any:
        run = getattr(self, "at_" + path.strip("/").replace("/", "_"), None)
        if run is None:
            raise KeyError(path)
        with self.lock:
            return run(query, body)

    def at_ds(self, query: dict[str, str], body: str) -> Any:
        return [self.engine.describe(n) for n in self.engine.streams]

    def at_ds_sample(self, query: dict[str, str], body: str) -> Any:
        return self.rows(self.engine.streams[query["name"]].df, int(query.get("limit", 5)))

    def at_ds_part(self, query: dict[str, str], body: str) -> Any:
        df = self.engine.streams[query["name"]].df
        return self.rows(df.filter((F.col(PART) if PART in df.columns else F.spark_partition_id()) == int(query["part"])), int(query.get("limit", 5)))

    def at_ds_persist(self, query: dict[str, str], body: str) -> Any:
        s = self.engine.streams[query["name"]]
        self.engine.streams[query["name"]] = s.but(df=s.df.persist())
        return True

    def at_ds_renounce(self, query: dict[str, str], body: str) -> Any:
        self.engine.renounce(query["name"])
        return True

    def at_ds_lineage(self, query: dict[str, str], body: str) -> Any:
        return self.engine.lineage(query["name"])

    def at_entities(self, query: dict[str, str], body: str) -> Any:
        e = self.engine
        return {"operators": sorted({n for n, _ in OPERATORS}), "functions": sorted({*FUNCTIONS, *e.functions}), "transforms": sorted({v.name for v in TRANSFORMS.values()} | set(e.transforms)), "operations": sorted(v.name for v in OPERATIONS.values()), "inputs": sorted(v.name for v in INPUTS.values()), "outputs": sorted(v.name for v in OUTPUTS.values()), "procedures": sorted(e.procedures)}

    def at_exec_expr(self, query: dict[str, str], body: str) -> Any:
        return self.engine.evaluate(body)

    def at_exec_parse(self, query: dict[str, str], body: str) -> Any:
        return [s.kind for s in parse(body)]

    def at_exec_script(self, query: dict[str, str], body: str) -> Any:
        self.engine.execute(body)
        return list(self.engine.streams)

    def at_options(self, query: dict[str, str], body: str) -> Any:
        return self.engine.options

    def at_variables(self, query: dict[str, str], body: str) -> Any:
        return self.engine.plain_values()

    @staticmethod
    def rows(df: Any, limit: int) -> list[Any]:
        return [{"key": r[KEY], "record": {k: v for k, v in r.asDict(True).items() if k not in (KEY, PART)}} for r in df.limit(limit).collect()]


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 9595) -> ThreadingHTTPServer:
    """A server in a thread of its own; shutdown() ends it."""
    endpoints = Endpoints(engine)

    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            url = urlparse(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            try:
                status, out = 200, endpoints.ask(url.path, {k: v[0] for k, v in parse_qs(url.query).items()}, body)
            except KeyError as e:
                status, out = 404, f"not found: {e.args[0]}"
            except Exception as e:  # noqa: BLE001  the caller is told of any failure
                status, out = 400, f"{type(e).__name__}: {e}"
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = reply

        def log_message(self, *args: Any) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
