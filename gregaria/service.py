"""The reads and updates as a service: JSON over HTTP, a thread a request.

``POST /ic9`` with ``{"person_id": 1, "max_ms": 946684800000}`` answers with the
rows of the read; ``POST /iu8`` with one request or a list of them stores a new
version and answers with its number. Reads see the newest version that this
service has opened or stored; updates go one after the other.
"""

from __future__ import annotations

import inspect
import json
import signal
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gregaria.plans import complex_reads, short_reads
from gregaria.plans.updates import REQUESTS, apply_updates
from gregaria.sources import snapshot

READS: dict[str, Callable[..., DataFrame]] = {f"ic{i}": getattr(complex_reads, f"ic{i}") for i in range(1, 15)} | {f"is{i}": getattr(short_reads, f"is{i}") for i in range(1, 8)}


class Service:
    """All procedures over the graph below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.graph = snapshot.open_version(spark, root)
        self._writing = threading.Lock()

    def call(self, name: str, arguments: Any) -> Any:
        """Rows of a read as dicts, or the version that an update made. Arguments that don't fit are a TypeError."""
        if name in READS:
            bound = inspect.signature(READS[name]).bind(self.graph, **arguments)
            return [row.asDict(recursive=True) for row in READS[name](*bound.args, **bound.kwargs).collect()]
        return self._update(name, arguments if isinstance(arguments, list) else [arguments])

    def _update(self, kind: str, requests: list[dict]) -> dict:
        schema = REQUESTS[kind]
        if unknown := {c for r in requests for c in r} - set(self.spark.createDataFrame([], schema).columns):
            raise TypeError(f"{kind} has no {sorted(unknown)}")
        rows = self.spark.createDataFrame([json.dumps(r) for r in requests], "string").select(F.from_json("value", schema).alias("r")).select("r.*")
        with self._writing:
            updated = apply_updates(snapshot.open_version(self.spark, self.root), {kind: rows})
            snapshot.append(updated, self.root)
            updated.release()
            self.graph = snapshot.fold(self.spark, self.root)
            return {"version": self.graph.origin[1]}


def server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server for ``service``, not yet started; port 0 takes a free one (``server_address``)."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: Any) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer(200, {name: [p for p in inspect.signature(f).parameters if p != "g"] for name, f in READS.items()} | REQUESTS)

        def do_POST(self) -> None:
            name = self.path.strip("/")
            if name not in READS and name not in REQUESTS:
                return self._answer(404, {"error": f"no procedure {name}"})
            try:
                arguments = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                self._answer(200, service.call(name, arguments))
            except (TypeError, ValueError) as error:
                self._answer(400, {"error": str(error)})
            except Exception as error:  # the connection stays usable whatever a job has met
                self._answer(500, {"error": str(error)[:1000]})

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(spark: SparkSession, root: str, host: str = "127.0.0.1", port: int = 9090) -> None:
    """Serves until the process is interrupted, then lets running requests end."""
    running = server(Service(spark, root), host, port)
    signal.signal(signal.SIGINT, lambda *_: threading.Thread(target=running.shutdown).start())
    running.serve_forever()
    running.server_close()
