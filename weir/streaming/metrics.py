"""Counters of running pipelines, as Prometheus text over HTTP."""

from __future__ import annotations

import json
import threading
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql.streaming import StreamingQueryListener

COUNTERS = ("rows_read", "rows_written", "commits", "errors", "source_next_ns", "send_wait_ns", "write_ns", "commit_ns")
GAUGES = ("consumer_lag",)


class Metrics:
    def __init__(self, pipeline: str):
        self.pipeline, self.lock = pipeline, threading.Lock()
        self.values: dict[str, float] = defaultdict(float)

    def add(self, name: str, value: float = 1) -> None:
        with self.lock:
            self.values[name] += value

    def put(self, name: str, value: float) -> None:
        with self.lock:
            self.values[name] = value

    def text(self) -> str:
        lines = []
        with self.lock:
            for kind, names in (("counter", COUNTERS), ("gauge", GAUGES)):
                for n in names:
                    lines += [f"# TYPE weir_{n} {kind}", f'weir_{n}{{pipeline="{self.pipeline}"}} {self.values[n]:g}']
        return "\n".join(lines) + "\n"


class Listener(StreamingQueryListener):
    """Takes each micro-batch's progress into the counters."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p, m = event.progress, self.metrics
        m.add("rows_read", p.numInputRows)
        took = p.durationMs or {}
        m.add("source_next_ns", 1e6 * (took.get("latestOffset", 0) + took.get("getBatch", 0)))
        m.add("commit_ns", 1e6 * (took.get("walCommit", 0) + took.get("commitOffsets", 0)))
        m.put("consumer_lag", sum(lag(s) for s in p.sources))

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.metrics.add("errors")


def lag(source) -> float:
    """Messages between where a source is and where it ends now, as far as it says."""
    own = source.metrics or {}
    for k in ("avgOffsetsBehindLatest", "maxOffsetsBehindLatest"):
        if k in own:
            return float(own[k])
    try:
        end, latest = json.loads(source.endOffset or "{}"), json.loads(source.latestOffset or "{}")
    except (TypeError, ValueError):
        return 0.0
    if not isinstance(end, dict) or not isinstance(latest, dict):
        return 0.0
    total = 0.0
    for topic, parts in latest.items():
        for part, to in parts.items() if isinstance(parts, dict) else ():
            at = end.get(topic, {}).get(part, 0) if isinstance(end.get(topic), dict) else 0
            if isinstance(to, int) and isinstance(at, int):
                total += to - at
    return total


def serve(metrics: Metrics, address: str) -> ThreadingHTTPServer:
    """Answer ``/metrics`` at ``host:port`` (port 0: any free one) until ``shutdown``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            body = metrics.text().encode() if self.path == "/metrics" else b""
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    host, _, port = address.rpartition(":")
    server = ThreadingHTTPServer((host, int(port)), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
