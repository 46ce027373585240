"""A client of a schema registry's HTTP interface, for Avro topics."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from functools import cache

from ..errors import ConfigError
from . import avro


class Registry:
    def __init__(self, url: str, timeout: float = 10):
        self.url, self.timeout = url.rstrip("/"), timeout

    def _call(self, method: str, path: str, body: dict | None = None) -> dict | None:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"{self.url}{path}", data, {"Content-Type": "application/vnd.schemaregistry.v1+json"}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read() or b"{}")
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            raise ConfigError(f"the schema registry refuses {method} {path}: {e.code} {e.read()[:200].decode(errors='replace')}") from None
        except OSError as e:
            raise ConfigError(f"the schema registry at {self.url} can't be reached: {e}") from None

    @staticmethod
    def subject(topic: str) -> str:
        return f"{topic}-value"

    def latest(self, topic: str) -> tuple[int, str] | None:
        """(number, schema) of a topic's latest version."""
        found = self._call("GET", f"/subjects/{urllib.parse.quote(self.subject(topic), safe='')}/versions/latest")
        return (found["id"], found["schema"]) if found else None

    def schema(self, number: int) -> str:
        found = self._call("GET", f"/schemas/ids/{number}")
        if found is None:
            raise ConfigError(f"the schema registry has no schema {number}")
        return found["schema"]

    def register(self, topic: str, schema: str) -> int:
        """Number of the schema under the topic's subject; it must read what its last version wrote."""
        subject = urllib.parse.quote(self.subject(topic), safe="")
        before = self.latest(topic)
        if before is not None:
            avro.check_backward(schema, before[1])
        self._call("PUT", f"/config/{subject}", {"compatibility": "BACKWARD"})
        answer = self._call("POST", f"/subjects/{subject}/versions", {"schema": schema, "schemaType": "AVRO"})
        if answer is None:
            raise ConfigError(f"the schema registry does not take the subject {subject}")
        return answer["id"]


@cache
def writer_schema(url: str, number: int) -> str:
    """A schema by its number, asked for once a worker."""
    return Registry(url).schema(number)
