"""Small files that the driver keeps about a run: atomic JSON, an event log, a checkpoint that belongs to one request, contracts."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import tomllib
from collections.abc import Mapping
from pathlib import Path
from typing import Any


class StateMismatch(ValueError):
    """A checkpoint belongs to another request."""


def write_json(path: str | Path, payload: Any) -> None:
    """All or nothing: a temporary file beside the target, flushed, then renamed over it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(payload, f, ensure_ascii=False, sort_keys=True, default=str)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def append_event(path: str | Path, event: Mapping[str, Any]) -> None:
    """One line of an event log, on disk when it returns."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(event, ensure_ascii=False, sort_keys=True, default=str) + "\n")
        f.flush()
        os.fsync(f.fileno())


def identity(request: Mapping[str, Any]) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()


class Checkpoint:
    """status (running, completed, failed), done items and failures of one request; a file of another request is refused."""

    def __init__(self, path: str | Path, request: Mapping[str, Any], *, resume: bool = True):
        self.path, self.request = Path(path), identity(request)
        self.state: dict[str, Any] = {"request": self.request, "status": "running", "done": {}, "failures": {}}
        if resume and self.path.exists():
            found = json.loads(self.path.read_text(encoding="utf-8"))
            if found.get("request") != self.request:
                raise StateMismatch(f"{self.path} belongs to another request")
            self.state |= found | {"status": "running"}

    def pending(self, keys: list[str]) -> list[str]:
        return [k for k in dict.fromkeys(keys) if k not in self.state["done"]]

    def done(self, key: str, value: Any) -> None:
        self.state["done"][key] = value
        self.state["failures"].pop(key, None)
        write_json(self.path, self.state)

    def failed(self, key: str, error: BaseException) -> None:
        self.state["failures"][key] = {"type": type(error).__name__, "message": str(error)}
        write_json(self.path, self.state)

    def finish(self) -> str:
        self.state["status"] = "failed" if self.state["failures"] else "completed"
        write_json(self.path, self.state)
        return self.state["status"]


#: What a contract file may set, with its defaults.
CONTRACT = {"review_threshold": 0.7, "provider": "regex", "max_characters": 24_000, "overlap": 500, "max_chunks": 100}


def load_contracts(path: str | Path) -> dict[str, dict[str, Any]]:
    """Tables of a TOML file, a contract each; unknown keys and thresholds outside 0..1 are errors."""
    found = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    out = {}
    for name, table in found.items():
        if odd := set(table) - set(CONTRACT):
            raise ValueError(f"{name}: unknown {sorted(odd)}")
        out[name] = CONTRACT | table
        if not 0 <= out[name]["review_threshold"] <= 1:
            raise ValueError(f"{name}: review_threshold lies between 0 and 1")
    return out
