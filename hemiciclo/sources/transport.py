"""A client for an injected `open`: pacing, bounded retries, byte budgets. One stands in each reading task; nothing here touches the network by itself."""

from __future__ import annotations

import email.utils
import hashlib
import threading
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

RETRY = frozenset({403, 408, 425, 429, 500, 502, 503, 504})
MEMORY_LIMIT, DOWNLOAD_LIMIT, CHUNK = 64 << 20, 2 << 30, 1 << 20


class TooLarge(ValueError):
    """A response is longer than its budget."""


class Unavailable(RuntimeError):
    """No attempt succeeded."""


@dataclass
class Response:
    status: int
    read: Callable[[int], bytes]
    headers: Mapping[str, str] = field(default_factory=dict)
    url: str = ""


@dataclass(frozen=True)
class Fetched:
    url: str
    status: int
    content: bytes
    sha256: str
    headers: Mapping[str, str]


def retry_after(value: str | None, now: float | None = None) -> float:
    """Seconds of a Retry-After header: a number or a date; 0 for neither and for the past."""
    if not value:
        return 0.0
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        at = email.utils.parsedate_to_datetime(value).timestamp()
    except (TypeError, ValueError):
        return 0.0
    return max(0.0, at - (time.time() if now is None else now))


class Pacer:
    """At most one request each `interval` seconds, none before a server's cooldown is over."""

    def __init__(self, interval: float = 0.2, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.next, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            pause = max(0.0, self.next - now)
            self.next = max(self.next, now) + self.interval
        if pause:
            self.sleep(pause)

    def cool(self, seconds: float) -> None:
        with self.lock:
            self.next = max(self.next, self.clock() + seconds)


def read_bounded(read: Callable[[int], bytes], most: int) -> bytes:
    parts, size = [], 0
    while part := read(CHUNK):
        size += len(part)
        if size > most:
            raise TooLarge(f"more than {most} bytes")
        parts.append(part)
    return b"".join(parts)


class Client:
    """get(url) by `open(url) -> Response`: so many attempts, with growing pauses after the statuses that allow another, one other address after a 404."""

    def __init__(self, open_: Callable[[str], Response], *, pacer: Pacer | None = None, attempts: int = 3, backoff: float = 0.6, throttle: float = 60.0, fallback: Callable[[str], str | None] | None = None):
        self.open, self.pacer, self.attempts, self.backoff, self.throttle, self.fallback = open_, pacer or Pacer(), attempts, backoff, throttle, fallback

    def get(self, url: str, *, most: int = MEMORY_LIMIT) -> Fetched:
        last: object = None
        for k in range(self.attempts):
            self.pacer.wait()
            try:
                r = self.open(url)
            except OSError as e:
                last = e
                self.pacer.cool(self.backoff * 2**k)
                continue
            if r.status == 404 and self.fallback and (other := self.fallback(url)):
                self.pacer.wait()
                r = self.open(other)
            if r.status < 400:
                content = read_bounded(r.read, most)
                return Fetched(r.url or url, r.status, content, hashlib.sha256(content).hexdigest(), r.headers)
            last = r.status
            if r.status not in RETRY:
                break
            slow = self.throttle if r.status in (403, 429) else self.backoff
            self.pacer.cool(max(retry_after(r.headers.get("Retry-After")), slow * 2**k))
        raise Unavailable(f"{url}: {last}")
