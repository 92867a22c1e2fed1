"""What serves queries besides the plans: a cache with expiry, periodic plugins and telemetry. All on the driver."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Clock = Callable[[], int]


def monotonic_ms() -> int:
    return time.monotonic_ns() // 1_000_000


class Store(Protocol):
    """A cache by key; a ``ttl`` of None never expires."""

    def get(self, key: object) -> tuple[bool, Any]: ...
    def put(self, key: object, value: Any, ttl: int | None) -> None: ...
    def delete(self, key: object) -> None: ...
    def clear(self) -> None: ...


class MemoryStore:
    """A Store in the driver's memory."""

    def __init__(self, clock: Clock = monotonic_ms, on_drop: Callable[[Any], None] | None = None) -> None:
        self._clock, self._on_drop = clock, on_drop
        self._held: dict[object, tuple[Any, int | None]] = {}
        self._lock = threading.RLock()

    def get(self, key: object) -> tuple[bool, Any]:
        """(True, value), or (False, None) if there is none or it has expired; an expired one is dropped."""
        with self._lock:
            if key not in self._held:
                return False, None
            value, until = self._held[key]
            if until is not None and until <= self._clock():
                self.delete(key)
                return False, None
            return True, value

    def put(self, key: object, value: Any, ttl: int | None) -> None:
        with self._lock:
            self._held[key] = (value, None if ttl is None else self._clock() + ttl)

    def delete(self, key: object) -> None:
        with self._lock:
            old = self._held.pop(key, None)
        if old is not None and self._on_drop:
            self._on_drop(old[0])

    def clear(self) -> None:
        for key in list(self._held):
            self.delete(key)

    def clean_expired(self) -> int:
        """Drop what has expired and say how much that was; entries without expiry stay."""
        now = self._clock()
        stale = [k for k, (_, until) in list(self._held.items()) if until is not None and until <= now]
        for key in stale:
            self.delete(key)
        return len(stale)


def live_entries(entries: DataFrame, now: Column) -> DataFrame:
    """The rows of a persisted cache (``expires_at``, null for never) that haven't expired."""
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


Handler = Callable[[str, dict, float], None]


class Telemetry:
    """Spans of work: handlers are told of ``name.start``, ``name.stop`` and ``name.exception`` with the seconds taken."""

    def __init__(self) -> None:
        self.handlers: list[Handler] = []

    def attach(self, handler: Handler) -> None:
        self.handlers.append(handler)

    def _tell(self, event: str, meta: dict, seconds: float) -> None:
        for handler in self.handlers:
            handler(event, meta, seconds)

    @contextmanager
    def span(self, name: str, **meta: Any) -> Iterator[dict]:
        """Metadata put into the yielded dict is told at the end."""
        began = time.perf_counter()
        self._tell(f"{name}.start", dict(meta), 0.0)
        try:
            yield meta
        except BaseException as error:
            self._tell(f"{name}.exception", meta | {"error": error}, time.perf_counter() - began)
            raise
        self._tell(f"{name}.stop", meta, time.perf_counter() - began)


class PeriodicPlugin:
    """Calls ``run(graph)`` every ``interval`` ms until stopped; ``tick`` does so once, for tests and schedulers."""

    name = "plugin"

    def __init__(self, graph: Any, interval: int) -> None:
        if isinstance(interval, bool) or not isinstance(interval, int) or interval < 1:
            raise ValueError("interval must be a positive integer")
        self.graph, self.interval = graph, interval
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def run(self) -> int:
        raise NotImplementedError

    def tick(self) -> int:
        with self.graph.telemetry.span(f"plugin.{self.name}", graph=self.graph.config.name) as meta:
            meta["count"] = self.run()
            return meta["count"]

    def start(self) -> None:
        def loop() -> None:
            while not self._stop.wait(self.interval / 1000):
                with suppress(Exception):  # telemetry has been told; the next turn may succeed
                    self.tick()

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()


class Pruner(PeriodicPlugin):
    """Drops closed segments older than the graph's ``segment_ttl``."""

    name = "prune"

    def __init__(self, graph: Any, interval: int = 5 * 60_000) -> None:
        super().__init__(graph, interval)

    def run(self) -> int:
        return self.graph.prune_expired()


class CacheCleaner(PeriodicPlugin):
    """Drops expired results."""

    name = "cache_clean"

    def __init__(self, graph: Any, interval: int = 60_000) -> None:
        super().__init__(graph, interval)

    def run(self) -> int:
        return self.graph.store.clean_expired()
