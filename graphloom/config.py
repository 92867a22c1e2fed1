"""The configuration of a graph, validated once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from graphloom.serving import CacheCleaner, Pruner

MINUTE_MS = 60_000


@dataclass(frozen=True)
class Config:
    """``mode`` batch computes every query; serving keeps results for ``result_ttl`` ms and runs the
    plugins: by default one drops expired segments every five minutes, one expired results every minute."""

    name: str
    graph_type: str
    segment_max_edges: int = 1_000_000
    segment_ttl: int = 24 * 60 * MINUTE_MS
    result_ttl: int = 30 * MINUTE_MS
    algorithms: tuple[str, ...] = ("pagerank", "salsa")
    mode: str = "serving"
    cache_key: str = "all_options"
    plugins: tuple[Callable, ...] = (Pruner, CacheCleaner)

    def __post_init__(self) -> None:
        if not self.name or not isinstance(self.name, str):
            raise ValueError("name must be a non-empty string")
        if self.graph_type not in ("directed", "bipartite"):
            raise ValueError("graph_type must be directed or bipartite")
        if self.mode not in ("serving", "batch"):
            raise ValueError("mode must be serving or batch")
        if self.cache_key not in ("all_options", "compat"):
            raise ValueError("cache_key must be all_options or compat")
        for option in ("segment_max_edges", "segment_ttl", "result_ttl"):
            value = getattr(self, option)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{option} must be a positive integer")
