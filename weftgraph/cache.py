"""A small result cache: least recently used entries leave first, old ones expire, a new data version clears it."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from dataclasses import dataclass
from typing import Any

MAX_ENTRIES, TTL_SECONDS, KEEP_SHARE = 1000, 30 * 60, 0.75


@dataclass
class CacheStatistics:
    hits: int = 0
    misses: int = 0
    evictions: int = 0
    expired: int = 0
    entries: int = 0
    limit: int = MAX_ENTRIES

    @property
    def operations(self) -> int:
        return self.hits + self.misses

    @property
    def hit_rate(self) -> float:
        return self.hits / self.operations if self.operations else 0.0

    @property
    def is_effective(self) -> bool:
        return self.hit_rate > 0.2 and self.entries > self.limit // 4

    @property
    def needs_tuning(self) -> bool:
        return bool(self.operations) and self.evictions / self.operations > 0.1


class ResultCache:
    """Keys hold everything that decides a result, the result limit included; values are small or lazy (DataFrames)."""

    def __init__(self, limit: int = MAX_ENTRIES, ttl: float = TTL_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self.version = ttl, clock, None
        self.held: OrderedDict[Hashable, tuple[float, Any]] = OrderedDict()
        self.statistics = CacheStatistics(limit=limit)

    def get(self, version: Hashable, key: Hashable, make: Callable[[], Any]) -> Any:
        """The value of key under this data version, made if it isn't held."""
        if version != self.version:
            self.clear()
            self.version = version
        s, now = self.statistics, self.clock()
        found = self.held.get(key)
        if found is not None and now - found[0] <= self.ttl:
            s.hits += 1
            self.held.move_to_end(key)
            return found[1]
        s.expired += found is not None
        s.misses += 1
        value = make()
        self.held[key] = now, value
        self.held.move_to_end(key)
        if len(self.held) > s.limit:
            while len(self.held) > int(s.limit * KEEP_SHARE):
                self.held.popitem(last=False)
                s.evictions += 1
        s.entries = len(self.held)
        return value

    def clear(self) -> None:
        self.held.clear()
        self.statistics.entries = 0
