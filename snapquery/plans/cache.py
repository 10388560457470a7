"""A small cache of planned frames by the text of their steps."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class CacheStatistics:
    hits: int
    misses: int
    entries: int

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


class PlanCache:
    """Least recently used entries go first, a quarter at a time; keys hold literal values."""

    def __init__(self, most: int = 256, enabled: bool = True) -> None:
        self.most, self.enabled = most, enabled
        self._held: OrderedDict[str, tuple[DataFrame, object]] = OrderedDict()
        self._hits = self._misses = 0
        self._lock = Lock()

    def get(self, key: str, plan: Callable[[], DataFrame], owner: object = None) -> DataFrame:
        """The frame of a key; ``owner`` is kept with it, so that what the key names by address stays alive."""
        if not self.enabled:
            return plan()
        with self._lock:
            if key in self._held:
                self._hits += 1
                self._held.move_to_end(key)
                return self._held[key][0]
            self._misses += 1
        made = plan()
        with self._lock:
            self._held[key] = (made, owner)
            if len(self._held) > self.most:
                for _ in range(max(1, self.most // 4)):
                    self._held.popitem(last=False)
        return made

    def clear(self) -> None:
        with self._lock:
            self._held.clear()

    def statistics(self) -> CacheStatistics:
        return CacheStatistics(self._hits, self._misses, len(self._held))


class Tracker:
    """Times of queries by their key: the last ``kept`` of each of the ``most`` queries that ran last; advice from ``learn`` runs on."""

    def __init__(self, kept: int = 100, learn: int = 5, slow_ms: float = 100.0, most: int = 1000) -> None:
        self.kept, self.learn, self.slow_ms, self.most = kept, learn, slow_ms, most
        self.times: OrderedDict[str, list[float]] = OrderedDict()

    def record(self, key: str, ms: float) -> None:
        self.times.setdefault(key, []).append(ms)
        del self.times[key][: -self.kept]
        self.times.move_to_end(key)
        while len(self.times) > self.most:
            self.times.popitem(last=False)

    def mean(self, key: str) -> float:
        times = self.times.get(key, [])
        return sum(times) / len(times) if times else 0.0

    def recommendations(self) -> list[tuple[str, str]]:
        out = []
        for key, times in self.times.items():
            if len(times) < self.learn:
                continue
            if self.mean(key) > self.slow_ms:
                out.append((key, f"slow: {self.mean(key):.0f} ms on average; persist the snapshot, or sort it by the filtered column"))
            half = len(times) // 2
            if sum(times[half:]) / (len(times) - half) < 0.8 * sum(times[:half]) / half:
                out.append((key, "faster of late: its plan and its data are warm"))
        return out
