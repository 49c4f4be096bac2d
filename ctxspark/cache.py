"""A small cache of answers on the driver: least recently used first out, entries expire."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any


class Cache:
    """At most `size` values, each for `seconds`; safe for several threads. A size of 0 keeps nothing."""

    def __init__(self, size: int = 256, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self._clock = size, seconds, clock
        self._values: OrderedDict[Hashable, tuple[float, Any]] = OrderedDict()
        self._lock = threading.Lock()
        self.hits = self.misses = 0

    def get(self, key: Hashable, default: Any = None) -> Any:
        with self._lock:
            ends, value = self._values.get(key, (float("-inf"), default))
            if ends <= self._clock():
                self._values.pop(key, None)
                self.misses += 1
                return default
            self._values.move_to_end(key)
            self.hits += 1
            return value

    def put(self, key: Hashable, value: Any) -> None:
        with self._lock:
            self._values[key] = self._clock() + self.seconds, value
            self._values.move_to_end(key)
            while len(self._values) > self.size:
                self._values.popitem(last=False)

    def clear(self) -> None:
        with self._lock:
            self._values.clear()

    def __len__(self) -> int:
        return len(self._values)
