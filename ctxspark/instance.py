"""One writer per index: a lock file on the driver's machine, a register of running processes, limits of memory, progress."""

from __future__ import annotations

import contextlib
import json
import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path


class Busy(RuntimeError):
    """Another process holds the lock."""


def alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


def _read(path: Path) -> dict:
    try:
        return json.loads(path.read_text())
    except (OSError, ValueError):
        return {}


@contextlib.contextmanager
def lock(folder: str, name: str = "index") -> Iterator[None]:
    """Hold folder/<name>.lock; a lock whose process has died is taken over, another one raises Busy."""
    path = Path(folder) / f"{name}.lock"
    path.parent.mkdir(parents=True, exist_ok=True)
    for _ in range(2):
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            owner = _read(path).get("pid")
            if owner is None or alive(owner):
                raise Busy(f"{path} is held by process {owner}") from None
            path.unlink(missing_ok=True)
    else:
        raise Busy(f"{path} was taken meanwhile")
    with os.fdopen(handle, "w") as file:
        json.dump({"pid": os.getpid(), "since": time.time()}, file)
    try:
        yield
    finally:
        path.unlink(missing_ok=True)


@contextlib.contextmanager
def registered(folder: str, what: str) -> Iterator[None]:
    """This process in the register for the time of the block."""
    path = Path(folder) / "running" / f"{os.getpid()}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"pid": os.getpid(), "what": what, "since": time.time()}))
    try:
        yield
    finally:
        path.unlink(missing_ok=True)


def running(folder: str) -> list[dict]:
    """Registered processes that are alive, by start; entries of dead ones are removed."""
    out = []
    for path in sorted((Path(folder) / "running").glob("*.json")):
        entry = _read(path)
        if entry and alive(entry["pid"]):
            out.append(entry)
        else:
            path.unlink(missing_ok=True)
    return sorted(out, key=lambda e: e["since"])


def resident_mb() -> float:
    """Resident memory of this process."""
    for line in Path("/proc/self/status").read_text().splitlines():
        if line.startswith("VmRSS:"):
            return int(line.split()[1]) / 1024
    return 0.0


class Watch:
    """Memory limits: above the soft one `relieve` is called, above the hard one check raises MemoryError."""

    def __init__(self, soft_mb: float, hard_mb: float, relieve: Callable[[], None] = lambda: None, measure: Callable[[], float] = resident_mb):
        if soft_mb > hard_mb:
            raise ValueError("the soft limit is above the hard one")
        self.soft_mb, self.hard_mb, self.relieve, self.measure = soft_mb, hard_mb, relieve, measure

    def check(self) -> float:
        used = self.measure()
        if used > self.soft_mb:
            self.relieve()
            used = self.measure()
        if used > self.hard_mb:
            raise MemoryError(f"{used:.0f} MB in use, {self.hard_mb:.0f} MB allowed")
        return used


class Progress:
    """Counts of work done, told to `say` at most once a second and at the end."""

    def __init__(self, total: int, say: Callable[[str], None] = print, clock: Callable[[], float] = time.monotonic):
        self.total, self.done, self.say, self._clock = total, 0, say, clock
        self.began = self._told = clock()

    def step(self, n: int = 1) -> None:
        self.done += n
        now = self._clock()
        if now - self._told >= 1 or self.done >= self.total:
            self._told = now
            self.say(f"{self.done}/{self.total} in {now - self.began:.1f} s")
