"""Batches of targets with a journal: a run that was broken off goes on where it stopped, under the same options only."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import asdict

from ..model import ScanOptions


def _identity(path: str) -> dict:
    try:
        s = os.stat(path)
        return {"size": s.st_size, "mtime": s.st_mtime_ns}
    except OSError:
        return {"size": -1, "mtime": 0}


def digest(path: str, size: int) -> str | None:
    """SHA-256 of the first `size` bytes of a file that doesn't change meanwhile; None otherwise."""
    before, out, left = _identity(path), hashlib.sha256(), size
    try:
        with open(path, "rb") as f:
            while left and (part := f.read(min(left, 1 << 20))):
                out.update(part)
                left -= len(part)
    except OSError:
        return None
    return out.hexdigest() if not left and _identity(path) == before else None


class Journal:
    """A file with the run's options and a row per target: status (waiting, complete, partial, failed), size, mtime, sha256.
    It is replaced as a whole at every change, so that a kill leaves the old or the new one."""

    def __init__(self, path: str, targets: list[str], options: ScanOptions):
        self.path, self.run = path, asdict(options)
        self.rows = [{"path": t, "status": "waiting", "size": -1, "mtime": 0, "sha256": None} for t in targets]

    @classmethod
    def resumed(cls, path: str, targets: list[str], options: ScanOptions) -> Journal:
        """The journal at path, which must list the same targets in the same order under the same options."""
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
        own = cls(path, targets, options)
        names = [r["path"] for r in old["targets"]]
        if len(names) != len(targets):
            raise ValueError(f"the journal covers {len(names)} targets, the run lists {len(targets)}")
        for k, (a, b) in enumerate(zip(names, targets)):
            if a != b:
                raise ValueError(f"target {k} of the journal is {a!r}, the run lists {b!r}")
        for key, value in own.run.items():
            if old["run"].get(key) != value:
                raise ValueError(f"the journal's run has {key} {old['run'].get(key)!r}, this one {value!r}")
        own.rows = old["targets"]
        return own

    def waiting(self) -> list[str]:
        """Targets to scan: all but those that are complete and whose size, time and digest still are what was scanned."""
        return [r["path"] for r in self.rows if not self._done(r)]

    @staticmethod
    def _done(row: dict) -> bool:
        same = row["size"] >= 0 and row["mtime"] and {k: row[k] for k in ("size", "mtime")} == _identity(row["path"])
        return row["status"] == "complete" and same and row["sha256"] is not None and digest(row["path"], row["size"]) == row["sha256"]

    def record(self, path: str, status: str) -> None:
        row = next(r for r in self.rows if r["path"] == path)
        row |= {"status": status, **_identity(path)}
        row["sha256"] = digest(path, row["size"]) if status == "complete" and row["size"] >= 0 else None
        self.save()

    def save(self) -> None:
        part = f"{self.path}.tmp-{os.getpid()}"
        with open(part, "w", encoding="utf-8") as f:
            json.dump({"run": self.run, "targets": self.rows}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, self.path)


def run_batch(targets: list[str], scan: Callable[[str], bool], journal: Journal) -> dict[str, str]:
    """Scans what waits, a target at a time; scan says whether it covered the whole target. One target's failure doesn't end
    the batch. Returns each target's status."""
    for path in journal.waiting():
        try:
            journal.record(path, "complete" if scan(path) else "partial")
        except (OSError, ValueError):
            journal.record(path, "failed")
    return {r["path"]: r["status"] for r in journal.rows}
