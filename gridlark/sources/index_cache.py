"""What the first job over a delimited file found, kept for the next time the same file is opened.

An entry stands for a path, size, time of change, delimiter and range size; a
changed file has another entry. Entries are a few numbers for each range.
"""

from __future__ import annotations

import hashlib
import json
import os

#: Records beyond which an entry isn't kept.
MOST_RECORDS = 200_000_000


def _entry(folder: str, path: str, delimiter: str, range_bytes: int) -> str:
    stat = os.stat(path)
    what = json.dumps([os.path.abspath(path), stat.st_size, stat.st_mtime_ns, delimiter, range_bytes])
    return os.path.join(folder, f"{_prefix(path)}-{hashlib.sha256(what.encode()).hexdigest()[:24]}.json")


def _prefix(path: str) -> str:
    return hashlib.sha256(os.path.abspath(path).encode()).hexdigest()[:16]


def load(folder: str, path: str, delimiter: str, range_bytes: int) -> list[tuple[list[int], list[int]]] | None:
    """States and records of each range, or None where there is no entry that can be read."""
    try:
        with open(_entry(folder, path, delimiter, range_bytes), encoding="utf-8") as f:
            return [(list(s), list(r)) for s, r in json.load(f)]
    except (FileNotFoundError, ValueError, TypeError):
        return None


def save(folder: str, path: str, delimiter: str, range_bytes: int, outcomes: list[tuple[list[int], list[int]]]) -> bool:
    """Whether an entry was written; it appears at once and whole."""
    if sum(r[0] for _, r in outcomes) > MOST_RECORDS:
        return False
    os.makedirs(folder, exist_ok=True)
    place = _entry(folder, path, delimiter, range_bytes)
    with open(f"{place}.new", "w", encoding="utf-8") as f:
        json.dump(outcomes, f)
    os.replace(f"{place}.new", place)
    return True


def clear(folder: str, path: str | None = None) -> int:
    """Removes the entries of a file, or all; how many there were."""
    names = [n for n in os.listdir(folder) if n.endswith(".json") and (path is None or n.startswith(f"{_prefix(path)}-"))] if os.path.isdir(folder) else []
    for n in names:
        os.remove(os.path.join(folder, n))
    return len(names)
