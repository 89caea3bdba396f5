"""Getting archives: what to fetch and when; how is a hook, as there may be no network."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from .sinks import ChecksumMismatch, file_sha256

Fetch = Callable[[Mapping, Path], Path]
#: Hooks by kind of source (http, gdrive, kaggle and the like).
FETCHERS: dict[str, Fetch] = {}


def fetch(archive: Mapping, folder: Path) -> Path:
    kind = archive["source"]
    if kind not in FETCHERS:
        raise ValueError(f"no way to fetch {kind!r}")
    return FETCHERS[kind](archive, folder)


def obtain(archives: Sequence[Mapping], folder: Path, locks: dict[str, str]) -> dict[str, str]:
    """State of each archive (id, filename, source): skipped where the pinned file is there already,
    else fetched and then verified or, the first time, pinned in `locks`."""
    states = {}
    for a in archives:
        key, there = a["id"], folder / a["filename"]
        if there.exists() and locks.get(key) == file_sha256(str(there)):
            states[key] = "skipped"
            continue
        digest = file_sha256(str(fetch(a, folder)))
        if locks.setdefault(key, digest) != digest:
            raise ChecksumMismatch(f"{key} is not the pinned file")
        states[key] = "fetched"
    return states


def obtain_all(datasets: Sequence[Mapping], root: Path, locks: dict[str, str]) -> dict[str, str]:
    """Of every dataset (name, role, archives). A stretch dataset that fails only warns."""
    states = {}
    for d in datasets:
        try:
            states |= obtain(d["archives"], root / d["name"], locks)
        except Exception as e:
            if d.get("role") != "stretch":
                raise
            warnings.warn(f"{d['name']}: {e}", stacklevel=2)
    return states
