"""Where results come from, and configurations: small, on the driver."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import subprocess
from collections.abc import Mapping, Sequence

import numpy as np


def utc_now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")


def git(*arguments: str, cwd: str = ".") -> str:
    """What git answers, or `unknown`."""
    try:
        return subprocess.run(["git", *arguments], cwd=cwd, capture_output=True, text=True, check=True).stdout.strip() or "unknown"
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def text_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def provenance(model: str, seed: int, replicates: int, device: str, classes: Sequence[str]) -> dict:
    """A report's head. The note marks a pretrained model that was not tuned on the classes: its file
    names its family and its path no training set."""
    name = model.replace("\\", "/").rsplit("/", 1)[-1].lower()
    note = "zero-shot pretrained floor" if "yolo" in name and "coco" not in model.lower() else ""
    return {"generated_utc": utc_now(), "version": git("describe", "--tags", "--always"), "commit": git("rev-parse", "HEAD"), "model": model, "device": device, "seed": seed, "replicates": replicates, "classes": list(classes), "note": note}


def merged(config: Mapping, late: Mapping) -> dict:
    """The overrides of a configuration; what is given later wins."""
    return dict(config.get("overrides") or {}) | dict(late)


def masked(command: Sequence[str], secret_after: Sequence[str] = ("password", "--token")) -> str:
    """A command line for a log, without the arguments that follow secret switches."""
    before = ["", *command]
    return " ".join("********" if b in secret_after else c for b, c in zip(before, command))


def drawn(space: Mapping[str, Mapping], seed: int) -> dict:
    """One point of a search space: loguniform and uniform between low and high, choice of values."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, s in space.items():
        match s["dist"]:
            case "loguniform":
                out[name] = math.exp(rng.uniform(math.log(float(s["low"])), math.log(float(s["high"]))))
            case "uniform":
                out[name] = float(rng.uniform(float(s["low"]), float(s["high"])))
            case "choice":
                out[name] = s["values"][int(rng.integers(len(s["values"])))]
            case other:
                raise ValueError(f"unknown distribution {other!r} of {name}")
    return out
