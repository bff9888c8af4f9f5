"""Settings for model plug-ins from a file of KEY=value lines; what is set already wins."""

from __future__ import annotations

import os
from pathlib import Path


def load_env(path: str) -> dict[str, str]:
    out = {}
    file = Path(path)
    for line in file.read_text().splitlines() if file.exists() else []:
        key, sep, value = line.strip().partition("=")
        if sep and not key.startswith("#"):
            key = key.removeprefix("export ").strip()
            out[key] = os.environ.setdefault(key, value.strip().strip("\"'"))
    return out


def require(name: str) -> str:
    value = os.environ.get(name)
    if not value:
        raise RuntimeError(f"{name} is not set")
    return value
