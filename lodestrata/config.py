"""Settings from JSON or YAML files that may extend one another (D16, section 2.C)."""

from __future__ import annotations

import json
import os


def merged(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``: mappings are merged level by level, anything else, lists included, is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _locate(path: str, near: str | None) -> str:
    tries = [path] if os.path.isabs(path) or near is None else [path, os.path.join(near, path)]
    for p in tries:
        if os.path.exists(p):
            return os.path.abspath(p)
    raise FileNotFoundError(f"{path}; looked at {tries}")


def load_config(path: str, _near: str | None = None, _chain: tuple[str, ...] = ()) -> dict:
    """The settings of a file with those of the file it ``extends`` below them; a circle of files is an error."""
    full = _locate(path, _near)
    if full in _chain:
        raise ValueError(f"files extend each other in a circle: {' -> '.join((*_chain, full))}")
    with open(full, encoding="utf-8") as f:
        if full.endswith(".json"):
            own = json.load(f)
        else:
            import yaml

            own = yaml.safe_load(f)
    own = own or {}
    parent = own.pop("extends", None)
    return merged(load_config(parent, os.path.dirname(full), (*_chain, full)), own) if parent else own
