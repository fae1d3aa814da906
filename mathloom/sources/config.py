"""Configuration files: inheritance, overrides, and values from the command line."""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import Any


class Settings(dict):
    """A dict whose nested values are also attributes."""

    def __getattr__(self, name: str) -> Any:
        try:
            value = self[name]
        except KeyError as e:
            raise AttributeError(name) from e
        return Settings(value) if isinstance(value, dict) else value


def merged(base: dict, over: dict) -> dict:
    """Values of ``over`` win, nested mappings are merged, lists replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str, overrides: dict | None = None) -> Settings:
    """A YAML file over its parents (``inherit`` names one in the same folder), then the overrides."""
    import yaml

    with open(path, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    parent = own.pop("inherit", None)
    if parent is not None:
        above = os.path.join(os.path.dirname(path), f"{parent}.yaml")
        if not os.path.exists(above):
            raise FileNotFoundError(above)
        own = merged(load(above), own)
    return Settings(merged(own, overrides or {}))


def value(text: str) -> Any:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text.lower(), text)


def overrides(args: Sequence[str]) -> dict:
    """``--a.b 1 --flag`` as {a: {b: 1}, flag: True}."""
    out: dict = {}
    for i, a in enumerate(args):
        if not a.startswith("--"):
            continue
        bare = i + 1 == len(args) or args[i + 1].startswith("--")
        at = out
        *path, last = a[2:].split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = True if bare else value(args[i + 1])
    return out
