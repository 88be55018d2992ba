"""User functions by name: registered ones, or 'module:function'. They map columns to columns."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_registered: dict[str, Callable] = {}


def register(name: str, function: Callable) -> None:
    if ":" in name:
        raise ValueError("registered names have no colon")
    _registered[name] = function


def resolve(name: str) -> Callable:
    if name in _registered:
        return _registered[name]
    module, colon, function = name.partition(":")
    if not colon:
        raise KeyError(f"no function is registered as {name!r}")
    return getattr(importlib.import_module(module), function)
