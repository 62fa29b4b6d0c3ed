"""Markdown to trees of chunks, and keyword, vector and hybrid search over them, on Spark."""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

#: Public names and where they live; modules are loaded when a name is first used, so workers load only what they run.
_NAMES = {
    "outline": "functions.outline",
    "outline_text": "functions.outline",
    "normalize": "functions.normalize",
    "simple": "operators.chunksets",
    "budgeted": "operators.chunksets",
    "expand": "operators.context",
    "expand_deep": "operators.context",
    "assemble": "operators.context",
    "index": "plans.api",
    "search": "plans.api",
    "status": "plans.api",
}
__all__ = list(_NAMES)


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(name)
    # a module of that name would hide it from here on
    value = globals()[name] = getattr(importlib.import_module(f"loomspark.{_NAMES[name]}"), name)
    return value
