"""Plain tables of fixed values that functions take as arguments; others of the same form may be passed instead."""

from __future__ import annotations

import json
from functools import cache
from importlib.resources import files


@cache
def load(name: str) -> dict:
    """The table of a name, read once."""
    return json.loads((files(__name__) / f"{name}.json").read_text(encoding="utf-8"))
