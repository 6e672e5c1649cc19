"""What a Python worker keeps between tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

T = TypeVar("T")
_kept: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """This worker's object for ``key``. Workers outlive stages, so one operator's object is dropped when another's is made."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]
