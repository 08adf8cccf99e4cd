"""What a Python worker remembers between tasks, for one kind of work at a time."""

from __future__ import annotations

_held: dict[str, dict] = {}


def remembered(kind: str) -> dict:
    """The dictionary of this kind of work. Those of other kinds are let go: a worker that serves one operator after
    another never holds the tables of all of them."""
    for other in [k for k in _held if k != kind]:
        del _held[other]
    return _held.setdefault(kind, {})
