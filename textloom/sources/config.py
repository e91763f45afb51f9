"""Nested configuration flattened onto flat arguments."""

from __future__ import annotations

from typing import Any


def flatten(tree: dict) -> dict[str, Any]:
    """A nested mapping as one level, names joined by underscores, in the tree's order."""
    out: dict[str, Any] = {}
    todo = [((), tree)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict):
            todo += [((*path, str(key)), node[key]) for key in reversed(node)]
        else:
            out["_".join(path)] = node
    return out


def candidates(name: str) -> list[str]:
    """The argument names a flat name may set, first match wins: itself, its last part, then ever shorter ends."""
    parts = name.split("_")
    return list(dict.fromkeys([name, parts[-1], *("_".join(parts[i:]) for i in range(1, len(parts)))]))


def apply(arguments: dict[str, Any], tree: dict) -> dict[str, Any]:
    """The arguments with the tree's values over them; names that match none are ignored."""
    out = dict(arguments)
    for name, value in flatten(tree).items():
        found = next((c for c in candidates(name) if c in out), None)
        if found:
            out[found] = value
    return out
