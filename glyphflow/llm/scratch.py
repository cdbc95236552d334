"""Scratch tables in the shared folder (``functions.scratch``), and free column names."""

from __future__ import annotations

from glyphflow.functions.scratch import CHECKPOINT_DIR, materialize, release, scratch_path, scratch_root

__all__ = ["CHECKPOINT_DIR", "fresh", "materialize", "release", "scratch_path", "scratch_root"]


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as keep it apart from ``columns`` and the others."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
