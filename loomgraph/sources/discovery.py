"""Where a repository begins."""

from __future__ import annotations

import os


def repository_root(start: str) -> str:
    """The nearest folder upwards with ``.git`` (a folder, or a file in a worktree), else the nearest with ``package.json``, else the start."""
    at = start = os.path.abspath(start)
    package = None
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return at
        if package is None and os.path.exists(os.path.join(at, "package.json")):
            package = at
        parent = os.path.dirname(at)
        if parent == at:
            return package or start
        at = parent
