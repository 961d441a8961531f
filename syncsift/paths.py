"""Paths on the driver: canonical roots, safe joins, containment after links are resolved."""

from __future__ import annotations

import os
import secrets
from pathlib import Path


def canonical_root(root: str) -> str:
    """The absolute path of a root, without dots, doubled or final separators. Made once, and used in every check."""
    if not root.strip():
        raise ValueError("a root is needed")
    return os.path.abspath(root)


def combined(root: str, *segments: str) -> str:
    """``segments`` resolved one after the other from ``root``; an absolute one begins anew, and ``contained`` then refuses it."""
    path = canonical_root(root)
    for segment in segments:
        if not segment.strip():
            raise ValueError("an empty segment")
        path = os.path.abspath(os.path.join(path, segment))
    return path


def contained(path: str, root: str | Path) -> Path:
    """``path`` if its folder, with links resolved, lies under ``root``; a link in its last place isn't followed."""
    top = Path(os.path.realpath(root))
    head, tail = os.path.split(os.path.abspath(path))
    found = Path(os.path.realpath(head)) / tail
    if found != top and top not in found.parents:
        raise ValueError(f"{path} is outside {root}")
    return found


def operation_id() -> str:
    """128 random bits in hex."""
    return secrets.token_hex(16)
