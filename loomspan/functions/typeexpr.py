"""Type expressions as trees in pre-order."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Types that no declaration of a project stands for.
PRIMITIVES = frozenset("string number boolean void any unknown never null undefined object symbol bigint this".split())
_NAME = re.compile(r"[A-Za-z0-9_$.]+\Z")


class Node(NamedTuple):
    """path: '' for the root, else a step a0, u1 or i2 (argument, union or intersection member) after each other."""

    path: str
    raw: str
    base_name: str
    is_array: bool
    origin: str


def _cut(s: str, mark: str) -> list[str]:
    """s at each mark that is in no bracket."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(s):
        if c == mark and not depth:
            out.append(s[at:i])
            at = i + 1
        elif c in "<([{":
            depth += 1
        elif c in ">)]}":
            depth = max(0, depth - 1)
    return [*out, s[at:]]


def parse(raw: str, origin: str) -> list[Node]:
    """The tree's nodes; only the root has an origin. An empty type has none."""
    text = raw.strip()
    return list(_walk(text, "", origin)) if text else []


def _walk(s: str, path: str, origin: str = "") -> list[Node]:
    s = s.strip()
    for mark, step in (("|", "u"), ("&", "i")):
        parts = _cut(s, mark)
        if len(parts) > 1:
            return [Node(path, s, "", False, origin), *(x for k, p in enumerate(parts) for x in _walk(p, f"{path}/{step}{k}"))]
    core = re.sub(r"(?:\s*\[\])+\Z", "", s)
    array = core != s
    head = _cut(core, "<")[0]
    if len(head) < len(core):
        if not core.endswith(">"):
            return [Node(path, s, "", array, origin)]
        inner = core[len(head) + 1 : -1]
        return [Node(path, s, head.strip(), array, origin), *(x for k, p in enumerate(_cut(inner, ",")) for x in _walk(p, f"{path}/a{k}"))]
    return [Node(path, s, core if _NAME.match(core) else "", array, origin)]
