"""Plain versions that several tests compare with."""

from __future__ import annotations


def components_of(nodes, links) -> dict:
    """The smallest node that each node reaches."""
    near = {n: [] for n in nodes}
    for a, b in links:
        near[a].append(b)
        near[b].append(a)
    root = {}
    for start in sorted(nodes):
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in root:
                root[n] = start
                todo += near[n]
    return root
