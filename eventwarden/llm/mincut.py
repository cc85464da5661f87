"""Minimum cut between two terminals, by maximum flow along shortest residual paths (blocking flows per phase)."""

from __future__ import annotations


def source_side(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source.

    ``lean[i] > 0`` is the capacity from the source to node i, ``-lean[i] > 0`` that from i to the sink; ``edges`` are
    undirected with one capacity. Nodes that no positive residual path reaches from the source fall to the sink.
    """
    n = len(lean)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(lean):
        if x > 0:
            arc(source, i, x, 0.0)
        elif x < 0:
            arc(i, sink, -x, 0.0)
    for a, b, c in edges:
        arc(a, b, c, c)

    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in head[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                least = min(room[e] for e in path)
                cut = 0
                for place, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                for place, e in enumerate(path):
                    if room[e] <= 1e-9:
                        cut = place
                        break
                node = to[path[cut] ^ 1]
                del path[cut:]
                continue
            arcs = head[node]
            while at[node] < len(arcs):
                e = arcs[at[node]]
                if room[e] > 1e-9 and level[to[e]] == level[node] + 1:
                    break
                at[node] += 1
            if at[node] < len(arcs):
                path.append(arcs[at[node]])
                node = to[arcs[at[node]]]
            elif path:
                node = to[path.pop() ^ 1]
                at[node] += 1
            else:
                break
