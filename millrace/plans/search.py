"""The search for datasources: the cheapest connected set that has one of each needed group."""

from __future__ import annotations

import heapq
from itertools import count

#: Up to so many groups the set is the cheapest; beyond, groups are connected one after another.
EXACT = 9


def cheapest_tree(terms: list[set[str]], near: dict[str, list[str]], price: dict[str, tuple[int, int]]) -> frozenset[str] | None:
    """Nodes that are connected and hold one of each set of terms, with the least total price, or None.

    Equal prices are told apart by name, so a model has one answer. The search grows and merges trees by the groups they
    hold (a state for each subset of groups and node), so its work depends on the groups that really differ, not on the
    size of the model, and no tree is too large for it.
    """
    groups: list[frozenset[str]] = []
    for t in sorted(map(frozenset, terms), key=lambda t: (len(t), sorted(t))):
        if not any(g <= t for g in groups):  # what holds one of g holds one of t
            groups.append(t)
    if len(groups) > EXACT:
        return _step_by_step(groups, near, price)
    return _search(groups, near, price)


def _cost(nodes: frozenset[str], price: dict) -> tuple:
    return (sum(price[n][0] for n in nodes), sum(price[n][1] for n in nodes), tuple(sorted(nodes)))


def _search(groups: list[frozenset[str]], near: dict, price: dict) -> frozenset[str] | None:
    full = (1 << len(groups)) - 1
    mask = {n: sum(1 << i for i, g in enumerate(groups) if n in g) for n in price}
    order, best, done = count(), {}, {}
    heap: list = []

    def offer(m: int, v: str, nodes: frozenset[str]) -> None:
        cost = _cost(nodes, price)
        if (m, v) not in done and ((m, v) not in best or cost < best[m, v]):
            best[m, v] = cost
            heapq.heappush(heap, (cost, next(order), m, v, nodes))

    for n in sorted({n for g in groups for n in g}):
        if n in price:
            offer(mask[n], n, frozenset([n]))
    while heap:
        cost, _, m, v, nodes = heapq.heappop(heap)
        if (m, v) in done:
            continue
        done[m, v] = nodes
        if m == full:
            return nodes
        for u in near[v]:
            offer(m | mask[u], u, nodes | {u})
        for (k, w), others in list(done.items()):
            if w == v and k | m != m and k | m != k:
                offer(m | k, v, nodes | others)
    return None


def _step_by_step(groups: list[frozenset[str]], near: dict, price: dict) -> frozenset[str] | None:
    """A connected set that holds all groups, each joined to what is there by its cheapest path."""
    found = _search(groups[:EXACT], near, price)
    for g in groups[EXACT:]:
        if found is None or found & g:
            continue
        heap = [((0, 0), n, ()) for n in sorted(found)]
        seen: set[str] = set()
        while heap:
            cost, n, path = heapq.heappop(heap)
            if n in seen:
                continue
            seen.add(n)
            if n in g:
                found = found | set(path) | {n}
                break
            for u in near[n]:
                if u not in seen:
                    heapq.heappush(heap, ((cost[0] + price[u][0], cost[1] + price[u][1]), u, (*path, u)))
        else:
            return None
    return found
