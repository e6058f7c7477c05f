"""Double-array tries over bytes, built and walked in numpy.

State ``s`` goes to ``t = base[s] + symbol`` when ``check[t] == s``. No key may be the beginning of another, so a key ends in a
leaf, and ``base`` of a leaf is the number of its key. The arrays have at most 16 slots per node.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SYMBOLS = 256
#: A node with more children than this gets the places its symbols span to itself; the others are interleaved.
DENSE = 16
ROOT = 0


def build(keys: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``base`` and ``check`` of distinct keys; key ``i`` of the sequence ends in a leaf numbered ``i``."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    buffer = np.frombuffer(b"".join(keys[i] for i in order), dtype=np.uint8)
    sizes = np.array([len(keys[i]) for i in order], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(order) else np.zeros(0, dtype=np.int64)
    parents, symbols, first_child = [], [], 1
    node = np.zeros(len(order), dtype=np.int32)
    leaf = np.zeros(len(order), dtype=np.int32)
    live, depth = np.arange(len(order)), 0
    while live.size:
        symbol = buffer[starts[live] + depth].astype(np.int32)
        edge = node[live].astype(np.int64) * SYMBOLS + symbol
        new = np.concatenate([[True], edge[1:] != edge[:-1]])  # keys are sorted, so equal edges stand together
        child = (first_child + np.cumsum(new) - 1).astype(np.int32)
        parents.append(node[live][new])
        symbols.append(symbol[new])
        first_child = int(child[-1]) + 1
        node[live], leaf[live] = child, child
        depth += 1
        live = live[sizes[live] > depth]
    if not parents:
        return np.zeros(SYMBOLS + 1, dtype=np.int32), np.full(SYMBOLS + 1, -1, dtype=np.int32)
    parent, symbol = np.concatenate(parents), np.concatenate(symbols)
    offset, slots = _placed(parent, symbol, first_child)
    slot = np.full(first_child, ROOT, dtype=np.int64)  # node 1 + e is the child of edge e
    slot[1:] = offset[parent] + symbol
    base = np.zeros(slots + SYMBOLS, dtype=np.int32)
    check = np.full(slots + SYMBOLS, -1, dtype=np.int32)
    base[slot[np.unique(parent)]] = offset[np.unique(parent)]
    check[slot[1:]] = slot[parent]
    base[slot[leaf]] = np.array(order, dtype=np.int32)
    return base, check


def _placed(parent: np.ndarray, symbol: np.ndarray, nodes: int) -> tuple[np.ndarray, int]:
    """An offset for every node, so that no two edges share ``offset + symbol``, and the slots needed.

    Nodes of many children get the width of their symbols, the fuller ones of the rest are tried at random places of a table
    twice as large as they need, nodes of one child fill what is free. Edges are in order of parent and symbol.
    """
    fan = np.bincount(parent, minlength=nodes).astype(np.int16)
    children = fan[parent]
    offset = np.zeros(nodes, dtype=np.int64)
    dense = np.flatnonzero(fan > DENSE)
    low = symbol[np.searchsorted(parent, dense)]
    width = symbol[np.searchsorted(parent, dense, side="right") - 1] - low + 1
    offset[dense] = SYMBOLS + np.cumsum(width) - width - low
    several = (children > 1) & (children <= DENSE)
    slots = 2 * SYMBOLS + int(width.sum()) + 2 * int(several.sum())
    taken = np.zeros(slots + SYMBOLS, dtype=bool)
    taken[:SYMBOLS] = True
    in_dense = children > DENSE
    taken[offset[parent[in_dense]] + symbol[in_dense]] = True
    rng = np.random.default_rng(0)
    for most, least in ((DENSE, 9), (8, 5), (4, 2)):
        mine = np.flatnonzero((children >= least) & (children <= most))
        tries = 0
        while mine.size:
            tries += 1
            if tries % 32 == 0:
                taken = np.concatenate([taken, np.zeros(slots, dtype=bool)])
                slots *= 2
            here, at = np.unique(parent[mine], return_inverse=True)
            offset[here] = rng.integers(SYMBOLS, slots, here.size)
            place = offset[parent[mine]] + symbol[mine]
            by_place = np.argsort(place, kind="stable")
            again = np.concatenate([[False], place[by_place][1:] == place[by_place][:-1]])
            lost = taken[place]
            lost[by_place] |= again
            failed = np.bincount(at, weights=lost, minlength=here.size)[at] > 0
            taken[place[~failed]] = True
            mine = mine[failed]
    single = np.flatnonzero(children == 1)
    free = np.flatnonzero(~taken)[: single.size]
    more = len(taken) + np.arange(single.size - free.size)
    place = np.concatenate([free, more])
    offset[parent[single]] = place - symbol[single]
    return offset, max(len(taken), int(place.max(initial=0)) + 1)


def walk(base: np.ndarray, check: np.ndarray, key: bytes, state: int = ROOT) -> int:
    """The state after one key, or -1."""
    for symbol in key:
        after = int(base[state]) + symbol
        if check[after] != state:
            return -1
        state = after
    return state


def advance(
    base: np.ndarray, check: np.ndarray, state: np.ndarray, symbol: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """One level for all states at once: where they went, and which of them went anywhere."""
    after = base[state] + symbol
    return after, check[after] == state
