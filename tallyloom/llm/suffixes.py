"""Suffix arrays of byte texts in numpy: Larsson-Sadakane refinement, Kasai common prefixes, merging by binary search.

Texts of one array are joined with an end symbol each. Functions here see one shard, which the caller keeps small.
"""

from __future__ import annotations

import numpy as np

#: Bytes and the end symbol take nine bits, seven of them a first key.
FIRST_KEY = 7
#: Places whose common prefixes are compared at once.
COMPARED = 1 << 18


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (byte + 1, and 0 after each text), start of each text, and what is left of the own text at every place."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    ends = starts + sizes
    symbols[ends] = 0
    left = np.repeat(ends, sizes + 1) - np.arange(len(symbols))
    return symbols, starts, left.astype(np.int32)


def _first_keys(symbols: np.ndarray) -> np.ndarray:
    padded = np.concatenate([symbols, np.zeros(FIRST_KEY, np.uint16)])
    keys = np.zeros(len(symbols), np.uint64)
    for n in range(FIRST_KEY):
        keys = (keys << np.uint64(9)) | padded[n:n + len(symbols)]
    return keys


def _ends(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last place and size of each group, from marks at the last places."""
    last = np.flatnonzero(marked).astype(np.int32)
    return last, np.diff(last, prepend=np.int32(-1))


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and its inverse.

    Suffixes are sorted by their first seven symbols. A group of equal ones is named by its last place. Each round
    doubles the symbols that are compared: members of a group are sorted by the group that stands as many symbols further, and only
    groups with several members are looked at again. Places are 32-bit and temporary arrays are let go early, since a task holds them all.
    """
    size = len(symbols)
    if size == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    keys = _first_keys(symbols)
    order = np.argsort(keys).astype(np.int32)
    ranked = keys[order]
    ends = np.append(ranked[1:] != ranked[:-1], True)
    del keys, ranked
    last, counts = _ends(ends)
    group = np.empty(size, np.int32)
    group[order] = np.repeat(last, counts)
    # Places in the order that are still in a group of several.
    open_places = np.flatnonzero(np.repeat(counts > 1, counts)).astype(np.int32)
    step = FIRST_KEY
    while len(open_places):
        members = order[open_places]
        # Groups stay where they are, since the key starts with the own group.
        keys = group[members].astype(np.int64)
        keys <<= 32
        keys += 1 << 30
        further = members + np.int32(step)
        # Past the end, the shorter suffix is the smaller.
        past = further >= size
        behind = group[np.minimum(further, size - 1)]
        behind[past] = size - 1 - further[past]
        keys += behind
        del further, past, behind
        sorting = np.argsort(keys)
        members, keys = members[sorting], keys[sorting]
        del sorting
        order[open_places] = members
        last, counts = _ends(np.append(keys[1:] != keys[:-1], True))
        del keys
        group[members] = np.repeat(open_places[last], counts)
        open_places = open_places[np.repeat(counts > 1, counts)]
        step *= 2
    return order, group


def common_prefixes(symbols: np.ndarray, order: np.ndarray, inverse: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For every place of the text, how many symbols it shares with its predecessor in the array, inside both texts.

    Kasai: the place after ``i`` shares at least one symbol less than ``i`` does. Where its predecessor is also the next place of the
    predecessor of ``i``, it is exactly one less; only the other places are compared, seven symbols at a time.
    """
    size = len(symbols)
    before = order[np.maximum(inverse - 1, 0)]
    before[inverse == 0] = -1
    follows = np.zeros(size, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (symbols[:-1] == symbols[np.maximum(before[:-1], 0)])
    shared = np.zeros(size, np.int32)
    keys = _first_keys(symbols)
    compared = np.flatnonzero(~follows & (before >= 0)).astype(np.int32)
    for at in range(0, len(compared), COMPARED):
        here = compared[at:at + COMPARED]
        shared[here] = _compared(symbols, keys, here, before[here])
    del keys, compared
    # Chains: the length at the place the chain starts from, less the steps since.
    places = np.arange(size, dtype=np.int32)
    origin = np.maximum.accumulate(np.where(follows, np.int32(0), places))
    shared = shared[origin]
    shared -= places - origin
    del places, origin
    shared = np.minimum(np.maximum(shared, 0), left)
    return np.where(before >= 0, np.minimum(shared, left[np.maximum(before, 0)]), 0)


def _compared(symbols: np.ndarray, keys: np.ndarray, here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at each two places share."""
    size, length = len(symbols), np.zeros(len(here), np.int32)
    active = np.arange(len(here))
    while len(active):
        a, b = here[active] + length[active], there[active] + length[active]
        inside = (a < size) & (b < size)
        equal = inside & (keys[np.minimum(a, size - 1)] == keys[np.minimum(b, size - 1)])
        differing = active[inside & ~equal]
        for n in range(FIRST_KEY):
            if not len(differing):
                break
            a, b = here[differing] + length[differing], there[differing] + length[differing]
            inside = (a < size) & (b < size)
            differing = differing[inside & (symbols[np.minimum(a, size - 1)] == symbols[np.minimum(b, size - 1)])]
            length[differing] += 1
        active = active[equal]
        length[active] += FIRST_KEY
    return length


def repeated_starts(symbols: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` symbols from each place also start at another place of the array."""
    order, inverse = suffix_array(symbols)
    shared = common_prefixes(symbols, order, inverse, left)
    ranked = shared[order]
    neighbour = np.maximum(ranked, np.append(ranked[1:], 0))
    found = np.empty(len(symbols), bool)
    found[order] = neighbour >= length
    return found


def found_in(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys stand in a sorted array, by binary search."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys
