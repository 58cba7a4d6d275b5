"""SuperMinHash signatures of sets of 64-bit hashes.

Every element deals its ranks 0, 1, 2, ... to the registers by a permutation of its own, so
its ranks are correlated: no two registers get the same one, which lowers the variance of the
estimated similarity against independent hashes.  A register keeps the least rank plus a
random fraction.  Steps run over all elements of many sets at once; a set is finished as soon
as all its registers hold a rank of an earlier step, since no later step can lower them.
"""

from __future__ import annotations

import numpy as np

from quitanda.llm.words import STEP, mix

EMPTY = np.uint64(2**64 - 1)
#: Elements whose permutations are held in memory at a time.
ELEMENTS = 1 << 16


def _draw(elements: np.ndarray, step: int) -> np.ndarray:
    """The random value that each element has for a step, the same in every set."""
    return mix(elements + np.uint64((int(STEP) * (step + 1)) % (1 << 64)))


def signatures(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """One row of `registers` values for each set of distinct hashes; all EMPTY for an empty set.

    The share of registers in which two rows agree estimates the Jaccard similarity of the sets.
    """
    found = np.full((len(sets), registers), EMPTY, np.uint64)
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= ELEMENTS):
            total += len(sets[end])
            end += 1
        if total:
            _fill(sets[start:end], found[start:end], registers)
        start = end
    return found


def _fill(sets: list[np.ndarray], found: np.ndarray, registers: int) -> None:
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = found.reshape(-1)
    order = None
    for step in range(registers):
        draw = _draw(elements, step)
        at = step + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(registers - step)).astype(np.int64)
        if order is None and step:
            # Only sets that a first step leaves open need permutations: they have few elements.
            first = ((_draw(elements, 0) & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
            order = np.tile(np.arange(registers, dtype=np.int16), (len(elements), 1))
            _swap(order, 0, first)
        place = at if order is None else _swap(order, step, at)
        value = (np.uint64(step) << np.uint64(32)) | (draw >> np.uint64(32))
        np.minimum.at(flat, owner * registers + place, value)
        closed = (found != EMPTY).all(axis=1)
        going = ~closed[owner]
        if not going.any():
            return
        if not going.all():
            elements, owner = elements[going], owner[going]
            order = None if order is None else order[going]


def _swap(order: np.ndarray, step: int, at: np.ndarray) -> np.ndarray:
    """Exchange positions `step` and `at` of every permutation; what then stands at `step`."""
    rows = np.arange(len(order))
    chosen = order[rows, at].copy()
    order[rows, at] = order[:, step]
    order[:, step] = chosen
    return chosen.astype(np.int64)
