"""Ids of stretches of text that come again, kept by a worker process in a table of bounded size.

A dictionary tells each stretch's number, flat arrays hold the ids of all. When the table holds ``most`` stretches it
becomes the old one, from which those that come again move on, and the old one before is dropped. A stretch takes
about 170 bytes.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np


def laid(ids: np.ndarray, bounds: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ids by their numbers, one after the other, and where each ends; stretch k lies between bounds k and k + 1."""
    begin = bounds[numbers]
    n = bounds[numbers + 1] - begin
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    narrow = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    at = np.repeat((begin - (ends - n)).astype(narrow), n)
    at += np.arange(total, dtype=narrow)
    return ids[at], ends


class _Table:
    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)


class Stretches:
    def __init__(self, most: int):
        self.most, self.now, self.old = most, _Table(), _Table()

    def turn(self) -> None:
        """Makes a full table the old one; numbers given before no longer hold."""
        if len(self.now.number) > self.most:
            self.old, self.now = self.now, _Table()

    def add(self, keys: list[str], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Keeps keys whose ids end at these places; returns their numbers."""
        now = self.now
        first = len(now.bounds) - 1
        now.number.update(zip(keys, range(first, first + len(keys))))
        now.bounds = np.concatenate([now.bounds, ends + len(now.ids)])
        now.ids = np.concatenate([now.ids, ids])
        return np.arange(first, first + len(keys))

    def known(self, keys: list[str]) -> np.ndarray:
        """The numbers of distinct keys, -1 for those that neither table has."""
        numbers = np.fromiter(map(self.now.number.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        if self.old.number:
            lacking = np.flatnonzero(numbers < 0)
            before = np.fromiter(map(self.old.number.get, map(keys.__getitem__, lacking.tolist()), repeat(-1)), dtype=np.int64, count=len(lacking))
            again = lacking[before >= 0]
            if len(again):
                numbers[again] = self.add([keys[k] for k in again.tolist()], *laid(self.old.ids, self.old.bounds, before[before >= 0]))
        return numbers

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered stretches, one after the other, and where each ends."""
        return laid(self.now.ids, self.now.bounds, numbers)
