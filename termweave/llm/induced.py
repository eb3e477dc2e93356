"""Induced sorting of the suffixes of a shard, with queues that spill to disk.

Only the local minima of the text (positions of type S after type L) are sorted by comparing bytes, in runs that are
merged; every other suffix is induced: in ascending order each suffix passes on its predecessor of
type L, in descending order its predecessor of type S, into the queue of the predecessor's first character. A
queue keeps its order of arrival, which is the order of its suffixes, so a priority queue over first
characters is a row of such queues. Beyond ``IN_MEMORY`` entries queues go to files in the task's own temporary folder, which
is removed with the task's work.

Suffixes count as equal beyond ``depth`` bytes; that is all that repeats of a fixed length need, and it ends the
recursion of the sort of minima after one level.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Entries that all queues of a sort hold in memory together.
IN_MEMORY = 1 << 22
#: Minima sorted as one run.
RUN = 1 << 21


class Queues:
    """First-in first-out queues of positions by first character."""

    def __init__(self, in_memory: int = IN_MEMORY):
        self.parts: dict[int, list] = {}
        self.held, self.in_memory, self.folder, self.files = 0, in_memory, None, 0

    def put(self, positions: np.ndarray, characters: np.ndarray) -> None:
        """Append in the given order, to the queue of each position's character."""
        order = np.argsort(characters, kind="stable")
        positions, characters = positions[order], characters[order]
        cuts = np.flatnonzero(np.diff(characters, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(characters)]):
            self.parts.setdefault(int(characters[a]), []).append(positions[a:b])
        self.held += len(positions)
        if self.held > self.in_memory:
            self._spill()

    def take(self, character: int) -> np.ndarray:
        """All that is queued for the character, which is then empty."""
        parts = self.parts.pop(character, [])
        out = [np.load(p) if isinstance(p, str) else p for p in parts]
        self.held -= sum(len(p) for p in parts if not isinstance(p, str))
        for p in parts:
            if isinstance(p, str):
                os.remove(p)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _spill(self) -> None:
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="queues-")
        for parts in self.parts.values():
            for k, p in enumerate(parts):
                if not isinstance(p, str):
                    self.files += 1
                    name = f"{self.folder.name}/{self.files}.npy"
                    np.save(name, p)
                    parts[k] = name
        self.held = 0

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()


def _prefix_words(padded: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The first ``depth`` characters after each position, eight to a word."""
    words = []
    for k in range(0, depth, 8):
        word = np.zeros(len(at), np.uint64)
        for j in range(k, k + 8):
            word = (word << np.uint64(8)) | padded[at + j].astype(np.uint64)
        words.append(word)
    return words


def _sorted_minima(padded: np.ndarray, minima: np.ndarray, depth: int) -> np.ndarray:
    runs = []
    for k in range(0, len(minima), RUN):
        at = minima[k : k + RUN]
        runs.append(at[np.lexsort(_prefix_words(padded, at, depth)[::-1])])
    while len(runs) > 1:
        runs = [_merged(padded, *runs[k : k + 2], depth) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return runs[0] if runs else minima


def _merged(padded: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Two sorted runs as one; keys are compared as strings of bytes."""
    both = [np.stack(_prefix_words(padded, x, depth), 1).astype(">u8").view(f"S{8 * len(range(0, depth, 8))}").ravel() for x in (a, b)]
    place = np.searchsorted(both[0], both[1], "right")
    return np.insert(a, place, b)


def suffix_array(text: np.ndarray, depth: int, in_memory: int = IN_MEMORY) -> np.ndarray:
    """Positions of the suffixes of a byte array in order of their first ``depth`` bytes."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # One closing minimum after the text; every byte counts one more than it is.
    t = np.zeros(n + 1, np.int16)
    t[:n] = text.astype(np.int16) + 1
    change = t[1:] != t[:-1]
    following = np.minimum.accumulate(np.where(change, np.arange(n), n)[::-1])[::-1]
    kind = np.ones(n + 1, bool)  # type S
    kind[:n] = t[:-1][np.minimum(following, n - 1)] < t[1:][np.minimum(following, n - 1)]
    minima = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    # Where no minimum reaches, zeros follow: equal to a zero byte only beyond the end.
    padded = np.zeros(n + depth + 16, np.uint8)
    padded[:n] = text
    inner = minima[minima < n]
    order = _sorted_minima(padded, inner, depth + 8 - depth % 8)
    queues = Queues(in_memory)
    seeds = Queues(in_memory)
    seeds.put(order, t[order])
    width = 258
    ascending: list[np.ndarray] = []
    for c in range(width):
        mine = []
        if c == 0:
            _induce(queues, np.array([n]), t, kind, False)
        while len(now := queues.take(c)):
            mine.append(now)
            _induce(queues, now, t, kind, False)
        ascending.append(np.concatenate(mine) if mine else np.zeros(0, np.int64))
        _induce(queues, seeds.take(c), t, kind, False)
    out: list[np.ndarray] = [None] * width
    for c in range(width - 1, -1, -1):
        mine = []
        while len(now := queues.take(c)):
            mine.append(now)
            _induce(queues, now, t, kind, True)
        _induce(queues, ascending[c][::-1], t, kind, True)
        out[c] = np.concatenate([ascending[c], np.concatenate(mine)[::-1] if mine else np.zeros(0, np.int64)])
    queues.close()
    seeds.close()
    return np.concatenate(out)


def _induce(queues: Queues, positions: np.ndarray, t: np.ndarray, kind: np.ndarray, small: bool) -> None:
    before = positions[positions > 0] - 1
    before = before[kind[before] == small]
    if len(before):
        queues.put(before, t[before])


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, at_once: int = 1 << 15) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in ``order``, at most ``depth``."""
    padded = np.zeros(len(text) + depth, np.uint8)
    padded[: len(text)] = text
    windows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    out = np.zeros(len(order), np.int64)
    for k in range(1, len(order), at_once):
        a = windows[order[k - 1 : min(k + at_once, len(order)) - 1]]
        b = windows[order[k : k + at_once]]
        differs = a != b
        out[k : k + at_once] = np.where(differs.any(1), differs.argmax(1), depth)
    # Nothing after the end of the text is common.
    limit = len(text) - np.maximum(order[1:], order[:-1])
    out[1:] = np.minimum(out[1:], limit)
    return out
