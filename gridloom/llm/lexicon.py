"""Minimal acyclic transducer: words to numbers, numbers to token ids.

Words are byte strings.  The automaton is built from words in ascending order,
one at a time, sharing every suffix that can be shared.  An arc's output is the
number of accepted words that the arcs before it lead to, so the outputs along
a word's path add up to the word's rank, and the rank selects its ids.

The serialised form is a few flat arrays, made to be mapped into memory; a
whole batch of words walks through it in lock-step.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_MAGIC = b"MATL\x01\x00\x00\x00"
#: name, type; in the order in which they follow the header.
_FIELDS = (("arcs", "<u8"), ("target", "<u4"), ("output", "<u4"), ("final", "<u1"), ("bounds", "<u4"), ("ids", "<u4"))


def compile_words(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The automaton of (word, ids) pairs; words are distinct, in any order."""
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []
    # a path of unfinished states: [is final, [(byte, finished state)]]
    path: list[list] = [[False, []]]

    def finish(state: list) -> int:
        key = (state[0], tuple(state[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append((state[0], state[1]))
        return at

    last = b""
    for word, _ in entries:
        same = 0
        for a, b in zip(word, last):
            if a != b:
                break
            same += 1
        for depth in range(len(last), same, -1):
            path[depth - 1][1].append((last[depth - 1], finish(path.pop())))
        for _ in word[same:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], finish(path.pop())))
    start = finish(path[0])
    below = np.zeros(len(states), np.int64)
    arcs, target, output = [], [], []
    for n, (accepts, out) in enumerate(states):  # targets have smaller numbers
        seen = int(accepts)
        for byte, to in out:
            arcs.append(n << 8 | byte)
            target.append(to)
            output.append(seen)
            seen += int(below[to])
        below[n] = seen
    ids = [i for _, x in entries for i in x]
    parts = {
        "arcs": arcs, "target": target, "output": output, "final": [s[0] for s in states],
        "bounds": np.concatenate([[0], np.cumsum([len(x) for _, x in entries])]), "ids": ids,
    }
    arrays = [np.asarray(parts[name]).astype(kind) for name, kind in _FIELDS]
    head = _MAGIC + np.array([start, *map(len, arrays)], "<u8").tobytes()
    body = b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)
    return head + body


class Lexicon:
    """A compiled automaton over a buffer."""

    def __init__(self, data):
        if bytes(data[:8]) != _MAGIC:
            raise ValueError("not a compiled lexicon")
        numbers = np.frombuffer(data, "<u8", 1 + len(_FIELDS), 8)
        self.start, at = int(numbers[0]), 8 + numbers.nbytes
        for (name, kind), n in zip(_FIELDS, numbers[1:]):
            a = np.frombuffer(data, kind, int(n), at)
            setattr(self, name, a)
            at += a.nbytes + -a.nbytes % 8
        self._data = data

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @classmethod
    def mapped(cls, data: bytes) -> "Lexicon":
        """The same from a mapped file without a name: the mapping outlives it."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for one that isn't in the lexicon."""
        if not words or not len(self):
            return np.full(len(words), -1, np.int64)
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        size, first = size[order], first[order]
        state = np.full(len(words), self.start, np.int64)
        rank = np.zeros(len(words), np.int64)
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k, "left"))  # the words longer than k
            live = np.flatnonzero(state[:n] >= 0)
            if not len(live):
                break
            key = (state[live].astype(np.uint64) << np.uint64(8)) | flat[first[live] + k].astype(np.uint64)
            arc = np.searchsorted(self.arcs, key)
            arc[arc == len(self.arcs)] = 0
            ok = self.arcs[arc] == key
            state[live[~ok]] = -1
            state[live[ok]] = self.target[arc[ok]]
            rank[live[ok]] += self.output[arc[ok]]
        good = state >= 0
        good[good] = self.final[state[good]] > 0
        out = np.empty(len(words), np.int64)
        out[order] = np.where(good, rank, -1)
        return out

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[self.bounds[rank] : self.bounds[rank + 1]].tolist()
