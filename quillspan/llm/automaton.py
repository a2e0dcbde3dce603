"""Several byte patterns compiled into one deterministic automaton, run over many chunks in lockstep."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser

import numpy as np


class Automaton:
    """The union of ``patterns`` (name -> regular expression) as one table of states.

    The expressions may use literals, classes, groups, alternation and bounded or open repeats; a
    search is unanchored. ``scan`` gives the positions just behind every match head, with the
    pattern's number, whatever other patterns overlap it.
    """

    def __init__(self, patterns: dict[str, str]):
        self.names = list(patterns)
        self._moves: list[list[tuple[frozenset[int], int]]] = []
        self._free: list[list[int]] = []
        self._final: dict[int, int] = {}
        start = self._state()
        for k, text in enumerate(patterns.values()):
            end = self._build(sre_parser.parse(text), start_of := self._state())
            self._free[start].append(start_of)
            self._final[end] = k
        self._determine(start)
        del self._moves, self._free, self._final

    def _state(self) -> int:
        self._moves.append([])
        self._free.append([])
        return len(self._moves) - 1

    def _build(self, tree, at: int) -> int:
        for op, arg in tree:
            at = self._step(op, arg, at)
        return at

    def _step(self, op, arg, at: int) -> int:
        if op is sre.SUBPATTERN:
            return self._build(arg[3], at)
        if op is sre.BRANCH:
            end = self._state()
            for part in arg[1]:
                self._free[at].append(first := self._state())
                self._free[self._build(part, first)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            least, most, part = arg
            for _ in range(least):
                at = self._build(part, at)
            if most is sre.MAXREPEAT:
                self._free[self._build(part, at)].append(at)
                after = self._state()
                self._free[at].append(after)
                return after
            end = self._state()
            for _ in range(most - least):
                self._free[at].append(end)
                at = self._build(part, at)
            self._free[at].append(end)
            return end
        after = self._state()
        self._moves[at].append((self._bytes(op, arg), after))
        return after

    @staticmethod
    def _bytes(op, arg) -> frozenset[int]:
        if op is sre.LITERAL:
            return frozenset([arg])
        if op is sre.NOT_LITERAL:
            return frozenset(range(256)) - {arg}
        found: set[int] = set()
        negated = False
        for kind, value in arg:
            if kind is sre.NEGATE:
                negated = True
            elif kind is sre.LITERAL:
                found.add(value)
            elif kind is sre.RANGE:
                found.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"unsupported class part {kind}")
        return frozenset(range(256)) - found if negated else frozenset(found)

    def _closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self._free[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    def _determine(self, start: int) -> None:
        sets = list({chars for moves in self._moves for chars, _ in moves})
        marks = np.array([[b in s for s in sets] for b in range(256)])
        _, first, classes = np.unique(marks, axis=0, return_index=True, return_inverse=True)
        self.classes = classes.reshape(-1).astype(np.uint8)
        origin = self._closure([start])
        number, todo, rows, hits = {origin: 0}, [origin], [], []
        while todo:
            here = todo.pop(0)
            moves = [m for s in here for m in self._moves[s]]
            row = []
            for byte in first:
                there = origin | self._closure({t for chars, t in moves if byte in chars})
                if there not in number:
                    number[there] = len(number)
                    todo.append(there)
                row.append(number[there])
            rows.append(row)
            hits.append(sum(1 << k for s, k in self._final.items() if s in here))
        self.table = np.array(rows, dtype=np.int32)
        self.hits = np.array(hits, dtype=np.int64)

    def scan(self, data: bytes, size: int = 1024, overlap: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """End positions (absolute, ascending, distinct) of match heads, and the mask of patterns ending there.

        The text is cut into chunks of ``size`` that are read in lockstep, each after the ``overlap`` bytes before it. A
        chunk that so began in another state than the one before it ended in is read again from that state, until all
        agree; so a head of any length is found, wherever the cuts are.
        """
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        count = -(-len(raw) // size)
        padded = np.full(overlap + count * size, self.classes[10], np.uint8)
        padded[overlap : overlap + len(raw)] = self.classes[raw]
        chunks = np.lib.stride_tricks.sliding_window_view(padded, overlap + size)[::size]
        width = self.table.shape[1]
        flat = self.table.reshape(-1) * width
        loud = np.zeros(len(self.hits) * width, bool)
        loud[::width] = self.hits > 0
        begun, ended = np.zeros(count, np.int32), np.zeros(count, np.int32)
        ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def read(which: np.ndarray, warm: int) -> None:
            steps = np.ascontiguousarray(chunks[which][:, overlap - warm :].T)
            state = np.zeros(len(which), np.int32) if warm else begun[which].copy()
            places, masks = [], []
            for i in range(warm + size):
                if i == warm:
                    begun[which] = state
                state = flat.take(state + steps[i])
                if i >= warm and (found := loud.take(state)).any():
                    where = np.flatnonzero(found)
                    places.append(which[where] * size + (i - warm) + 1)
                    masks.append(self.hits[state[where] // width])
            ended[which] = state
            ends[len(ends)] = (np.concatenate(places), np.concatenate(masks)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        for low in range(0, count, 4096):
            read(np.arange(low, min(count, low + 4096)), overlap)
        again: list[tuple[int, np.ndarray]] = []
        while len(wrong := 1 + np.flatnonzero(begun[1:] != ended[:-1])):
            again.append((len(ends), wrong))
            begun[wrong] = ended[wrong - 1]
            read(wrong, 0)
        for k, wrong in again:  # what an earlier reading of these chunks found does not count
            redone = set(wrong.tolist())
            for j in range(k):
                at, mask = ends[j]
                kept = ~np.isin((at - 1) // size, list(redone))
                ends[j] = at[kept], mask[kept]
        at, mask = np.concatenate([a for a, _ in ends.values()]), np.concatenate([m for _, m in ends.values()])
        order = np.argsort(at, kind="stable")
        return at[order], mask[order]
