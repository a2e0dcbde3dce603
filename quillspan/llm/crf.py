"""A linear-chain conditional random field over tokens, trained and decoded in numpy batches.

A token's features depend on its kind (what the model sees of the word, and whether it is glued to the one before it) and
on the offset from which it is seen; two tokens in a row have features of their pair. So the scores of a batch are sums over
its distinct kinds and pairs, gathered by arrays; nothing is done per token but looking its word up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

REACH = 3
_KEPT = 300_000  # words, kinds and pairs that a worker remembers before it starts anew; speed only
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of each code point: 1 in words, 2 blank, 3 line end, 0 any other mark."""
    if not _CLASSES:
        table = np.zeros(0x110000, np.uint8)
        for code in range(0x110000):
            ch = chr(code)
            table[code] = 1 if ch.isalnum() or ch == "_" else 2 if ch.isspace() else 0
        table[10] = 3
        _CLASSES.append(table)
    return _CLASSES[0]


@dataclass
class Tokens:
    """The tokens of a text: words or single marks, where they start and end, their line, and whether each is glued to the one before."""

    words: list[str]
    starts: np.ndarray
    ends: np.ndarray
    line: np.ndarray
    glued: np.ndarray


def tokens_of(text: str) -> Tokens:
    """The tokens of a text of one or many lines."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[codes] if len(codes) else np.zeros(0, np.uint8)
    word = kind == 1
    before = np.concatenate(([False], word[:-1])) if len(word) else word
    starts = np.flatnonzero((word & ~before) | (kind == 0))
    after = np.concatenate((word[1:], [False])) if len(word) else word
    ends = np.flatnonzero((word & ~after) | (kind == 0)) + 1
    line = np.cumsum(kind == 3)[starts] if len(starts) else np.zeros(0, np.int64)
    glued = np.concatenate(([False], starts[1:] == ends[:-1])) if len(starts) else np.zeros(0, bool)
    return Tokens([text[a:b] for a, b in zip(starts.tolist(), ends.tolist())], starts, ends, line, glued)


def shape(word: str) -> str:
    """The shape of a word: kinds of characters, letters in runs, digits counted up to twelve."""
    if word.isdigit():
        return f"9x{min(len(word), 12)}"
    s = re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", word)
    s = re.sub(r"\d+", lambda m: f"9{min(len(m[0]), 12)}", s)
    return re.sub(r"x+", "x", re.sub(r"X{3,}", "XX", s))


def key(word: str) -> str:
    """What the model sees of a word: its number of digits, the mere shape of identifiers, or the word itself."""
    if any(ch.isdigit() for ch in word):
        return shape(word)
    if "_" in word or re.search(r"[^\W\d_A-Z][A-Z]", word):
        return "<identifier>"
    return word


class Model:
    """Weights by feature, and by move from label to label."""

    def __init__(self, labels: list[str], lexicon: dict[str, str]):
        self.labels, self.lexicon = labels, lexicon
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(labels)))
        self.moves = np.zeros((len(labels), len(labels)))
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered of words; needed after a change of weights or lexicon."""
        self._ids: dict[str, int] = {}
        self._keys: list[str] = []
        self._key_ids: dict[str, int] = {}
        self._single: dict[int, np.ndarray] = {}
        self._double: dict[tuple[int, int], np.ndarray] = {}
        self._shapes: dict[str, str] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def _shape(self, k: str) -> str:
        if (got := self._shapes.get(k)) is None:
            got = self._shapes[k] = k if k[:1] in "<9" else shape(k)
        return got

    def features(self, k: str, glued: bool, offset: int) -> list[str]:
        """The features that a token's kind gives to the token ``offset`` places before it."""
        s, low = self._shape(k), k.lower()
        side = "L" if offset < 0 else "R"
        out = [f"{offset}|{low}", f"{offset}|s{s}"]
        if offset:
            out.append(f"{side}|{low}")
        role = self.lexicon.get(low)
        if role:
            out.append(f"{offset}|r{role}")
        if abs(offset) <= 1:
            out.append(f"{offset}|{s}|{glued}")
        if offset == 0:
            out += [f"0|e{low[-3:]}", f"0|f{low[-4:]}", f"0|b{low[:3]}", f"0|{s}|r{role}", f"0|n{min(len(k), 8)}|{s}"]
        return out

    def pair_features(self, a: str, b: str, glued: bool) -> list[str]:
        sa, sb = (self._shape(w) if w[:1].isalnum() or w[:1] == "<" else w for w in (a, b))
        ra, rb = self.lexicon.get(a.lower()), self.lexicon.get(b.lower())
        return [f"p|{sa}|{sb}|{glued}", f"q|{sa}|{ra}|{sb}|{rb}", f"l|{a.lower()}|{sb}", f"m|{sa}|{b.lower()}"]

    def _kinds(self, tokens: Tokens) -> np.ndarray:
        """The number of each token's kind: twice its key's number, and one more where it is glued."""
        if len(self._ids) > _KEPT:
            self.forget()
        ids, words = self._ids, tokens.words
        for w in set(words) - ids.keys():
            k = key(w)
            number = self._key_ids.setdefault(k, len(self._key_ids))
            if number == len(self._keys):
                self._keys.append(k)
            ids[w] = number
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) * 2 + tokens.glued

    def scores(self, tokens: Tokens) -> np.ndarray:
        """The score of each label for each token."""
        n, size = len(tokens.words), len(self.labels)
        out = np.zeros((n, size))
        if not n:
            return out
        kinds = self._kinds(tokens)
        found, at = np.unique(kinds, return_inverse=True)
        table = np.stack([self._of_kind(k) for k in found.tolist()])
        for j, o in enumerate(range(-REACH, REACH + 1)):
            low, high = max(0, -o), n - max(0, o)
            if low < high:
                same = tokens.line[low:high] == tokens.line[low + o : high + o]
                out[low:high][same] += table[at[low + o : high + o][same], j]
        first = np.concatenate(([True], tokens.line[1:] != tokens.line[:-1]))
        if "first" in self.index:
            out[first] += self.weights[self.index["first"]]
        rest = np.flatnonzero(~first)
        if len(rest):
            wide = int(kinds.max()) + 1
            found, at = np.unique((kinds[rest - 1] >> 1) * wide + kinds[rest], return_inverse=True)
            out[rest] += np.stack([self._of_pair(k // wide, k % wide) for k in found.tolist()])[at]
        return out

    def _sum(self, names: list[str]) -> np.ndarray:
        rows = [self.index[n] for n in names if n in self.index]
        return self.weights[rows].sum(0) if rows else np.zeros(len(self.labels))

    def _of_kind(self, kind: int) -> np.ndarray:
        if (got := self._single.get(kind)) is None:
            k = self._keys[kind >> 1]
            got = self._single[kind] = np.stack([self._sum(self.features(k, bool(kind & 1), o)) for o in range(-REACH, REACH + 1)])
        return got

    def _of_pair(self, a: int, kind: int) -> np.ndarray:
        if len(self._double) > _KEPT:
            self._double = {}
        if (got := self._double.get((a, kind))) is None:
            got = self._double[a, kind] = self._sum(self.pair_features(self._keys[a], self._keys[kind >> 1], bool(kind & 1)))
        return got

    def train(self, tokens: Tokens, gold: np.ndarray, rounds: int = 50, rate: float = 0.15, decay: float = 2e-3) -> None:
        """Maximise the likelihood of the labels by full-batch Adam with a small ridge. Each line is a sequence."""
        size, n = len(self.labels), len(tokens.words)
        kinds = self._kinds(tokens)
        found, kind_at = np.unique(kinds, return_inverse=True)
        first = np.concatenate(([True], tokens.line[1:] != tokens.line[:-1]))
        rest = np.flatnonzero(~first)
        wide = int(kinds.max()) + 1
        pairs, pair_at = np.unique((kinds[rest - 1] >> 1) * wide + kinds[rest], return_inverse=True)
        number = lambda name: self.index.setdefault(name, len(self.index))
        # Groups of features (per offset and kind, per pair, at a line's start), with the features of each group.
        of_kind = [[[number(f) for f in self.features(self._keys[k >> 1], bool(k & 1), o)] for k in found.tolist()] for o in range(-REACH, REACH + 1)]
        of_pair = [[number(f) for f in self.pair_features(self._keys[p // wide], self._keys[(p % wide) >> 1], bool(p & 1 if wide % 2 == 0 else (p % wide) & 1))] for p in pairs.tolist()]
        groups = [*[g for offset in of_kind for g in offset], *of_pair, [number("first")]]
        owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        feature = np.concatenate([np.array(g, np.int64) for g in groups])
        # Which groups each token is in: one column per offset, one for its pair, one for a line's start; the last group is none.
        none, member = len(groups), np.full((n, 2 * REACH + 3), len(groups), np.int64)
        for j, o in enumerate(range(-REACH, REACH + 1)):
            low, high = max(0, -o), n - max(0, o)
            same = tokens.line[low:high] == tokens.line[low + o : high + o]
            member[low:high, j][same] = j * len(found) + kind_at[low + o : high + o][same]
        member[rest, 2 * REACH + 1] = (2 * REACH + 1) * len(found) + pair_at
        member[first, 2 * REACH + 2] = none - 1
        lines = np.cumsum(first) - 1
        start = np.flatnonzero(first)
        column = np.arange(n) - start[lines]
        width, count = int(column.max()) + 1, len(start)
        mask = np.zeros((count, width), bool)
        mask[lines, column] = True
        gold_moves = np.zeros((size, size))
        np.add.at(gold_moves, (gold[rest - 1], gold[rest]), 1)
        truth = np.eye(size)[gold]
        self.weights = np.zeros((len(self.index), size))
        state = [np.zeros_like(x) for x in (self.weights, self.weights, self.moves, self.moves)]
        for step in range(1, rounds + 1):
            sums = np.zeros((none + 1, size))
            for k in range(size):
                sums[:none, k] = np.bincount(owner, self.weights[feature, k], none)
            local = np.zeros((count, width, size))
            local[lines, column] = sums[member].sum(1)
            marginal, moved = self._expect(local, mask)
            miss = truth - marginal[lines, column]
            by_group = np.stack([sum(np.bincount(member[:, c], miss[:, k], none + 1) for c in range(member.shape[1])) for k in range(size)], 1)
            slope = np.stack([np.bincount(feature, by_group[owner, k], len(self.index)) for k in range(size)], 1)
            slopes = [slope - decay * count * self.weights, gold_moves - moved - decay * count * self.moves]
            for j, (target, s) in enumerate(zip((self.weights, self.moves), slopes)):
                m, v = state[2 * j], state[2 * j + 1]
                m += 0.1 * (s - m)
                v += 0.01 * (s * s - v)
                target += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        self.forget()

    def _expect(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels and the expected number of each move, by forward and backward sums."""
        n, width, size = scores.shape
        moves = np.exp(self.moves)
        local = np.exp(scores - scores.max(2, keepdims=True))
        ahead, back = np.zeros_like(local), np.ones_like(local)
        ahead[:, 0] = local[:, 0] / local[:, 0].sum(1, keepdims=True)
        for t in range(1, width):
            step = (ahead[:, t - 1] @ moves) * local[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step / step.sum(1, keepdims=True), ahead[:, t - 1])
        pairs = np.zeros((size, size))
        for t in range(width - 1, 0, -1):
            here = local[:, t] * back[:, t]
            step = here @ moves.T
            total = (ahead[:, t - 1] * step).sum(1)
            pairs += moves * ((ahead[:, t - 1] * (mask[:, t] / total)[:, None]).T @ here)
            back[:, t - 1] = np.where(mask[:, t, None], step / step.sum(1, keepdims=True), back[:, t - 1])
        marginal = ahead * back
        marginal /= marginal.sum(2, keepdims=True)
        return marginal * mask[:, :, None], pairs

    def decode(self, tokens: Tokens) -> np.ndarray:
        """The best label of each token (Viterbi), all lines at once, the longest first so that short ones drop out."""
        scores = self.scores(tokens)
        n = len(scores)
        tags = np.zeros(n, np.int64)
        if not n:
            return tags
        start = np.flatnonzero(np.concatenate(([True], tokens.line[1:] != tokens.line[:-1])))
        lengths = np.diff(np.append(start, n))
        order = np.argsort(-lengths, kind="stable")
        start, lengths = start[order], lengths[order]
        best = scores[start]
        back: list[np.ndarray] = []
        moves = np.ascontiguousarray(self.moves.T)[None]
        last = np.zeros(len(start), np.int64)
        for t in range(1, int(lengths[0]) + 1):
            still = int(np.searchsorted(-lengths, -t, "left"))  # lines longer than t
            last[still : len(best)] = best[still:].argmax(1)
            if not still:
                break
            options = best[:still, None, :] + moves
            step = options.argmax(2)
            back.append(step.astype(np.int8))
            best = np.take_along_axis(options, step[:, :, None], 2)[:, :, 0] + scores[start[:still] + t]
        for t in range(int(lengths[0]) - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, "left"))  # lines that have a token at t
            tags[start[:live] + t] = last[:live]
            if t:
                last[:live] = back[t - 1][np.arange(live), last[:live]]
        return tags
