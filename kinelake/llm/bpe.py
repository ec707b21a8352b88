"""Byte-level BPE by speculation and verification.

A word is cut greedily into the longest tokens (the speculation). The cut is the
encoding exactly if no merge of the vocabulary would ever join tokens across one
of its cuts. At any moment of the merging, the token left of a cut is a node on
the right edge of the left token's merge tree, the token right of it one on the
left edge of the right token's tree. So a pair of tokens is compatible if no
merge (x, y) of such nodes comes before x or y is taken up by its own parent.
This test runs on arrays over all distinct adjacent pairs of a batch at once;
only words with an incompatible pair go through exact merging.

Between x's parent and a crossing merge of equal rank the parent wins, as it
lies further left; between y's parent and a crossing merge of equal rank the
crossing wins.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
from itertools import chain

import numpy as np
import regex

#: The pattern that splits text before the merges; a fixed value of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_PATH = "/opt/tokenizers"
FAR = np.int64(1) << 40
_MEMO_WORDS = 400_000
_MEMO_PAIRS = 2_000_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a vocabulary file: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        self.ids: dict[bytes, int] = {}
        by_text = model["vocab"]
        for text, i in by_text.items():
            if all(c in alphabet for c in text):
                self.ids[bytes(alphabet[c] for c in text)] = i
        size = max(by_text.values()) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)  # when a token is formed; single bytes are there from the start
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = [], []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = by_text[a], by_text[b], by_text[a + b]
            if (x, y) in self.merges:
                continue
            self.merges[x, y] = (r, z)
            keys.append(x << 32 | y)
            ranks.append(r)
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        order = np.argsort(keys)
        self.keys, self.ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.bytes_ = [self.ids[bytes([b])] for b in range(256)]
        self.longest: dict[bytes, int] = {}  # by the first two bytes
        for t in self.ids:
            self.longest[t[:2]] = max(len(t), self.longest.get(t[:2], 1))
        self.sound = self._sound()

    def _merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge (x, y), FAR where there is none."""
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], FAR)

    def crossing(self, a: np.ndarray, b: np.ndarray, whole: bool = True) -> np.ndarray:
        """True where a merge joins nodes across the cut between a and b. whole=False leaves out the merge of a and b themselves."""
        bad = np.zeros(len(a), bool)
        x, x_end = a.copy(), np.full(len(a), FAR)
        first = True
        while (x >= 0).any():
            y, y_end = b.copy(), np.full(len(b), FAR)
            inner_first = True
            while True:
                live = (x >= 0) & (y >= 0) & ~bad
                if not live.any():
                    break
                if whole or not (first and inner_first):
                    r = self._merge_rank(x[live], y[live])
                    bad[live] |= (r < x_end[live]) & (r <= y_end[live]) & (r < FAR)
                ok = y >= 0
                y_end = np.where(ok, self.rank[y], y_end)
                y = np.where(ok, self.left[y], -1)
                inner_first = False
            ok = x >= 0
            x_end = np.where(ok, self.rank[x], x_end)
            x = np.where(ok, self.right[x], -1)
            first = False
        return bad

    def _sound(self) -> np.ndarray:
        """True for tokens that their own bytes are encoded to."""
        sound = self.rank < 0
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made], kind="stable")]
        clean = ~self.crossing(self.left[made], self.right[made], whole=False)
        for t, c in zip(made, clean):
            sound[t] = c and sound[self.left[t]] and sound[self.right[t]]
        return sound


class Encoder:
    """Encodes words and texts; keeps what it has seen, within fixed limits."""

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.exact_words = 0

    def greedy(self, word: bytes) -> list[int]:
        """Longest tokens from left to right."""
        ids, longest = self.v.ids, self.v.longest
        out, at, n = [], 0, len(word)
        while at < n:
            size = min(longest.get(word[at : at + 2], 1), n - at)
            while size > 1 and word[at : at + size] not in ids:
                size -= 1
            out.append(ids[word[at : at + size]])
            at += size
        return out

    def exact(self, word: bytes) -> list[int]:
        """The merges in their order, by a heap of the pairs at hand."""
        merges, n = self.v.merges, len(word)
        token = [self.v.bytes_[b] for b in word]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, token[i], token[i + 1]) for i in range(n - 1) if (m := merges.get((token[i], token[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i] = merges[a, b][1]
            token[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get((token[i], token[after[i]])):
                    heapq.heappush(heap, (m[0], i, token[i], token[after[i]]))
            if before[i] >= 0:
                p = before[i]
                if m := merges.get((token[p], token[i])):
                    heapq.heappush(heap, (m[0], p, token[p], token[i]))
        return [t for t in token if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't known yet, all together."""
        if not words:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        cuts = [self.greedy(w) for w in raw]
        flat = np.fromiter(chain.from_iterable(cuts), np.int64)
        owner = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        failed = np.zeros(len(cuts), bool)
        failed[owner[~self.v.sound[flat]]] = True
        inner = owner[1:] == owner[:-1]
        pair = (flat[:-1] << 32 | flat[1:])[inner]
        distinct, place = np.unique(pair, return_inverse=True)
        known = [self.pairs.get(int(p)) for p in distinct]
        new = np.array([k is None for k in known], bool)
        bad = np.array([bool(k) for k in known], bool)
        if new.any():
            if len(self.pairs) > _MEMO_PAIRS:
                self.pairs.clear()
            fresh = distinct[new]
            bad[new] = self.v.crossing(fresh >> 32, fresh & 0xFFFFFFFF)
            self.pairs.update(zip(fresh.tolist(), bad[new].tolist()))
        failed[owner[1:][inner][bad[place]]] = True
        for k in np.flatnonzero(failed):
            cuts[k] = self.exact(raw[k])
        self.exact_words += int(failed.sum())
        self.words.update(zip(words, map(tuple, cuts)))

    def prepare(self, texts: list[str | None]) -> list[list[str]]:
        """The words of the texts, all of them known afterwards."""
        if len(self.words) > _MEMO_WORDS:
            self.words.clear()
        split = [self.split(t) if t else [] for t in texts]
        fresh = set().union(*split) - self.words.keys()
        self.learn(sorted(fresh))
        return split

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; an empty array for empty and null texts."""
        words = self.words
        return [np.fromiter(chain.from_iterable(map(words.__getitem__, ws)), np.int32) for ws in self.prepare(texts)]

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        words = self.words
        return [sum(len(words[w]) for w in ws) for ws in self.prepare(texts)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_file(folder: str = DEFAULT_PATH, name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file in the tokenizers' folder."""
    return os.path.join(folder, name)


def ranks_of(path: str) -> dict[bytes, int]:
    """Token ranks of a ``.tiktoken`` file, for comparisons."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
