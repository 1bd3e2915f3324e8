"""Best paths through the pieces of many distinct words at once, in columns.

A word's substrings meet the piece table size by size: a substring is named by the number of its text among all
beginnings of pieces, and the next letter leads to the next number (an equi-join by number and letter) or to none, so
that only substrings which begin a piece are followed. The edges found are folded to the best path of each position,
and the paths are traced back. A step is done for all words of about one length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .pieces import PieceTable

#: So many words, and letters with padding, are folded at once; they bound the arrays.
WORDS_AT_ONCE, LETTERS_AT_ONCE = 8192, 1 << 18
#: Fewer words than this are folded one by one, which also keeps a word of a million letters to a few seconds.
FEW_WORDS = 16
#: A table of beginnings by letters of up to so many fields is held whole; a larger vocabulary's is searched.
DENSE_FIELDS = 1 << 25
#: Stands behind a shorter word. It isn't part of any text in UTF-8, nor of any piece.
PAD = "\udfff"


class Lattice:
    def __init__(self, table: PieceTable):
        self.longest, self.first_byte = table.longest, table.first_byte
        inner = sorted({p[:k] for p, _, _ in table.pieces for k in range(1, len(p))})
        # 0: begins no piece; then the beginnings that go on, then the rest
        node = {text: i for i, text in enumerate(dict.fromkeys(["", *inner, *(p for p, _, _ in table.pieces)]))}
        letters = {c: i for i, c in enumerate(sorted({c for p, _, _ in table.pieces for c in p[1:]}), 1)}
        self.node = node
        self.rows, self.width = len(inner) + 1, len(letters) + 1
        self.first = np.zeros(0x110000, np.int32)
        self.letter = np.zeros(0x110000, np.int32)
        self.nodes = np.min_scalar_type(len(node))
        self.piece = np.full(len(node), -1, np.int32)
        self.size = np.ones(len(node), np.int32)
        self.score = np.full(len(node), -np.inf)
        for c, i in letters.items():
            self.letter[ord(c)] = i
        for text, i in node.items():
            if len(text) == 1:
                self.first[ord(text)] = i
            elif text:
                self.size[i] = len(text)
        edges = sorted((node[text[:-1]] * self.width + letters[text[-1]], i) for text, i in node.items() if len(text) > 1)
        self.keys, self.ends = np.array([k for k, _ in edges], np.int64), np.array([i for _, i in edges], self.nodes)
        self.dense = None
        if self.rows * self.width <= DENSE_FIELDS:
            self.dense = np.zeros(self.rows * self.width, self.nodes)
            self.dense[self.keys] = self.ends
        for text, piece, score in table.pieces:
            self.piece[node[text]], self.score[node[text]] = piece, score
        # a letter that is no piece is an unknown one
        self.alone = np.where(self.piece < 0, table.unknown_score, self.score)
        self.lists = self.alone.tolist(), self.score.tolist()

    def _next(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The number of each substring with one letter more."""
        node = np.where(node < self.rows, node, 0)
        if self.dense is not None:
            return self.dense[node * np.int32(self.width) + letter]
        key = node * np.int64(self.width) + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ends[at], 0) if len(self.keys) else np.zeros_like(node)

    def paths(self, words: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """(words, number of ids of each, ids of all) for parts of the words, which are distinct and not empty."""
        words = sorted(words, key=len)
        at = 0
        while at < len(words):
            n, end = len(words[at]), at + 1
            while end < len(words) and end - at < WORDS_AT_ONCE and len(words[end]) <= n + n // 8 and (end + 1 - at) * len(words[end]) <= LETTERS_AT_ONCE:
                end += 1
            yield words[at:end], *(self._fold if end - at >= FEW_WORDS else self._fold_few)(words[at:end])
            at = end

    def _fold_few(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        node_of, (alone, later) = self.node.get, self.lists
        counts, ids = [], []
        for word in words:
            best, via = [0.0] + [float("-inf")] * len(word), [0] * (len(word) + 1)
            for start, c in enumerate(word):
                node, score = node_of(c, 0), alone
                for end in range(start + 1, min(start + self.longest, len(word)) + 1):
                    if end > start + 1:
                        node, score = node_of(word[start:end]), later
                    if node is None:
                        break
                    value = best[start] + score[node]
                    if value > best[end]:
                        best[end], via[end] = value, node
            at, found = len(word), []
            while at:
                piece = int(self.piece[via[at]])
                at -= int(self.size[via[at]])
                found += [piece] if piece >= 0 else [self.first_byte + b for b in reversed(word[at].encode())]
            counts.append(len(found))
            ids += reversed(found)
        return np.array(counts, np.int64), np.array(ids, np.int32)

    def _fold(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n, many = len(words[-1]), len(words)
        codes = np.frombuffer("".join([w.ljust(n, PAD) for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(many, n).T.astype(np.int32, order="C")
        first, letter = self.first[codes], self.letter[codes]
        best = np.full((n + 1, many), -np.inf)
        via = np.zeros((n + 1, many), self.nodes)  # the last edge of the best path to here
        best[0] = 0.0
        for start in range(n):
            node, score = first[start], self.alone
            for end in range(start + 1, min(start + self.longest, n) + 1):
                value = best[start] + score[node]
                better = value > best[end]  # a later start must be strictly better
                np.copyto(best[end], value, where=better)
                np.copyto(via[end], node, where=better, casting="unsafe")
                if end == n:
                    break
                node, score = self._next(node, letter[end]), self.score
                if not node.any():
                    break
        # from each word's end to its start, then in order of words and letters
        at, who, found = np.array([len(w) for w in words]), np.arange(many), []
        while len(who):
            node = via[at, who]
            at = at - self.size[node]
            found.append((who, at, self.piece[node]))
            who, at = who[at > 0], at[at > 0]
        who, at, ids = (np.concatenate(x) for x in zip(*reversed(found), strict=True))
        order = np.argsort(who, kind="stable")
        who, at, ids = who[order], at[order], ids[order]
        unknown = codes[at, who][ids < 0]
        if len(unknown):
            sizes = np.ones(len(ids), np.int64)
            sizes[ids < 0] = 1 + (unknown > 0x7F) + (unknown > 0x7FF) + (unknown > 0xFFFF)
            who, ids = np.repeat(who, sizes), np.repeat(ids, sizes)
            ids[ids < 0] = self.first_byte + np.frombuffer(unknown.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        return np.bincount(who, minlength=many), ids
