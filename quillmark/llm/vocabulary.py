"""Piece vocabularies of public SentencePiece models."""

from __future__ import annotations

import functools
import os

import numpy as np

SPACE = "▁"


class Trie:
    """The pieces' trie, walked by arrays of places at a time; node 0 is the root.

    Arcs are in an open-addressing table with at most an eighth of its slots taken.
    """

    MULTIPLIER = 0x9E3779B97F4A7C15

    def __init__(self, ids: dict[str, int]):
        nodes, arcs = {"": 0}, {}
        for p in ids:
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    arcs[nodes[p[: n - 1]] << 21 | ord(p[n - 1])] = nodes[p[:n]]
        #: The id of the piece that ends at a node, else -1.
        self.piece = np.full(len(nodes), -1, np.int64)
        for p, i in ids.items():
            self.piece[nodes[p]] = i
        self.bits = max(4, (8 * len(arcs)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        keys, to = np.fromiter(arcs, np.int64, len(arcs)), np.fromiter(arcs.values(), np.int64, len(arcs))
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one slot, the last stays
            done = self.keys[slot] == keys
            self.next[slot[done]] = to[done]
            keys, to, slot = keys[~done], to[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(self.MULTIPLIER)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes after one more character each, -1 where there is none."""
        keys = node << 21 | code
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.next[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.next[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


class Vocabulary:
    """Pieces by id, ids of ordinary pieces, and ids of the byte pieces."""

    def __init__(self, pieces: list[str], kinds: list[str]):
        """kinds: 'normal', 'byte' or 'special' by id."""
        self.pieces, self.kinds = pieces, kinds
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        self.bytes = {int(p[3:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.longest = max(map(len, self.ids), default=1)
        self.trie = Trie(self.ids)
        # Of smoothing: halves with each character of a piece, and byte pieces count as rare.
        self.floor = np.array([0.0 if k == "special" else 0.02 if k == "byte" else 0.5 ** len(p) for p, k in zip(pieces, kinds, strict=True)])


def default_path() -> str:
    """The path of the public 32k piece model, from the package that holds the files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def load_vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of a SentencePiece model file; only the driver reads it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=os.fspath(path or default_path()))
    n = model.get_piece_size()
    kinds = ["byte" if model.is_byte(i) else "special" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal" for i in range(n)]
    return Vocabulary([model.id_to_piece(i) for i in range(n)], kinds)
