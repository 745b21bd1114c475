"""Token ids of whole blocks of text with a published byte-level BPE vocabulary.

Texts are cut before blanks and line breaks that a visible character follows.  The
vocabulary's own splitting always cuts there, so pieces can be encoded apart: each distinct
piece of a block is encoded once, in one call for all of them.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from .words import Block, byte_prefix, span_hash

VOCABULARY = "byte_bpe_50k.json"

# Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xE0] = True  # letters and signs of two bytes; no white space starts so
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True


class Encoder:
    """Ids of a vocabulary file; a name without a folder is one of the installed files."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken
        from tokenizers import Tokenizer

        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        special = set(self.special)
        # Printable bytes stand for themselves, the others for the characters from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.lengths = np.zeros(max(spec["model"]["vocab"].values()) + 1, np.int64)
        for t, i in ranks.items():
            self.lengths[i] = len(t)
        self.bulk = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(vocabulary)

    def one(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.bulk.encode_ordinary(text)

    def rows_with_special(self, block: Block) -> list[int]:
        """Rows that hold the text of a special token: it ends what stands before it, so they stay whole."""
        raw, rows = block.data.tobytes(), set()
        for mark in map(str.encode, self.special):
            at = raw.find(mark)
            while at >= 0:
                rows.add(int(np.searchsorted(block.offs, at, side="right")) - 1)
                at = raw.find(mark, at + 1)
        return sorted(rows)

    def many(self, data: np.ndarray, start: np.ndarray, size: np.ndarray,
             glued: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces of data behind one another, and how many each has; glued: the
        pieces that begin with a cut and so may be encoded in one text."""
        count = np.zeros(len(start), np.int64)
        apart = {k: self.one(data[start[k]:start[k] + size[k]].tobytes().decode("utf-8", "replace"))
                 for k in np.flatnonzero(~glued)}
        for k, ids in apart.items():
            count[k] = len(ids)
        together = np.flatnonzero(glued)
        text = data[ragged(start[together], size[together])].tobytes().decode("utf-8", "replace")
        flat = np.array(self.bulk.encode_ordinary(text), np.uint32)
        upto = np.searchsorted(np.cumsum(self.lengths[flat]), np.cumsum(size[together]), side="left") + 1
        count[together] = np.diff(np.r_[0, upto]) if len(together) else 0
        at = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        out[ragged(at[together], count[together])] = flat
        for k, ids in apart.items():
            out[at[k]:at[k] + count[k]] = ids
        return out, count


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    return Encoder(vocabulary)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for count[0] values, then the same for the others."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def encode_block(block: Block, enc: Encoder, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
    """ids of all rows of the block behind one another, each closed by ``end``; row offsets."""
    data, offs = block.data, block.offs
    filled = np.flatnonzero(np.diff(offs))
    close = 0 if end is None else 1
    if not len(filled):
        return np.full(block.n * close, end or 0, np.uint32), np.arange(block.n + 1) * close
    cut = np.zeros(len(data), bool)
    cut[:-1] = _BREAK[data[:-1]] & _VISIBLE[data[1:]]
    last = offs[1:][filled] - 1
    cut[last] = False
    special = enc.rows_with_special(block)
    for row in special:
        cut[offs[row]:offs[row + 1]] = False
    cut[offs[:-1][filled]] = True
    start = np.flatnonzero(cut)
    stop = np.r_[start[1:], len(data)]
    _, index, inverse = np.unique(span_hash(byte_prefix(block), start, stop), return_index=True, return_inverse=True)
    size = stop[index] - start[index]
    follows = data[np.minimum(start[index] + 1, len(data) - 1)]
    glued = _BREAK[data[start[index]]] & _VISIBLE[follows] & (size > 1)
    for row in special:
        glued &= start[index] != offs[row]
    ids, count = enc.many(data, start[index], size, glued)
    at = np.cumsum(count) - count
    own = count[inverse]
    tokens = ids[ragged(at[inverse], own)]
    upto = np.r_[0, np.cumsum(own)]
    row_offs = upto[np.searchsorted(start, offs)]
    if end is None:
        return tokens, row_offs
    out = np.full(len(tokens) + block.n, end, np.uint32)
    out[np.arange(len(tokens)) + np.repeat(np.arange(block.n), np.diff(row_offs))] = tokens
    return out, row_offs + np.arange(block.n + 1)
