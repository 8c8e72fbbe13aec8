"""Byte-pair merges of many distinct words at once, with numpy.

For a vocabulary of the tokenizers library whose pre-tokeniser drops white space
and whose words end in a suffix.  Plain words (printable ASCII without the
apostrophe, and the Latin-1 letters) are merged here; all other words go to the
library.  Merging the pairs of least rank in all words at once gives the library's
ids, as a pair with a new symbol always has a later rank than the merge that made it.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from linkspark.llm import common

OTHER, LETTER, DIGIT, MARK = 0, 1, 2, 3
#: Of printable ASCII bytes; the apostrophe begins contractions and is left to the library.
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = MARK
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KINDS[0x30:0x3A] = DIGIT
KINDS[0x27] = OTHER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
NONE = np.int32(1 << 30)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0x100
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Merger:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        assert len(vocab) < 1 << 16
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        names = byte_symbols()
        self.inner = np.array([vocab[x] for x in names], np.int32)
        self.final = np.array([vocab[x + suffix] for x in names], np.int32)
        self.tables = []
        left = np.arange(len(self.keys))
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            table = np.full(1 << 18, -1, np.int32)
            slots = self.slots(self.keys[left], factor)
            table[slots] = left
            self.tables.append((factor, table))
            left = left[table[slots] != left]
            if not len(left):
                break
        assert not len(left)

    @staticmethod
    def slots(keys: np.ndarray, factor: int) -> np.ndarray:
        return (keys * np.uint64(factor)) >> np.uint64(46)

    def ranks(self, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
        keys = lefts.astype(np.uint64) << np.uint64(16) | rights.astype(np.uint64)
        out = np.full(len(keys), NONE, np.int32)
        open_ = None  # keys whose slots so far hold another pair
        for factor, table in self.tables:
            found = table[self.slots(keys, factor)]
            hit = self.keys[found] == keys  # an empty slot gives the last pair, which is compared like any
            if open_ is None:
                out[hit] = found[hit]
                open_ = np.flatnonzero(~hit & (found >= 0))
            else:
                out[open_[hit]] = found[hit]
                open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
            keys = keys[~hit & (found >= 0)]
        return out

    def merge(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(starts and the end, ids) of non-empty pre-tokens."""
        offsets, data = common.bytes_of(pieces)
        n = len(pieces)
        ends = offsets[1:]
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
        done_symbols, done_owner = [], []
        while len(symbols):
            ranks = np.full(len(symbols), NONE, np.int32)
            same = owner[1:] == owner[:-1]
            at = np.flatnonzero(same)
            ranks[at] = self.ranks(symbols[at], symbols[at + 1])
            firsts = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.minimum.reduceat(ranks, firsts)
            sizes = np.diff(np.append(firsts, len(symbols)))
            least = np.repeat(least, sizes)
            over = least == NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                go = ~over
                symbols, owner, ranks, least = symbols[go], owner[go], ranks[go], least[go]
                if not len(symbols):
                    break
            mark = ranks == least
            if (mark[1:] & mark[:-1]).any():  # of overlapping pairs the left ones go first
                spots = np.flatnonzero(mark)
                run = np.concatenate([[0], np.cumsum(np.diff(spots) != 1)])
                first = np.searchsorted(run, run)
                mark[spots[(np.arange(len(spots)) - first) % 2 == 1]] = False
            symbols = np.where(mark, self.made[np.where(mark, ranks, 0)], symbols)
            keep = np.ones(len(symbols), bool)
            keep[1:] = ~mark[:-1]
            symbols, owner = symbols[keep], owner[keep]
        if not done_owner:
            return np.zeros(n + 1, np.int64), np.empty(0, np.int32)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), symbols[order]

    def encode(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(starts and the end, ids) of distinct words without white space; "" has none."""
        n = len(names)
        offsets, data = common.bytes_of(names)
        lengths = np.diff(offsets)
        some = lengths > 0
        kinds = KINDS[data]
        latin = np.flatnonzero(data == 0xC3)
        kinds[latin] = LETTER
        follows = data[np.minimum(latin + 1, len(data) - 1)]
        kinds[np.minimum(latin + 1, len(data) - 1)] = np.where((follows == 0x97) | (follows == 0xB7), OTHER, LETTER)
        bad = np.concatenate([[0], np.cumsum(kinds == OTHER)])
        plain = some & (bad[offsets[1:]] == bad[offsets[:-1]])
        low = LOWER[data]
        low[latin + 1] = np.where((follows <= 0x9E) & (follows >= 0x80), follows + 32, follows)
        keep = np.repeat(plain, lengths)
        low, kinds = low[keep], kinds[keep]
        word_ends = np.cumsum(lengths[plain])
        split = np.ones(len(low), bool)
        split[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
        split[word_ends[:-1]] = True
        firsts = np.flatnonzero(split)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(firsts), [None, pa.py_buffer(np.append(firsts, len(low)).astype(np.int64)), pa.py_buffer(low)]).dictionary_encode()
        part_starts, part_tokens = self.merge(parts.dictionary)
        fast, places = common.gather(part_starts, part_tokens, np.asarray(parts.indices))
        per_word = np.concatenate([[0], np.searchsorted(firsts, word_ends)])
        fast_lengths = np.diff(places[per_word])
        slow = [x.ids for x in self.tokenizer.encode_batch(names.filter(pa.array(some & ~plain)).to_pylist(), add_special_tokens=False)]
        sizes = np.zeros(n, np.int64)
        sizes[plain] = fast_lengths
        sizes[some & ~plain] = [len(x) for x in slow]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(starts[-1], np.int32)
        from_fast = np.repeat(plain, sizes)
        out[from_fast] = fast
        out[~from_fast] = common.compact(slow)[1]
        return starts, out
