"""Byte-level BPE ids with the tokenizers library, for many texts at once.

The library's own splitting costs about one microsecond a byte, its merging far less. Texts are therefore cut
where a token of this kind begins whatever surrounds it; each distinct unit is split and merged once with the library's
model, and its ids are kept for the next texts. A unit is looked up by a hash and then compared byte by byte. Texts with
rarer white space, with the string of an added token, or with a unit that shares another's hash go to the library whole.
The tests hold the ids against the library's own.
"""

from __future__ import annotations

import os
import re

import numpy as np

from . import common, textkernel

#: White space besides \x20 and \x09-\x0D that can be part of a token of white space.
_RARE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[0x1C, 0x1D, 0x1E, 0x1F, 0xE1, 0xE2, 0xE3]] = True
#: 1: ASCII letters, 2: ASCII punctuation, 3: white space but the space.
_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(128) if chr(b).isalpha()]] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2
_KIND[range(9, 14)] = 3
_encoders: dict[str, BpeEncoder] = {}


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> BpeEncoder:
    """One for each Python worker: workers are reused, so later tasks find most units already known."""
    if path not in _encoders:
        _encoders[path] = BpeEncoder(path)
    return _encoders[path]


def _alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in vocabularies of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BpeEncoder:
    #: Units kept at most; beyond that the table is begun anew. It bounds memory and changes no result.
    MOST = 300_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.table = {b: ord(c) for b, c in _alphabet().items()}
        self.dtype = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.start = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, self.dtype)
        self.used = 0
        self.text_at = np.zeros((1 << 12) + 1, np.int64)  # where each unit's bytes begin, and the last one's end
        self.text = np.zeros(1 << 16, np.uint8)

    def _unit(self, raw: bytes) -> list[int]:
        tokenize, table = self.model.tokenize, self.table
        body = raw[1:] if raw[:1] == b" " else raw
        if body.isalpha():  # ASCII letters: one piece, whose characters stand for themselves
            return [t.id for t in tokenize(("\u0120" if body is not raw else "") + body.decode("ascii"))]
        return [t.id for piece in self.split(raw.decode("utf-8")) for t in tokenize(piece.encode().decode("latin-1").translate(table))]

    def _learn(self, keys: list[int], units: list[bytes]) -> None:
        ids = [self._unit(u) for u in units]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(sizes.sum()), len(self.known)
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), self.dtype)])
        while len(self.start) < n + len(keys):
            self.start = np.concatenate([self.start, np.zeros(len(self.start), np.int64)])
            self.size = np.concatenate([self.size, np.zeros(len(self.size), np.int64)])
            self.text_at = np.concatenate([self.text_at, np.zeros(len(self.text_at) - 1, np.int64)])
        ends = int(self.text_at[n]) + np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        while len(self.text) < ends[-1]:
            self.text = np.concatenate([self.text, np.zeros(len(self.text), np.uint8)])
        self.text[self.text_at[n] : ends[-1]] = np.frombuffer(b"".join(units), np.uint8)
        self.text_at[n + 1 : n + 1 + len(units)] = ends
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), self.dtype, total)
        self.start[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.used += total
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))

    def _added(self, raw: np.ndarray) -> list[int]:
        """Places of the added tokens' strings."""
        data, found = raw.tobytes(), []
        for s in self.added:
            i = data.find(s)
            while i >= 0:
                found.append(i)
                i = data.find(s, i + 1)
        return found

    def _mistaken(self, raw: np.ndarray, starts: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Units that aren't, byte by byte, the ones that their hashes found."""
        size = np.diff(np.append(starts, len(raw)))
        wrong = self.text_at[slot + 1] - self.text_at[slot] != size
        own = self.text[np.minimum(common.ragged(self.text_at[slot], size), len(self.text) - 1)]
        differs = np.flatnonzero(own != raw)
        wrong[np.searchsorted(starts, differs, "right") - 1] = True
        return np.flatnonzero(wrong)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids before each text (one entry more than texts)."""
        n_texts = len(at) - 1
        odd: dict[int, list[int]] = {}
        if len(raw) and _SUSPECT[raw].any() or len(raw) > 1 and ((raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0))).any():
            for i in range(n_texts):
                text = raw[at[i] : at[i + 1]].tobytes().decode("utf-8")
                if _RARE.search(text):
                    odd[i] = self.whole.encode(text, add_special_tokens=False).ids
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(n_texts + 1, np.int64)
        whole = self._added(raw)
        # A token surely begins at white space after another character, at punctuation after an ASCII letter, and at
        # an ASCII letter after one character of white space other than a space.
        cut = np.zeros(len(raw), bool)
        space, kind = textkernel.SPACE[raw], _KIND[raw]
        cut[1:] = space[1:] & ~space[:-1] | (kind[1:] == 2) & (kind[:-1] == 1)
        cut[2:] |= (kind[2:] == 1) & (kind[1:-1] == 3) & ~space[:-2]
        cut[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        keys, first, inverse = np.unique(textkernel.segment_hashes(raw, starts), return_index=True, return_inverse=True)
        if len(self.known) > self.MOST:
            self._clear()
        named = keys.tolist()
        new = [i for i, k in enumerate(named) if k not in self.known]
        if new:
            s, e, data = starts[first[new]].tolist(), ends[first[new]].tolist(), raw.tobytes()
            self._learn([named[i] for i in new], [data[a:b] for a, b in zip(s, e, strict=True)])
        slot = np.fromiter(map(self.known.__getitem__, named), np.int64, len(named))[inverse]
        whole += starts[self._mistaken(raw, starts, slot)].tolist()
        for i in set((np.searchsorted(at, np.array(whole, np.int64), "right") - 1).tolist()) - set(odd):
            odd[i] = self.whole.encode(raw[at[i] : at[i + 1]].tobytes().decode("utf-8"), add_special_tokens=False).ids
        sizes = self.size[slot]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[common.ragged(self.start[slot], sizes)]
        ids_at = before[np.searchsorted(starts, at)]
        if odd:
            parts = [np.array(odd[i], self.dtype) if i in odd else ids[ids_at[i] : ids_at[i + 1]] for i in range(n_texts)]
            ids = np.concatenate(parts)
            ids_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, ids_at
