"""Byte-pair encoding of many words at once: words of one length are rows of a matrix, and each round merges every row's best pair."""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(1 << 30)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBPE:
    """A tokenizer file's model over words that its pre-tokenizer leaves whole."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, end = model["vocab"], model.get("end_of_word_suffix") or ""
        stand_in = byte_alphabet()
        self.inner, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for c, b in stand_in.items():
            self.inner[b] = vocabulary.get(c, -1)
            self.last[b] = vocabulary.get(c + end, -1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.uint64)
        # open addressing; a vectorised probe settles most keys at once
        self.bits = max(12, int(len(keys) * 8).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, np.uint64(2**64 - 1)), np.full(size, _NONE)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.ranks[slot] == _NONE
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.ranks[slot[put]] = keys[left[put]], left[put]
            left, slot = left[~put], (slot[~put] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        flat = keys.ravel()
        out, slot, todo = np.full(flat.shape, _NONE), self._slot(flat), np.arange(len(flat))
        while len(todo):
            s = slot[todo]
            held = self.keys[s]
            hit = held == flat[todo]
            out[todo[hit]] = self.ranks[s[hit]]
            todo = todo[~hit & (held != np.uint64(2**64 - 1))]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        return out.reshape(keys.shape)

    def encode(self, words: list[bytes], dtype: np.dtype) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words])
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            if n:
                self._rows(np.frombuffer(b"".join([words[i] for i in which.tolist()]), np.uint8).reshape(-1, n), which, out, dtype)
        return out

    def _rows(self, raw: np.ndarray, which: np.ndarray, out: list[bytes], dtype: np.dtype) -> None:
        ids = np.concatenate([self.inner[raw[:, :-1]], self.last[raw[:, -1:]]], axis=1)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(which):
            n = ids.shape[1]
            at = ranks.argmin(axis=1) if n > 1 else np.zeros(len(which), np.int64)
            row = np.arange(len(which))
            best = ranks[row, at] if n > 1 else np.full(len(which), _NONE)
            done = best == _NONE
            if done.any():
                flat, step = ids[done].astype(dtype).tobytes(), n * dtype.itemsize
                for k, i in enumerate(which[done].tolist()):
                    out[i] = flat[k * step : (k + 1) * step]
                going = ~done
                ids, ranks, at, best, which = ids[going], ranks[going], at[going], best[going], which[going]
                row = np.arange(len(which))
                if not len(which):
                    return
            # drop the pair's second symbol; its first becomes the merged one
            ids = ids[np.arange(n) != (at + 1)[:, None]].reshape(len(which), n - 1)
            ids[row, at] = self.merged[best]
            ranks = ranks[np.arange(n - 1) != at[:, None]].reshape(len(which), n - 2)
            if n > 2:
                left = np.flatnonzero(at > 0)
                ranks[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])
                right = np.flatnonzero(at < n - 2)
                ranks[right, at[right]] = self.rank(ids[right, at[right]], ids[right, at[right] + 1])
