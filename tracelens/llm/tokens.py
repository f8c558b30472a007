"""Token ids of whole texts by a public tokenizer file, a batch of texts at a time.

Both vocabularies split a text before the model sees it. A lone blank or line break between two other characters is always
such a split, and so is a place between a letter and a punctuation mark other than an apostrophe. So the ids of a text are
those of such pieces, one after the other; each is encoded once and looked up after that. Texts with white space side by side, where a split depends on what follows, go to the tokenizer whole.
With `markers`, as the queries have it, an added token that a text spells out (<|endoftext|>) is its one id, which is what the
file gives by default; such texts go to the tokenizer whole. Without, its letters are encoded like any others.
Pieces are known by a 64-bit hash of their bytes
and length (two that a worker holds at once share one with odds of about 1 in 10**8). The memory is bounded and starts
afresh when full.
"""

from __future__ import annotations

import os
import re

import numpy as np

from tracelens.llm.textbytes import SPACE, Sums
from tracelens.llm.wordbpe import WordBPE

_WIDE_SPACE = re.compile(rb"[\x00\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_LOADED: dict[tuple[str, bool, bool], "WordEncoder"] = {}
MAX_WORDS = 700_000
JOINED = 2000
#: Bytes of text worked on at a time.
BATCH = 1 << 20


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By byte: ASCII letters, and ASCII punctuation without the apostrophe (which contractions hold)."""
    letter, mark = np.zeros(256, bool), np.zeros(256, bool)
    letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    mark[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
    return letter, mark


_LETTER, _MARK = _classes()
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[0, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def plain_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of two-byte Latin letters (U+00C0 to U+023F) whose case and form are one code point."""
    out = _LETTER[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8)) if len(data) else np.zeros(0, np.int64)
    if len(lead):
        a, b = data[lead], data[lead + 1]
        fine = ~((a == 0xC3) & ((b < 0x80) | (b == 0x97) | (b == 0xB7))) & ~((a == 0xC4) & (b == 0xB0))
        out[lead[fine]] = True
        out[lead[fine] + 1] = True
    return out


class WordEncoder:
    """leading: a blank belongs to the word after it (byte-level BPE); else blanks are dropped (word BPE)."""

    def __init__(self, path: str, leading: bool, markers: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.plain, self.parted = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = not markers
        self.vocabulary = self.plain.get_vocab_size(with_added_tokens=True)
        added = self.plain.get_added_tokens_decoder()
        self.part, self.mark = max((i, t.content) for i, t in added.items())
        self.specials = [t.content.encode() for t in added.values()]
        self.leading, self.markers = leading, markers
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        self._forget()
        self.simple = WordBPE(path)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, words: list[bytes]) -> list[bytes]:
        """By the tokenizer itself, many words at a time, parted by its own special token, which splits a text before anything else does."""
        out: list[bytes] = []
        for k in range(0, len(words), JOINED):
            few = words[k : k + JOINED]
            if any(s in w for w in few for s in self.specials):
                out += self.whole([w.decode() for w in few])
                continue
            ids = np.array(self.parted.encode_batch_fast([self.mark.join(w.decode() for w in few)], add_special_tokens=False)[0].ids, self.dtype)
            ends, begin = [*np.flatnonzero(ids == self.part).tolist(), len(ids)], 0
            for end in ends:
                out.append(ids[begin:end].tobytes())
                begin = end + 1
        return out

    def _learn(self, hashes: np.ndarray, words: list[bytes], simple: np.ndarray) -> None:
        """simple: of letters only, which the pre-tokenizer leaves whole. hashes: as sorted as words."""
        plain = [words[i] for i in np.flatnonzero(simple).tolist()]
        asked = plain if self.leading else [w.lower() if w.isascii() else w.decode().lower().encode() for w in plain]
        found: list[bytes] = [b""] * len(words)
        for i, b in zip(np.flatnonzero(simple).tolist(), self.simple.encode(asked, self.dtype), strict=True):
            found[i] = b
        rest = np.flatnonzero(~simple).tolist()
        for i, b in zip(rest, self._encode_new([words[i] for i in rest]), strict=True):
            found[i] = b
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        base = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), self.dtype)])
        hashes = np.concatenate([self.known, hashes])
        order = np.argsort(hashes, kind="stable")
        self.known, self.base, self.size = hashes[order], np.concatenate([self.base, base])[order], np.concatenate([self.size, size])[order]

    def _forget(self) -> None:
        self.known, self.base, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each sorted hash is or would be among the known, whether it is there)"""
        at = np.searchsorted(self.known, hashes)
        there = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        there[inside] = self.known[at[inside]] == hashes[inside]
        return at, there

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that are encoded whole."""
        out = np.zeros(len(offsets) - 1, bool)
        if self.markers:
            raw = data.tobytes()
            found = [m.start() for s in self.specials for m in re.finditer(re.escape(s), raw)]
            out[np.searchsorted(offsets, np.array(found, np.int64), "right") - 1] = True
        if not self.leading or not len(data):
            return out
        space = SPACE[data]
        at = np.flatnonzero(space[1:] & space[:-1]) + 1
        at = at[~np.isin(at, offsets)]
        more = np.flatnonzero(_WIDE_LEAD[data])
        if len(more):  # few: other white space, of one to three bytes
            more = np.array([i for i in more.tolist() if _WIDE_SPACE.match(data[i : i + 3].tobytes())], np.int64)
        out[np.searchsorted(offsets, np.concatenate([at, more]), "right") - 1] = True
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of each text's ids)."""
        n_texts, raw = len(offsets) - 1, data.tobytes()
        odd = self._odd(data, offsets)
        blank, line = data == 0x20, data == 0x0A
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        edge[:-1] |= blank | line
        if self.leading:
            edge[1:] |= line
        else:
            edge[1:] |= blank | line
        letter, mark = plain_letters(data), _MARK[data]
        edge[1:-1] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        cut = np.flatnonzero(edge)
        start, end = cut[:-1], cut[1:]
        keep = end > start
        if not self.leading and len(start):
            keep &= ~(blank | line)[start]
        start, end = start[keep], end[keep]
        owner = np.searchsorted(offsets, start, "right") - 1
        if odd.any():
            fine = ~odd[owner]
            start, end, owner = start[fine], end[fine], owner[fine]
        hashes, at, inverse = np.unique(Sums(data).spans(start, end), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > MAX_WORDS:
            self._forget()
        place, there = self._find(hashes)
        if not there.all():
            new = ~there
            letters = np.concatenate([[0], np.cumsum(letter)])
            a, b = start[at[new]], end[at[new]]
            lone = blank[a] if self.leading else np.zeros(len(a), bool)
            self._learn(hashes[new], [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], letters[b] - letters[a] + lone == b - a)
            place, _ = self._find(hashes)
        base, size, flat = self.base[place], self.size[place], self.flat
        count = size[inverse]
        total = np.zeros(n_texts + 1, np.int64)
        per_text = np.bincount(owner, weights=count, minlength=n_texts).astype(np.int64) if len(owner) else np.zeros(n_texts, np.int64)
        whole = {}
        if odd.any():
            which = np.flatnonzero(odd).tolist()
            whole = dict(zip(which, self.whole([raw[offsets[i] : offsets[i + 1]].decode() for i in which]), strict=True))
            for i, b in whole.items():
                per_text[i] = len(b) // self.dtype.itemsize
        np.cumsum(per_text, out=total[1:])
        # each id's place in flat: its word's base plus its place in the word
        place = np.cumsum(count) - count
        ids = flat[np.repeat(base[inverse] - place, count) + np.arange(int(count.sum()))]
        if whole:
            out = np.empty(total[-1], self.dtype)
            plain = np.ones(total[-1], bool)
            for i, b in whole.items():
                out[total[i] : total[i + 1]] = np.frombuffer(b, self.dtype)
                plain[total[i] : total[i + 1]] = False
            out[plain] = ids
            ids = out
        return ids, total


def encoder(path: str, leading: bool, markers: bool = False) -> WordEncoder:
    """One encoder in a worker, kept from task to task."""
    if (path, leading, markers) not in _LOADED:
        _LOADED[path, leading, markers] = WordEncoder(path, leading, markers)
    return _LOADED[path, leading, markers]
