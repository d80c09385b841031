"""Byte-level BPE ids of whole texts, many at once: numpy cuts the texts into pretokens, and only those not met lately are merged.

Equal to tokenizers' encode(text, add_special_tokens=False) of the given byte-level file whose pretokens are
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ ; texts with code points from FAST_LIMIT on, where Unicode
versions may class a character differently, go to the tokenizer whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from .kernels import mix, powers

U64 = np.uint64
#: Code points below it are classed here.
FAST_LIMIT = 0x2100
#: Pretokens remembered within a task (24 bytes and their ids each); beyond that the memory starts anew.
REMEMBERED = 1 << 18
SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]
LATER = re.compile(f"[{chr(FAST_LIMIT)}-\U0010ffff]")
LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 4
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _classes() -> np.ndarray:
    out = np.full(FAST_LIMIT, OTHER, np.uint8)
    for i in range(FAST_LIMIT):
        out[i] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], OTHER)
    out[SPACE] = BLANK
    return out


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merger(path: str):
    """A function from a pretoken to its ids: by ranks where the file's ids are in the order of its merges, else by the tokenizer itself."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    byte, vocab = _byte_of(), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if not model.get("ignore_merges") and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and all(vocab.get(c, 256) < 256 for c in byte):
        ranks = {bytes(byte[c] for c in k): i for k, i in vocab.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker; what it remembers of texts is dropped with forget_pretokens."""
    return Encoder(path)


def forget_pretokens(path: str) -> None:
    encoder(path)._reset()


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = merger(path)
        self.classes = _classes()
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, U64)  # sorted hashes of pretokens, and where and how many their ids are
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, hashes: np.ndarray, pretokens: list[str]) -> None:
        ids = [self.merge(t) for t in pretokens]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(flat), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        where = np.searchsorted(self.known, hashes)  # both are sorted
        self.known, self.at, self.size = np.insert(self.known, where, hashes), np.insert(self.at, where, at), np.insert(self.size, where, size)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        plain = [t.isascii() or not LATER.search(t) for t in texts]
        out: list = [None] * len(texts)
        slow = [i for i, p in enumerate(plain) if not p]
        for i, e in zip(slow, self.tokenizer.encode_batch([texts[i] for i in slow], add_special_tokens=False) if slow else [], strict=True):
            out[i] = np.array(e.ids, np.uint32)
        fast = [i for i, p in enumerate(plain) if p]
        for i, ids in zip(fast, self._fast([texts[i] for i in fast]), strict=True):
            out[i] = ids
        return out

    def _starts(self, cp: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """True where a pretoken begins; doc: first places of the texts, then the end."""
        n = len(cp)
        kind = self.classes[cp]
        st = np.empty(n + 1, bool)
        st[0] = st[n] = True
        st[1:n] = kind[1:] != kind[:-1]
        st[doc] = True
        run = np.flatnonzero(st[:n])
        end = np.append(run[1:], n)
        last = np.zeros(n + 1, bool)
        last[doc] = True
        blank = (kind[run] == BLANK) & ~last[end]  # a run of white space before something in the same text
        b, e = run[blank], end[blank]
        st[e - 1] = True  # its last character stands apart
        joins = cp[e - 1] == 0x20
        st[e[joins]] = False  # a space goes with what follows
        # '... : an apostrophe alone, nothing attached, then s t m d re ve ll
        a = run[(end - run == 1) & (cp[run] == 0x27)]
        a = a[st[a] & ~last[a + 1]]
        if len(a):
            cps = np.append(cp, [0, 0])
            c1, c2 = cps[a + 1], cps[a + 2]
            same_text = ~last[np.minimum(a + 2, n)]
            one = np.isin(c1, [0x73, 0x74, 0x6D, 0x64])
            two = same_text & (((c1 == 0x72) & (c2 == 0x65)) | ((c1 == 0x76) & (c2 == 0x65)) | ((c1 == 0x6C) & (c2 == 0x6C)))
            st[a[one | two] + 1] = False
            st[a[one] + 2] = True
            st[a[two] + 3] = True
        return st

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        doc = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lens, out=doc[1:])
        if not doc[-1]:
            return [np.zeros(0, np.uint32)] * len(texts)
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        start = np.flatnonzero(self._starts(cp, doc))
        p, inv = powers(len(cp) + 1)
        total = np.zeros(len(cp) + 1, U64)
        np.cumsum((cp.astype(U64) + U64(1)) * p[:-1], out=total[1:])
        s, e = start[:-1], start[1:]
        h = mix((total[e] - total[s]) * inv[s] + (e - s).astype(U64))
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._reset()
        place = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool) if not len(self.known) else self.known[np.minimum(place, len(self.known) - 1)] != unique
        if new.any():
            f = first[new]
            self._learn(unique[new], [whole[a:b] for a, b in zip(s[f].tolist(), e[f].tolist(), strict=True)])
            place = np.searchsorted(self.known, unique)
        at, size = self.at[place][back], self.size[place][back]
        bound = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=bound[1:])
        out = self.flat[np.repeat(at - bound[:-1], size) + np.arange(bound[-1])]
        cut = bound[np.searchsorted(start, doc)]
        return [out[cut[i] : cut[i + 1]] for i in range(len(texts))]
