"""Token ids of whole Arrow batches, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

A byte-level BPE never merges across pre-tokens, and texts repeat theirs. So the pre-tokenizer's
pattern is applied to a whole batch with array operations, and the library's model only sees each
distinct pre-token once for each worker. Texts with characters whose Unicode class may differ
between versions, or with the vocabulary's added tokens, go through the library as a whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quillon.llm import kernel as K

END_ID = 2
_OTHER, _LETTER, _NUMBER, _SPACE, _UNSURE = range(5)
#: Blocks whose characters have had one class for as long as the pattern's engine exists.
_SURE = ((0x0000, 0x0377), (0x0384, 0x052F), (0x2000, 0x2064), (0x20A0, 0x20BF), (0x2100, 0x2BFF), (0x3000, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E), (0x1F300, 0x1F64F))
_WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Bytes of distinct pre-tokens that a worker remembers (some 45 for each); beyond that it starts anew.
_REMEMBERED = 96 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, _UNSURE, np.uint8)
    for a, b in _SURE:
        for c in range(a, b + 1):
            kind = unicodedata.category(chr(c))
            out[c] = _UNSURE if kind in ("Cn", "Co", "Cs") else {"L": _LETTER, "N": _NUMBER}.get(kind[0], _OTHER)
    out[list(_WHITE)] = _SPACE
    return out


@lru_cache(maxsize=1)
def _byte_chars() -> str:
    """The characters that byte-level vocabularies write bytes as: printable ones as themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else n))
        n += b not in plain
    return "".join(out)


class Encoder:
    def __init__(self, path: str, plain: bool = False):
        """With ``plain`` the strings of special tokens are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = plain
        self._model = self._library.model
        self._added = [t.content.encode() for t in self._library.get_added_tokens_decoder().values() if not (plain and t.special)]
        self._table = str.maketrans({chr(i): c for i, c in enumerate(_byte_chars())})
        self._forget()

    def _forget(self) -> None:
        self._hashes, self._number = np.empty(0, K.U64), np.empty(0, np.int32)  # ascending hashes, and which pre-token each is
        self._start, self._size = np.empty(0, np.int64), np.empty(0, np.int32)
        self._pool, self._pool_used = np.empty(1 << 18, np.uint32), 0

    def _held(self) -> int:
        return 24 * len(self._hashes) + 4 * len(self._pool)

    def _learn(self, hashes: np.ndarray, first: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Numbers of the distinct pre-tokens, given in order of their hashes; new ones are encoded."""
        at = np.searchsorted(self._hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = np.flatnonzero(at < len(self._hashes))
        known[inside] = self._hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            tokenize, raw, table = self._model.tokenize, data.tobytes(), self._table
            found = [[t.id for t in tokenize(raw[a:b].decode("latin-1").translate(table))] for a, b in zip(first[new].tolist(), end[new].tolist(), strict=True)]
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            total = int(sizes.sum())
            while self._pool_used + total > len(self._pool):
                self._pool = np.concatenate((self._pool, np.empty_like(self._pool)))
            self._pool[self._pool_used : self._pool_used + total] = [i for ids in found for i in ids]
            numbers = len(self._start) + np.arange(len(new), dtype=np.int32)
            self._start = np.concatenate((self._start, self._pool_used + np.cumsum(sizes, dtype=np.int64) - sizes))
            self._size = np.concatenate((self._size, sizes))
            self._pool_used += total
            self._hashes, self._number = np.insert(self._hashes, at[new], hashes[new]), np.insert(self._number, at[new], numbers)
            at = np.searchsorted(self._hashes, hashes)
        return self._number[at]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the rows of a buffer, one after another, and the bounds of each row among them."""
        if self._held() > _REMEMBERED:
            self._forget()
        ids, cut, whole = self._encode_sure(data, bounds)
        if not len(whole):
            return ids, cut
        parts, sizes = [], np.diff(cut)
        raw = {r: self._library.encode(data[bounds[r] : bounds[r + 1]].tobytes().decode(), add_special_tokens=False).ids for r in whole.tolist()}
        for r in range(len(bounds) - 1):
            part = np.asarray(raw[r], np.uint32) if r in raw else ids[cut[r] : cut[r + 1]]
            parts.append(part)
            sizes[r] = len(part)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))

    def _encode_sure(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n_rows = len(bounds) - 1
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        if not len(at):
            return np.empty(0, np.uint32), np.zeros(n_rows + 1, np.int64), np.empty(0, np.int64)
        point = data[at].astype(np.int64)
        for low, bits, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
            which = np.flatnonzero((point >= low) & (point < 0x100) & (data[at] >= low) & (data[at] < (0xE0, 0xF0, 0x100)[more - 1]))
            if len(which):
                value = data[at[which]].astype(np.int64) & bits
                for k in range(1, more + 1):
                    value = value << 6 | (data[at[which] + k] & 0x3F)
                point[which] = value
        kind = _classes()[point]
        rows = np.searchsorted(at, bounds)  # row bounds among the characters
        whole = set((np.searchsorted(rows, np.flatnonzero(kind == _UNSURE), side="right") - 1).tolist())
        if self._added:
            raw = data.tobytes()
            for word in self._added:
                i = raw.find(word)
                while i >= 0:
                    r = int(np.searchsorted(bounds, i, side="right")) - 1
                    whole.add(r)
                    i = raw.find(word, i + 1)
        kind = np.where(kind == _UNSURE, _OTHER, kind)
        n = len(kind)
        row_start = np.zeros(n + 1, bool)
        row_start[rows] = True
        start = np.ones(n + 1, bool)
        start[1:n] = (kind[1:] != kind[:-1]) | row_start[1:n]
        run = np.flatnonzero(start[:n])
        end = np.concatenate((run[1:], [n]))
        kind_of = kind[run]
        # the last white character before a word is a token alone, or a space begins the word
        w = (kind_of == _SPACE) & ~row_start[end]
        last = end[w] - 1
        start[last] = True
        joins = point[last] == 32
        start[last[joins] + 1] = False
        # 's 't 're 've 'm 'll 'd where an apostrophe stands alone before letters
        q = run[(end - run == 1) & (point[run] == 39)]
        q = q[start[q] & (q + 1 < n)]
        q = q[(kind[q + 1] == _LETTER) & ~row_start[q + 1]]
        if len(q):
            one = point[q + 1]
            two = np.where((q + 2 < n) & (kind[np.minimum(q + 2, n - 1)] == _LETTER) & ~row_start[np.minimum(q + 2, n)], point[np.minimum(q + 2, n - 1)], 0)
            takes = np.isin(one, [ord(c) for c in "stmd"]) * 1
            for pair in ("re", "ve", "ll"):
                takes = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 2, takes)
            for t in (1, 2):
                c = q[takes == t]
                start[c + 1] = False
                inner = c[(c + 1 + t < n)]
                inner = inner[(kind[inner + 1 + t] == _LETTER) & ~row_start[inner + 1 + t]]
                start[inner + 1 + t] = True
        first = np.flatnonzero(start[:n])
        from_byte = at[first]
        to_byte = np.concatenate((from_byte[1:], [len(data)]))
        hashes = K.Spans(data).hash(from_byte, to_byte)
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        number = self._learn(distinct, from_byte[index], to_byte[index], data)[inverse.reshape(-1)]
        size = self._size[number].astype(np.int64)
        ids = self._pool[K.ragged(self._start[number], size)]
        total = np.concatenate(([0], np.cumsum(size)))
        return ids, total[np.searchsorted(first, rows)], np.array(sorted(whole), np.int64)


@lru_cache(maxsize=1)
def encoder(path: str, plain: bool = False) -> Encoder:
    """One for each worker."""
    return Encoder(path, plain)


def _pieces(data: np.ndarray, most: int) -> list[int]:
    """Places that cut a long text into pieces of about ``most`` bytes without changing its tokens.

    A single space between two printable ASCII characters always begins a pre-token. A text without
    such a space comes whole.
    """
    printable = lambda x: (x > 32) & (x < 127)
    cuts, at = [0], most
    while at + 2 < len(data):
        near = data[at - 1 : at + 65536]
        found = np.flatnonzero((near[1:-1] == 32) & printable(near[:-2]) & printable(near[2:]))
        if len(found):
            at += int(found[0])
            cuts.append(at)
            at += most
        else:
            at += 65000
    return [*cuts, len(data)]


def encode_column(column: pa.Array | pa.ChunkedArray, path: str, end_id: int | None = END_ID):
    """For runs of rows: first row, ids one after another (each row's end id included), row bounds."""
    data, start, end = K.utf8(column)
    own = encoder(path)
    for i, j in K.blocks(start, end):
        buffer, bounds = K.gather(data, start[i:j], end[i:j])
        if j == i + 1 and len(buffer) > 2 * K.BLOCK_BYTES:
            cuts = _pieces(buffer, K.BLOCK_BYTES)
            ids = np.concatenate([own.encode(buffer[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            cut = np.array([0, len(ids)])
        else:
            ids, cut = own.encode(buffer, bounds)
        if end_id is not None:
            ids = np.insert(ids, cut[1:], np.uint32(end_id))
            cut = cut + np.arange(len(cut))
        yield i, ids.astype("<u4", copy=False), cut
