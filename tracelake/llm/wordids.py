"""Token ids of whole texts with a public tokenizer file.

The tokenizer of ``word_bpe_49k.json`` normalises (NFC, white space, lower case),
splits into letter runs / single digits / other runs and merges inside such a
piece only, so what stands between white space is encoded alike alone or in its
text.  Texts are cut into lower-case pieces with numpy; a piece not seen before by
this Python worker goes to the library's merge model, and ids are gathered from a
table by 64-bit piece hash.  A word with an apostrophe, a bracket that may open a
special token, or any character beyond ASCII and the letters U+00C0..U+00FF is one
piece as it stands and goes through the library's whole tokenizer.
"""

from __future__ import annotations

import numpy as np

from tracelake.llm.bytewords import HashIndex, ragged, span_hashes, text_chunks, words
from tracelake.llm.common import worker_cache

SPACE, LETTER, DIGIT, OTHER, ODD = range(5)


def _tables():
    kind = np.full(256, OTHER, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[65:91] = kind[97:123] = LETTER
    kind[48:58] = DIGIT
    kind[0x80:] = ODD
    kind[0xC3] = LETTER          # lead byte of U+00C0..U+00FF
    kind[0x80:0xC0] = LETTER     # its second byte; U+00D7 and U+00F7 are no letters
    kind[[0x97, 0xB7, ord("'"), ord("<")]] = ODD
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    lower[0x80:0x9F] += 32       # U+00C0..U+00DE
    return kind, lower


KIND, LOWER = _tables()


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Encoder with a table of about ``limit`` pieces: a full table starts anew, then holds at least its chunk's."""

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.limit = self.tokenizer.model, limit
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(256)}
        self._reset()

    def _reset(self):
        self.index = HashIndex(1 << 18)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.start = np.zeros(1 << 17, np.int64)
        self.length = np.zeros(1 << 17, np.int32)
        self.used = 0

    def _encode(self, piece: bytes, odd: bool) -> list[int]:
        s = piece.decode("utf-8")
        if odd:
            return self.tokenizer.encode(s, add_special_tokens=False).ids
        if not (s.isascii() and s.isalpha()):
            s = s.translate(self.table)
        return [t.id for t in self.model.tokenize(s)]

    def _learn(self, hashes, data, starts, ends, odd):
        ids = [self._encode(data[s:e].tobytes(), o) for s, e, o in zip(starts.tolist(), ends.tolist(), odd.tolist())]
        flat = np.fromiter((i for x in ids for i in x), np.uint32)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        numbers = self.index.add(hashes)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.index.n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.start[numbers] = self.used + np.cumsum(sizes) - sizes
        self.length[numbers] = sizes
        self.used += len(flat)

    def pieces(self, data: np.ndarray, bounds: np.ndarray):
        """``data`` lower-cased inside letter runs, and ``starts, ends, odd`` of its pieces."""
        kind = KIND[data]
        starts, ends, _ = words(data, bounds)
        bad = np.flatnonzero(kind == ODD)
        if len(bad):
            at = np.unique(np.searchsorted(starts, bad, "right") - 1)
            kind = kind.copy()
            kind[ragged(starts[at], ends[at] - starts[at])] = ODD
        edge = np.empty(len(data), bool)
        if len(data):
            edge[0] = True
            np.not_equal(kind[1:], kind[:-1], out=edge[1:])
            edge |= kind == DIGIT
            edge[bounds[:-1][bounds[:-1] < len(data)]] = True
        cuts = np.flatnonzero(edge)
        stops = np.append(cuts[1:], len(data))
        keep = kind[cuts] != SPACE
        cuts, stops = cuts[keep], stops[keep]
        return np.where(kind == LETTER, LOWER[data], data), cuts, stops, kind[cuts] == ODD

    def encode_chunk(self, data: np.ndarray, bounds: np.ndarray):
        """``(ids, id bounds)`` of the rows of one chunk."""
        data, starts, ends, odd = self.pieces(data, bounds)
        h = span_hashes(data, starts, ends)
        at = self.index.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            pick = new[first]
            if self.index.n and self.index.n + len(pick) > self.limit:
                self._reset()  # every piece of this chunk is learned again, at once
                _, pick = np.unique(h, return_index=True)
            self._learn(h[pick], data, starts[pick], ends[pick], odd[pick])
            at = self.index.find(h)
            if len(at) and at.min() < 0:
                raise RuntimeError("a piece of this chunk is missing in the table")
        sizes = self.length[at]
        ids = self.flat[ragged(self.start[at], sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return ids, before[np.searchsorted(starts, bounds, "left")]

    def encode_column(self, column):
        """Yield ``(row, ids)`` for every row of an Arrow string column, in order."""
        for lo, data, bounds in text_chunks(column):
            ids, b = self.encode_chunk(data, bounds)
            for k in range(len(bounds) - 1):
                yield lo + k, ids[b[k]:b[k + 1]]

    def encode(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        return self.encode_chunk(data, np.array([0, len(data)]))[0]


def encoder(path: str) -> WordIds:
    """One encoder per Python worker and tokenizer file, as long as no other operator's stage runs there."""
    kept = worker_cache("wordids")
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]
