"""Pre-tokens of Arrow string columns in numpy: the classes of ``tokens.PRETOKEN_LOOKAHEAD`` by run borders.

The pattern's alternatives only look at the class of a character (letter, number, white space, other), so a
token ends where the class changes, apart from three rules: the last white space before another character starts
a token of its own, which takes in what follows if it is a space; ``'s 't 'm 'd 're 've 'll`` at the start of a
token are one; control tokens are cut out first.  Which class a character has is asked of the JVM's regex
(``char_classes``).  Tokens lie one behind the other, so a chunk's bytes and its token borders already are an
Arrow array, which Arrow dictionary-encodes.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracelake.functions.markers import ANY_MARKER, SPECIAL_TOKENS

OTHER, LETTER, NUMBER, WHITE, SPACE = range(5)
SPLIT = "\ue001"
_MARKER = re.compile(ANY_MARKER)
_SPECIAL = frozenset(SPECIAL_TOKENS)
_CLASSES: list[np.ndarray] = []


def char_classes(spark: SparkSession, white: str) -> np.ndarray:
    """Class of every code point in the JVM's regex, asked once a process: all characters in one string, each replaced by
    one that stands for its class.  ``white``: the white space class."""
    if not _CLASSES:
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        t = F.regexp_replace("t", F.lit(f"[^{white[1:-1]}\\p{{L}}\\p{{N}}]"), F.lit("!"))
        for pattern, to in (("\\p{L}", "a"), ("\\p{N}", "0"), (white, " ")):
            t = F.regexp_replace(t, F.lit(pattern), F.lit(to))
        named = spark.createDataFrame([("".join(map(chr, points)),)], "t string").select(t.alias("t")).first()["t"]
        kinds = np.zeros(128, np.uint8)
        kinds[[ord(c) for c in "!a0 "]] = [OTHER, LETTER, NUMBER, WHITE]
        table = np.zeros(0x110000, np.uint8)
        table[points] = kinds[np.frombuffer(named.encode("ascii"), np.uint8)]
        table[32] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def token_borders(data: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte offsets at which the tokens of the pieces ``data[bounds[k]:bounds[k + 1]]`` begin, and the end."""
    if not len(data):
        return np.zeros(1, np.int64)
    if data.max() < 128:
        chars, at = data, None
    else:
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        bounds = np.searchsorted(at, bounds)
    n = len(chars)
    kind = classes[chars]
    first = np.zeros(n + 3, bool)  # of a piece; what lies behind the end is no piece's
    first[bounds] = True
    first[n:] = True
    white = kind >= WHITE
    run = np.where(white, WHITE, kind)
    begin = first[:n].copy()
    begin[1:] |= run[1:] != run[:-1]
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])  # white space before another character
    begin[last] = True
    begin[last[kind[last] == SPACE] + 1] = False
    q = np.flatnonzero((chars == 39) & begin)
    if len(q):
        padded = np.append(chars, [0, 0, 0])
        a, b = padded[q + 1], padded[q + 2]
        inside = ~first[q + 1]
        short = inside & np.isin(a, [ord(c) for c in "stmd"])
        long = np.zeros(len(q), bool)
        for x, y in ("re", "ve", "ll"):
            long |= (a == ord(x)) & (b == ord(y))
        long &= inside & ~first[q + 2]
        begin[q[short | long] + 1] = False
        for ends in (q[short] + 2, q[long] + 3):
            begin[ends[ends < n]] = True
    borders = np.append(np.flatnonzero(begin), n)
    return borders if at is None else at[borders]


def _pieces(column):
    """The column with every text that holds control tokens cut at them, and the piece's row; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    rows = np.arange(len(column))
    try:
        column.cast(pa.large_string())
    except pa.ArrowInvalid:  # as the JVM reads it
        column = pa.array([x.decode("utf-8", "replace").encode() for x in column.to_pylist()], pa.large_binary())
    hit = np.asarray(pc.match_substring(column, b"<|"))
    if not hit.any():
        return column, rows, None
    parts, own, special = [], [], []
    for k, (text, h) in enumerate(zip(column.to_pylist(), hit.tolist())):
        cut = _MARKER.sub(SPLIT + r"\1" + SPLIT, text.decode()).split(SPLIT) if h else [text]
        for p in cut:
            special.append(h and p in _SPECIAL)
            parts.append(p.encode() if h else p)
            own.append(k)
    return pa.array(parts, pa.large_binary()), np.array(own), np.array(special)


def encoded_words(column, classes: np.ndarray, max_bytes: int = 1 << 18, group_bytes: int = 1 << 24):
    """Yield ``(words, indices, row, special)`` for groups of about ``group_bytes``, never cutting a piece: the distinct
    tokens (bytes), the place of each token's word, its row, and whether it is a control token.  Borders are found in
    chunks of ``max_bytes``."""
    import pyarrow as pa

    column, rows, special = _pieces(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = start = 0
    parts, counts = [], []
    while lo < n:
        hi = min(max(int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1, lo + 1), n)
        data, bounds = raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        borders = token_borders(data, bounds, classes)
        if special is not None and special[lo:hi].any():  # whole again
            keep = np.ones(len(borders), bool)
            for k in np.flatnonzero(special[lo:hi]):
                keep[np.searchsorted(borders, bounds[k]) + 1:np.searchsorted(borders, bounds[k + 1])] = False
            borders = borders[keep]
        counts.append(np.diff(np.searchsorted(borders, bounds)))
        parts.append(pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [
            None, pa.py_buffer(np.ascontiguousarray(borders, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]))
        lo = hi
        if lo == n or offsets[lo] - offsets[start] >= group_bytes:
            words = pa.chunked_array(parts).dictionary_encode()  # one dictionary for all chunks
            if len(words):
                at = np.concatenate([np.asarray(c.indices) for c in words.chunks])
                count = np.concatenate(counts)
                own = np.repeat(special[start:lo], count) if special is not None else None
                yield _bytes(words.chunk(words.num_chunks - 1).dictionary), at, np.repeat(rows[start:lo], count), own
            parts, counts, start = [], [], lo


def _bytes(words) -> list[bytes]:
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1].tolist()
    raw = (words.buffers()[2] or b"")
    raw = raw.to_pybytes() if hasattr(raw, "to_pybytes") else raw
    return [raw[a:b] for a, b in zip(offsets, offsets[1:])]
