"""Packing by power-of-two decomposition.

A document of n tokens (end id included) is cut into floor(n / max_len) pieces of
``max_len`` and the binary expansion of the rest, longest first: every piece has
a power-of-two length, is a sequence of its own (no sequence crosses documents,
nothing is padded) and equal lengths form a bucket.  A sequence id is
``log2(length) << 56 | partition << 32 | counter``: ids of one bucket are
contiguous in the total order, unique without any shuffle or global counter, and
a recomputed partition yields the same ids.

Edge cases: null or empty text is the end id alone (one piece of length 1); a null
``doc_id`` stays null; repeated rows are packed once each; extra columns are
ignored; an empty table gives no rows; a very long text is cut like any other.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import tidy
from tracelake.llm.wordids import default_path, encoder

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, offset long")


def binary_lengths(n: int, max_len: int) -> list[int]:
    """Power-of-two piece lengths of ``n`` tokens, longest first."""
    out = [max_len] * (n // max_len)
    rest = n % max_len
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, max_len: int = 2048,
         with_ids: bool = True) -> DataFrame:
    """Pieces of every document: :data:`PIECE_SCHEMA` plus ``ids`` (uint32 bytes) unless ``with_ids`` is off."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = tokenizer or default_path()
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(path)
        end = end_id.to_bytes(4, "little")
        counters = [0] * max_len.bit_length()
        names = [c.split()[0] for c in schema.split(", ")]

        def batch(rows):
            cols = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, cols)], names=names)

        for b in batches:
            rows, held, doc_ids = [], 0, b.column(0).to_pylist()
            for k, arr in enc.encode_column(b.column(1)):
                doc_id, ids = doc_ids[k], arr.astype("<u4").tobytes() + end
                n, at = len(ids) // 4, 0
                for length in binary_lengths(n, max_len):
                    piece, k = ids[4 * at:4 * (at + length)], length.bit_length() - 1
                    seq = k << 56 | part << 32 | counters[k]
                    counters[k] += 1
                    row = (doc_id, at, length, zlib.crc32(piece), n, seq, 0)
                    rows.append((*row, piece) if with_ids else row)
                    at += length
                held += len(ids)
                if held > 8_000_000:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(cut), schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write ``pack(..., with_ids=True)`` as one folder per sequence length (variable-length batching)."""
    pieces.write.partitionBy("length").parquet(path)
