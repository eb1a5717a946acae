"""Token-id files with Re-Pair grammar compression.

Documents are range-sorted by id; each task tokenises its range and writes one
shard of blocks.  Per block, rounds count all adjacent id pairs inside documents
and replace every frequent pair by a new nonterminal (left to right, several
pairs a round), until a round saves less than ``min_gain`` of the symbols.  A block
stores its rules, the expansion length of each, where every document starts in
symbols and in ids, and the symbols in 16 or 32 bits.  Expansion lengths let
``Block.slice`` decode any id range of a document without the rest.  Shards are
committed through temporary names and a manifest (``llm.files``).

Edge cases: null or empty text is the end id alone; null ids sort last; equal ids
and equal rows are stored one by one in a fixed order; an empty table gives
no files; extra columns are ignored; a very long text makes a block of its own
size.  Ids may be any unsigned 32-bit numbers below 2**32 - 2**20.
"""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.bytewords import ragged
from tracelake.llm.common import shared_path
from tracelake.llm.files import commit, store_of
from tracelake.llm.wordids import default_path, encoder

MAGIC = b"RPIDS001"
HEAD = struct.Struct("<IIQQIB3x")
MANIFEST = "temp string, name string, shard int, docs long, ids long, symbols long, rules long, bytes long"


def repair(ids: np.ndarray, bounds: np.ndarray, min_count: int = 4, min_gain: float = 0.004,
           max_expansion: int = 1024, max_rules: int = 1 << 20):
    """``(symbols, symbol bounds, left, right, expansion lengths, base)`` of ids cut at document bounds.

    A block has at most ``max_rules`` rules; where the ids alone leave room in 16 bits, at most as many as keep
    every symbol of the block in 16 bits, since wider symbols would cost more than further rules save."""
    seq = ids.astype(np.int64)
    last = np.zeros(len(seq), bool)
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    base = int(seq.max()) + 1 if len(seq) else 1
    if base < 1 << 15 or base + 1024 < 1 << 16:
        max_rules = min(max_rules, (1 << 16) - base)  # every symbol fits in 16 bits
    left, right, size = [], [], np.ones(base, np.int64)
    total = 0
    while len(seq) > 1 and total < max_rules:
        a, b = seq[:-1], seq[1:]
        free = ~last[:-1]
        if 2 * int(size.max()) > max_expansion:
            free &= size[a] + size[b] <= max_expansion
        both = (a << 32) | b
        keys = np.sort(both[free])
        if not len(keys):
            break
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(first, len(keys)))
        floor = max(min_count, int(counts.max()) // 16)
        often = np.flatnonzero(counts >= floor)
        if not len(often):
            break
        if len(often) > max_rules - total:
            often = np.sort(often[np.argsort(-counts[often], kind="stable")[:max_rules - total]])
        pairs = keys[first[often]]
        # occurrences, then every other one of a run of overlapping ones
        is_left, is_right = np.zeros(len(size), bool), np.zeros(len(size), bool)
        is_left[pairs >> 32] = True
        is_right[pairs & 0xFFFFFFFF] = True
        maybe = np.flatnonzero(free & is_left[a] & is_right[b])
        want = both[maybe]
        at = np.searchsorted(pairs, want)
        at[at == len(pairs)] = 0
        hit = pairs[at] == want
        pos, rule = maybe[hit], at[hit]
        run = np.concatenate([[True], np.diff(pos) != 1])
        start = np.maximum.accumulate(np.where(run, np.arange(len(pos)), 0))
        even = (np.arange(len(pos)) - start) % 2 == 0
        pos, rule = pos[even], rule[even]
        used = np.unique(rule)
        number = np.zeros(len(pairs), np.int64)
        number[used] = len(size) + np.arange(len(used))
        left.append(pairs[used] >> 32)
        right.append(pairs[used] & 0xFFFFFFFF)
        size = np.concatenate([size, size[left[-1]] + size[right[-1]]])
        total += len(used)
        seq[pos] = number[rule]
        last[pos] = last[pos + 1]
        keep = np.ones(len(seq), bool)
        keep[pos + 1] = False
        before = len(seq)
        seq, last = seq[keep], last[keep]
        if before - len(seq) < min_gain * before and floor <= min_count * 8:
            break
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    ends = np.flatnonzero(last) + 1
    out = np.zeros(len(bounds), np.int64)
    full = bounds[1:] > bounds[:-1]
    out[1:][full] = ends
    return seq, np.maximum.accumulate(out), cat(left), cat(right), size[base:], base


class Block:
    """A block of documents, as stored."""

    def __init__(self, doc_ids, known, sym_at, id_at, left, right, size, symbols, base):
        self.doc_ids, self.known, self.sym_at, self.id_at = doc_ids, known, sym_at, id_at
        self.left, self.right, self.size, self.symbols, self.base = left, right, size, symbols, base
        self._table = None

    @classmethod
    def build(cls, doc_ids: list, ids: np.ndarray, bounds: np.ndarray, **options) -> "Block":
        symbols, at, left, right, size, base = repair(ids, bounds, **options)
        return cls(np.array([0 if d is None else d for d in doc_ids], np.int64),
                   np.array([d is not None for d in doc_ids], np.uint8), at, bounds, left, right, size, symbols, base)

    def pack(self) -> bytes:
        width = 2 if self.base + len(self.left) <= 1 << 16 else 4
        parts = [(self.doc_ids, "<i8"), (self.known, "u1"), (self.sym_at, "<u8"), (self.id_at, "<u8"),
                 (self.left, "<u4"), (self.right, "<u4"), (self.size, "<u4"), (self.symbols, f"<u{width}")]
        head = HEAD.pack(len(self.doc_ids), len(self.left), len(self.symbols), int(self.id_at[-1]), self.base, width)
        return head + b"".join(np.ascontiguousarray(a, dtype=t).tobytes() for a, t in parts)

    @classmethod
    def unpack(cls, raw: bytes) -> "Block":
        docs, rules, symbols, _, base, width = HEAD.unpack_from(raw)
        at, out = HEAD.size, []
        for n, t in ((docs, "<i8"), (docs, "u1"), (docs + 1, "<u8"), (docs + 1, "<u8"), (rules, "<u4"), (rules, "<u4"),
                     (rules, "<u4"), (symbols, f"<u{width}")):
            a = np.frombuffer(raw, t, n, at)
            at += a.nbytes
            out.append(a if t == "u1" else a.astype(np.int64))
        if at != len(raw):
            raise ValueError("a block of another length than its header says")
        return cls(*out, base)

    def _expansions(self):
        """All ids and all rules' expansions in one array, with start and length by symbol."""
        if self._table is None:
            size = np.concatenate([np.ones(self.base, np.int64), self.size])
            start = np.cumsum(size) - size
            flat = np.empty(int(size.sum()), np.uint32)
            flat[:self.base] = np.arange(self.base, dtype=np.uint32)
            for k, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
                s, n = start[self.base + k], size[a]
                flat[s:s + n] = flat[start[a]:start[a] + n]
                flat[s + n:s + n + size[b]] = flat[start[b]:start[b] + size[b]]
            self._table = flat, start, size
        return self._table

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, start, size = self._expansions()
        return flat[ragged(start[symbols], size[symbols])]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.sym_at[k]:self.sym_at[k + 1]])

    def slice(self, k: int, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo:hi`` of document ``k``; only the symbols that cover them are expanded."""
        s = self.symbols[self.sym_at[k]:self.sym_at[k + 1]]
        size = self._expansions()[2][s]
        ends = np.cumsum(size)
        a = int(np.searchsorted(ends, lo, "right"))
        b = int(np.searchsorted(ends, hi, "left")) + 1
        skip = int(ends[a - 1]) if a else 0
        return self.expand(s[a:b])[max(0, lo - skip):max(0, hi - skip)]


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2,
                 block_ids: int = 1_000_000) -> DataFrame:
    """Write ``docs(doc_id, text)`` as shards below ``path``; returns the committed manifest."""
    vocabulary = tokenizer or default_path()
    order = [F.col("doc_id").asc_nulls_last(), F.col("_t"), F.col("_n")]
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("_t"),
                    F.monotonically_increasing_id().alias("_n"))
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, attempt, enc = TaskContext.get().partitionId(), uuid.uuid4().hex, encoder(vocabulary)
        store, base = store_of(path)
        end = np.array([end_id], np.uint32)
        name, stream, index, tally = f"tokens-{part:06d}.rpi", None, [], np.zeros(5, np.int64)
        doc_ids, ids, held = [], [], 0

        def flush():
            nonlocal stream, doc_ids, ids, held
            if stream is None:
                store.create_dir(f"{base}/_temporary", recursive=True)
                stream = store.open_output_stream(f"{base}/_temporary/{attempt}")
                stream.write(MAGIC)
                tally[4] = len(MAGIC)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            block = Block.build(doc_ids, np.concatenate(ids), bounds)
            raw = block.pack()
            stream.write(raw)
            index.append([int(tally[4]), len(raw), len(doc_ids), int(bounds[-1])])
            tally[:] += [len(doc_ids), int(bounds[-1]), len(block.symbols), len(block.left), len(raw)]
            doc_ids, ids, held = [], [], 0

        for b in batches:
            known = b.column(0).to_pylist()
            for k, x in enc.encode_column(b.column(1)):
                doc_ids.append(known[k])
                ids.append(np.concatenate([x, end]))
                held += len(x) + 1
                if held >= block_ids:
                    flush()
        if doc_ids:
            flush()
        rows = []
        if stream is not None:
            foot = json.dumps(index).encode()
            stream.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
            stream.close()
            tally[4] += len(foot) + 8 + len(MAGIC)
            rows = [(f"_temporary/{attempt}", name, part, *tally.tolist())]
        cols = list(zip(*rows)) or [()] * 8
        kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                         names=[x.split()[0] for x in MANIFEST.split(", ")])

    return commit(d.mapInArrow(write, MANIFEST), path)


def blocks(store, file: str):
    """Blocks of one shard, read by its footer index."""
    with store.open_input_file(file) as f:
        f.seek(f.size() - 8 - len(MAGIC))
        tail = f.read()
        if tail[8:] != MAGIC:
            raise ValueError(f"{file} has no footer")
        n = struct.unpack("<Q", tail[:8])[0]
        f.seek(f.size() - 8 - len(MAGIC) - n)
        for at, size, _, _ in json.loads(f.read(n)):
            f.seek(at)
            yield Block.unpack(f.read(size))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``, uint32 bytes) of every document, decoded."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_committed")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    first = manifest.select("name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    # one file per task: the offsets' rows are few, and each stands for a whole file
    shards = first.repartition(max(1, min(10_000, manifest.count())), "name")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def read(batches):
        import zlib

        import pyarrow as pa

        store, base = store_of(path)
        kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for block in blocks(store, f"{base}/{name}"):
                    rows = []
                    whole, at = memoryview(block.expand(block.symbols).astype("<u4").tobytes()), (block.id_at * 4).tolist()
                    for k, (doc, known) in enumerate(zip(block.doc_ids.tolist(), block.known.tolist())):
                        raw = whole[at[k]:at[k + 1]]
                        row = (doc if known else None, start, len(raw) // 4, zlib.crc32(raw))
                        rows.append((*row, bytes(raw)) if with_ids else row)
                        start += len(raw) // 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return shards.mapInArrow(read, schema)


def token_files(docs: DataFrame, **options) -> tuple[str, DataFrame]:
    """Write into a fresh shared folder; ``(path, manifest)``."""
    path = shared_path(docs.sparkSession, "tokens")
    return path, write_tokens(docs, path, **options)
