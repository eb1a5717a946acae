"""BPE training in phases over the distinct-word table, and merging inside one word.

A phase takes many merges at once and still the very ones that sequential BPE takes:

1. Pair counts: one vectorised pass over the words, partial sums per task, a hash aggregate; the most
   frequent pairs come to the driver by per-task top lists (``top_pairs`` rows at most).
2. The phase's pairs are the frequent ones; every other pair has at most ``rest`` occurrences.  Words are
   cut where a pair is not among them, and equal fragments are summed (``max_fragments`` rows at most: else
   fewer pairs are taken).
3. On the fragments the sequential algorithm runs with a heap of counts and an index pair ->
   positions, in numpy arrays (``Places``); a merge touches only the places that hold its pair, all at once.  It stops
   before the first merge that what was cut away could change: a pair (X, Y) lies at a cut only where a symbol that X can end with met one
   that Y can begin with at the phase's start, at most ``rest`` times for each two such symbols.
4. The merges go to the words (``Merger``: those of a batch together, in merge order), words of one symbol leave the
   table, and it is written to the shared folder.  A word table that fits is one phase, uncut.

So pairs are counted once a phase, not once a merge, and phases take more merges the further
training goes.  Sizes on the driver are bounded by the two parameters and the vocabulary.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Pair = tuple[int, int]


def merge_ranks(merges: list[tuple[int, int, int]], start: int = 0) -> dict[Pair, list[int]]:
    """Pair -> its ranks, ascending (a pair can be merged twice: its parts can be made anew later)."""
    ranks: dict[Pair, list[int]] = defaultdict(list)
    for i, (left, right, _) in enumerate(merges, start):
        ranks[left, right].append(i)
    return dict(ranks)


def merge_word(syms: list[int], ranks: dict[Pair, list[int]], made: list[int], replay: bool = False) -> list[int]:
    """The word after its merges: always the one of lowest rank next, the leftmost of equal ones.  A heap of
    (rank, place) over linked symbols: n log n in the word's length.  ``replay`` repeats the training's
    order: a pair made after its own merge waits for a later one of the same pair."""
    n = len(syms)
    if n < 2:
        return syms
    heap = []
    for i in range(n - 1):
        r = ranks.get((syms[i], syms[i + 1]))
        if r:
            heap.append((r[0], i))
    if not heap:
        return syms
    heapq.heapify(heap)
    syms, after, before = list(syms), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    while heap:
        rank, i = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = after[i]
        if j >= n:
            continue
        own = ranks.get((syms[i], syms[j]))
        if not own or rank not in own:
            continue
        syms[i], alive[j] = made[rank], False
        after[i] = j = after[j]
        if j < n:
            before[j] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else n
            if left < 0 or right >= n:
                continue
            r = ranks.get((syms[left], syms[right]))
            if r:
                k = bisect_right(r, rank) if replay else 0
                if k < len(r):
                    heapq.heappush(heap, (r[k], left))
    return [s for s, a in zip(syms, alive) if a]


class Merger:
    """``merge_word`` for many words at once, in numpy.  A round takes the lowest rank of every word and merges all
    places that have it; only the pairs beside them are looked up again.  Words where the order inside a rank could
    matter (a pair of several ranks in a replay, or a new pair of lower rank) go through ``merge_word``."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, merges: list[tuple[int, int, int]], made: list[int], replay: bool = False):
        self.ranks, self.made, self.replay = merge_ranks(merges), list(made), replay
        known = sorted(((a << 32) | b, r) for (a, b), r in self.ranks.items())
        self.codes = np.array([c for c, _ in known], np.int64)
        self.first = np.array([r[0] for _, r in known], np.int32)
        self.several = np.array([len(r) > 1 for _, r in known], bool)
        self.to = np.array(self.made, np.int32)

    def look_up(self, left: np.ndarray, right: np.ndarray):
        """First rank of every pair (``NONE``: no merge) and whether it has several."""
        codes = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[at] == codes
        return np.where(hit, self.first[at], self.NONE), hit & self.several[at]

    def merge(self, flat: np.ndarray, lengths: np.ndarray):
        """Symbols of words one behind the other, and the words' lengths, after all merges."""
        lengths = np.asarray(lengths, np.int64)
        if not len(self.codes) or not len(flat):
            return flat.astype(np.int32), lengths
        sym, word = flat.astype(np.int32), np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(sym), self.NONE)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], several = self.look_up(sym[inner], sym[inner + 1])
        odd = np.zeros(len(lengths), bool)
        if self.replay:
            odd[word[inner[several]]] = True
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
            low = np.minimum.reduceat(rank, starts)
            over = (low == self.NONE) | odd[word[starts]]
            if over.any():
                size = np.diff(np.append(starts, len(sym)))
                own = np.repeat(over, size)
                done.append((sym[own], word[own]))
                sym, word, rank, low, size = sym[~own], word[~own], rank[~own], low[~over], size[~over]
                if not len(sym):
                    break
            else:
                size = np.diff(np.append(starts, len(sym)))
            at = np.flatnonzero(rank == np.repeat(low, size))
            run = np.append(True, at[1:] != at[:-1] + 1)
            if not run.all():  # places that overlap: every second one of a run, from its left
                first = np.flatnonzero(run)
                at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            took = rank[at]
            sym[at] = self.to[took]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = at - np.arange(len(at))
            for places in (at, at - 1):
                if places is at:
                    fits, least = places + 1 < len(sym), took
                else:
                    fits, least = places >= 0, took
                rank[places[~fits & (places >= 0)]] = self.NONE
                places, least = places[fits], least[fits]
                inside = word[places] == word[places + 1]
                rank[places[~inside]] = self.NONE
                places, least = places[inside], least[inside]
                r, several = self.look_up(sym[places], sym[places + 1])
                if self.replay:  # a pair made after its own merge is no longer merged
                    odd[word[places[several]]] = True
                    r = np.where(r > least, r, self.NONE)
                else:
                    odd[word[places[r < least]]] = True
                rank[places] = r
        sym, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        sym, count = sym[order], np.bincount(word, minlength=len(lengths))
        if not odd.any():
            return sym, count
        ends, old = np.cumsum(count), np.cumsum(lengths)
        parts = []
        at = 0
        for k in np.flatnonzero(odd).tolist():
            parts.append(sym[at:ends[k] - count[k]])
            parts.append(np.array(merge_word(flat[old[k] - lengths[k]:old[k]].tolist(), self.ranks, self.made, self.replay), np.int32))
            at = ends[k]
            count[k] = len(parts[-1])
        return np.concatenate([*parts, sym[at:]]), count


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where sorted values change."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


class Places:
    """The symbols of a phase's fragments in cells of one array, and where pairs lie.

    A symbol's id stands in its first and last cell, with the number of its cells; fragments are parted by cells of 0.
    So a merge writes two cells, and both neighbours are found from them; it is done for all places of a pair at
    once.  Only pairs above ``floor`` have their places listed; ``index`` lists them anew, over fewer cells."""

    CHUNK = 1 << 21

    def __init__(self, syms: np.ndarray, lengths: np.ndarray, weights: np.ndarray, most: int):
        self.kind = np.uint16 if most + 1 < 1 << 16 else np.int32
        lengths = np.asarray(lengths, np.int64)
        ends = np.cumsum(lengths + 1)
        self.sym = np.zeros(int(lengths.sum()) + len(lengths) + 1, self.kind)
        own = np.ones(len(self.sym), bool)
        own[0] = own[ends] = False
        self.sym[own] = syms
        self.sym[own] += 1
        self.weight, group = np.unique(weights, return_inverse=True)
        self.group = np.zeros(len(self.sym), np.uint16 if len(self.weight) < 1 << 16 else np.int32)
        self.group[1:] = np.repeat(group.astype(self.group.dtype), lengths + 1)
        self.wide = np.uint16 if lengths.max(initial=0) < 1 << 16 else np.int32
        self.cells = np.ones(len(self.sym), self.wide)
        self.start = np.ones(len(self.sym), bool)

    def pairs(self):
        """Pieces of the array: the places of pairs, their symbols, all sorted by pair and place."""
        for lo in range(0, len(self.sym) - 1, self.CHUNK):
            part = self.sym[lo:lo + self.CHUNK + 1]
            at = np.flatnonzero((part[:-1] > 0) & (part[1:] > 0))
            left, right = part[at], part[at + 1]
            order = np.argsort(right, kind="stable")  # of 16 bits: a radix sort
            order = order[np.argsort(left[order], kind="stable")]
            yield at[order] + lo, (left[order].astype(np.int64) << 32) | right[order]

    def index(self, reach: float, least: int) -> None:
        """Drop cells inside symbols, count all pairs, list the places of those above ``floor``."""
        if not self.start.all():
            self.sym, self.group = self.sym[self.start], self.group[self.start]
            self.cells, self.start = np.ones(len(self.sym), self.wide), np.ones(len(self.sym), bool)
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, pairs in self.pairs():
            if len(at):
                first = _firsts(pairs)
                total = np.add.reduceat(self.weight[self.group[at]], first)
                codes, where = np.unique(np.concatenate([codes, pairs[first]]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, total]), len(codes)).astype(np.int64)
        self.codes, self.base = codes, counts
        self.floor = max(int(counts.max(initial=0) / reach), least)
        listed = codes[counts > self.floor]
        self.counts: dict[int, int] = dict(zip(listed.tolist(), counts[counts > self.floor].tolist()))
        self.places: dict[int, list[np.ndarray]] = {c: [] for c in listed.tolist()}
        for at, pairs in self.pairs():
            first = _firsts(pairs)
            for c, lo, hi in zip(pairs[first].tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
                if c in self.places:
                    self.places[c].append(at[lo:hi].astype(np.int32))

    def count_all(self, codes: np.ndarray) -> list[int]:
        k = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        base = np.where(self.codes[k] == codes, self.base[k], 0)
        return [self.counts.get(c, n) for c, n in zip(codes.tolist(), base.tolist())]

    def count(self, code: int) -> int:
        c = self.counts.get(code)
        return self.count_all(np.array([code], np.int64))[0] if c is None else c

    def scan(self, code: int) -> np.ndarray:
        """All places of a pair whose list was not kept."""
        left, right = code >> 32, code & 0xFFFFFFFF
        at = np.flatnonzero((self.sym == left) & self.start)
        return at[self.sym[at + self.cells[at]] == right]

    def merge(self, left: int, right: int, made: int) -> list[int]:
        """Merge the pair (ids as in ``sym``) everywhere; the codes of the pairs that got new places."""
        code = (left << 32) | right
        lists = self.places.pop(code, None)
        i = self.scan(code) if lists is None else np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        if (i[1:] <= i[:-1]).any():
            i = np.unique(i)
        i = i[self.sym[i] == left]
        j = i + self.cells[i]
        ok = self.sym[j] == right
        i, j = i[ok], j[ok]
        if left == right and len(i):  # of overlapping places every second one, from the left
            first = np.flatnonzero(np.append(True, i[1:] != j[:-1]))
            ok = (np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))) % 2 == 0
            i, j = i[ok], j[ok]
        end = j + self.cells[j]
        before, after = self.sym[i - 1], self.sym[end]
        at = i - self.cells[i - 1]
        joined = np.append(False, end[:-1] == i[1:]) if len(i) else np.zeros(0, bool)
        w = self.weight[self.group[i]]
        size = end - i
        self.sym[j] = 0
        self.start[j] = False
        self.sym[i], self.sym[end - 1] = made, made
        self.cells[i] = self.cells[end - 1] = size
        follows = (after > 0) & ~np.append(joined[1:], False) if len(i) else np.zeros(0, bool)
        new = self.moved(before, w, at, left, made, True, before > 0, joined, np.append(0, i[:-1]))
        new += self.moved(after, w, i, right, made, False, follows)
        self.counts[code] = 0
        return new

    def moved(self, side, w, at, was, made, is_left, has, joined=None, earlier=None) -> list[int]:
        """Neighbours ``side`` of merged places have ``made`` beside them where ``was`` was; ``joined``: the neighbour was
        merged itself, its place is ``earlier``."""
        if not has.all():
            side, w, at = side[has], w[has], at[has]
            joined, earlier = (None, None) if joined is None else (joined[has], earlier[has])
        if not len(side):
            return []
        counts = self.counts

        def code(x, own):
            x = x.astype(np.int64)
            return (x << 32) | own if is_left else (own << 32) | x

        order = np.argsort(side, kind="stable")
        side, w, at = side[order], w[order], at[order]
        first = _firsts(side)
        lost = code(side[first], was)
        total = np.add.reduceat(w, first)
        for c, n, t in zip(lost.tolist(), self.count_all(lost), total.tolist()):
            counts[c] = n - t
        if joined is not None and joined.any():
            joined, earlier = joined[order], earlier[order]
            side, at = np.where(joined, made, side), np.where(joined, earlier, at)
            order = np.argsort(side, kind="stable")
            side, w, at = side[order], w[order], at[order]
            first = _firsts(side)
            total = np.add.reduceat(w, first)
        gained, at = code(side[first], made), at.astype(np.int32)
        new = gained.tolist()
        for c, n, t, lo, hi in zip(new, self.count_all(gained), total.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
            counts[c] = n + t
            if c in self.places:
                self.places[c].append(at[lo:hi])
            elif n <= 0 and t > self.floor:
                self.places[c] = [at[lo:hi].copy()]
        return new



def run_phase(fragments, taken: set[Pair], rest: int, names: list[str], ids: dict[str, int], limit: int,
              reach: float = 16.0) -> list[tuple[int, int, int]]:
    """Merges ``(left, right, count)`` that sequential BPE takes next, from fragments of the pairs ``taken``; any other
    pair has at most ``rest`` occurrences now.  ``names`` (the symbols' strings) and ``ids`` grow.  ``fragments``: pairs
    of a symbol list and a count, or arrays of symbols, lengths and counts.  ``reach``: down to which part of the
    highest count places are listed at once."""
    if isinstance(fragments, list):
        fragments = (np.array([x for f, _ in fragments for x in f], np.int32), np.array([len(f) for f, _ in fragments], np.int64),
                     np.array([c for _, c in fragments], np.int64))
    table = Places(*fragments, len(names) + limit)
    first_new = len(names)
    ends: dict[int, set[int]] = {}    # of symbols made here: what of the phase's start they can end and begin with
    begins: dict[int, set[int]] = {}
    by_symbol: dict[int, set[int]] = defaultdict(set)
    most_ends = most_begins = 1
    mask = 0xFFFFFFFF

    def hidden(code: int) -> int:
        """Occurrences that the cuts may hide, at most."""
        if not rest:
            return 0
        a, b = (code >> 32) - 1, (code & mask) - 1
        if a not in ends and b not in begins:
            return 0  # counted in full: both stood at the phase's start, and the pair is taken
        return rest * sum((u, v) not in taken for u in ends.get(a, (a,)) for v in begins.get(b, (b,)))

    def entry(code: int, count: int):
        return -count, names[(code >> 32) - 1], names[(code & mask) - 1], code

    out: list[tuple[int, int, int]] = []
    heap: list = []
    table.floor = -1
    while len(out) < limit:
        if not heap or -heap[0][0] <= table.floor:
            if -1 < table.floor <= rest:
                break
            table.index(reach, rest)
            known = {c: n for c, n in table.counts.items() if n > 0}
            if rest:
                for c, n in zip(table.codes.tolist(), table.base.tolist()):
                    by_symbol[c >> 32].add(c)
                    by_symbol[c & mask].add(c)
                    if c not in known and hidden(c):
                        known[c] = n
            heap = [entry(c, n + hidden(c)) for c, n in known.items()]
            heapq.heapify(heap)
            if not heap:
                break
            continue
        top, a, b, code = heapq.heappop(heap)
        count, unseen = table.count(code), hidden(code)
        if count <= 0:
            continue
        if -top != count + unseen:
            heapq.heappush(heap, (-count - unseen, a, b, code))
            continue
        if unseen or count <= rest * most_ends * most_begins:
            break
        left, right = (code >> 32) - 1, (code & mask) - 1
        made = ids.get(a + b)
        if made is None:
            made = ids[a + b] = len(names)
            names.append(a + b)
        again = made in ends or made < first_new
        if rest:
            for sets, part in ((ends, right), (begins, left)):
                sets.setdefault(made, set() if made >= first_new else {made}).update(sets.get(part, (part,)))
            most_ends, most_begins = max(most_ends, len(ends[made])), max(most_begins, len(begins[made]))
        out.append((left, right, count))
        changed = set(by_symbol[made + 1]) if rest and again else set()  # their hidden parts may have grown
        changed.update(table.merge(left + 1, right + 1, made + 1))
        for c in changed:
            if rest:
                by_symbol[c >> 32].add(c)
                by_symbol[c & mask].add(c)
            n = table.count(c)
            n += hidden(c)
            if n > table.floor:
                heapq.heappush(heap, entry(c, n))
    return out


# ---- the word table ----------------------------------------------------------------------

def _flat(column):
    """Symbols of all words of a batch in one array, with the words' ends."""
    return np.asarray(column.flatten(), dtype=np.int64), np.asarray(column.offsets, dtype=np.int64) - column.offsets[0].as_py()


def _pair_codes(column):
    """Code of the pair at every place (left << 32 | right) and whether the next symbol is of the same word."""
    flat, offsets = _flat(column)
    inside = np.ones(len(flat), bool)
    inside[offsets[1:][np.diff(offsets) > 0] - 1] = False
    codes = np.zeros(len(flat), np.int64)
    codes[:-1] = (flat[:-1] << 32) | flat[1:]
    return flat, offsets, codes, inside


def pair_counts(words: DataFrame) -> DataFrame:
    """``pair`` (left << 32 | right), ``c``."""

    def count(batches):
        import pyarrow as pa

        for b in batches:
            _, offsets, codes, inside = _pair_codes(b.column(0))
            weight = np.repeat(np.asarray(b.column(1)), np.diff(offsets))
            pairs, where = np.unique(codes[inside], return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, where, weight[inside])
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total)], names=["pair", "c"])

    return words.select("syms", "cnt").mapInArrow(count, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))


def fragment_counts(words: DataFrame, taken: np.ndarray | None, kind: str = "<i4") -> DataFrame:
    """``f`` (symbols as ``kind``), ``c``: words cut wherever a pair is not in ``taken`` (sorted codes; None: not cut)."""
    shared = words.sparkSession.sparkContext.broadcast(taken)

    def cut(batches):
        import pyarrow as pa

        own = shared.value
        for b in batches:
            flat, offsets, codes, inside = _pair_codes(b.column(0))
            joined = inside
            if own is not None:
                at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
                joined = inside & (own[at] == codes)
            ends = np.flatnonzero(~joined) + 1
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            weight = np.repeat(np.asarray(b.column(1)), np.diff(offsets))
            keep = ends - starts > 1
            data, size = flat.astype(kind).tobytes(), np.dtype(kind).itemsize
            sums: dict[bytes, int] = defaultdict(int)
            for s, e, w in zip((starts[keep] * size).tolist(), (ends[keep] * size).tolist(), weight[starts[keep]].tolist()):
                sums[data[s:e]] += w
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())],
                                             names=["f", "c"])

    return words.select("syms", "cnt").mapInArrow(cut, "f binary, c long").groupBy("f").agg(F.sum("c").alias("c"))


def _fragment_arrays(fragments: DataFrame, kind: str):
    """Symbols, lengths and counts of all fragments, on the driver."""
    parts = []
    for b in fragments.select("f", "c").toArrow().to_batches():
        f = b.column(0)
        wide = str(f.type).startswith("large")
        offsets = np.frombuffer(f.buffers()[1], np.int64 if wide else np.int32)[f.offset:f.offset + len(f) + 1]
        raw = np.frombuffer(f.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        parts.append((np.frombuffer(raw.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize, np.array(b.column(1))))
    return tuple(np.concatenate(x) for x in zip(*parts))


def apply_merges(words: DataFrame, merges: list[tuple[int, int, int]], ids: list[int]) -> DataFrame:
    """The word table after the merges (``ids``: the symbol each makes), without words of one symbol."""
    shared = words.sparkSession.sparkContext.broadcast(Merger(merges, ids, replay=True))

    def merge(batches):
        import pyarrow as pa

        for b in batches:
            flat, offsets = _flat(b.column(0))
            syms, lengths = shared.value.merge(flat, np.diff(offsets))
            left = lengths > 1
            syms, lengths = syms[np.repeat(left, lengths)], lengths[left]
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(syms)),
                                              b.column(1).filter(pa.array(left))], names=["syms", "cnt"])

    return words.select("syms", "cnt").mapInArrow(merge, "syms array<int>, cnt long")


def _first_tied(words: DataFrame, count: int, names: list[str]) -> tuple[int, int, int]:
    """The first pair by name of those with this count; the names are bounded by the vocabulary."""
    by_id = words.sparkSession.createDataFrame(list(enumerate(names)), "id long, name string")
    tied = pair_counts(words).where(F.col("c") == count).select(F.shiftright("pair", 32).alias("l"),
                                                                (F.col("pair") % (1 << 32)).alias("r"))
    tied = tied.join(F.broadcast(by_id.withColumnsRenamed({"id": "l", "name": "a"})), "l")
    tied = tied.join(F.broadcast(by_id.withColumnsRenamed({"id": "r", "name": "b"})), "r")
    x = tied.orderBy("a", "b").limit(1).collect()[0]
    return x["l"], x["r"], count


def train(words: DataFrame, n_merges: int, top_pairs: int = 50_000, max_fragments: int = 1_000_000,
          reach: float = 32.0) -> list[tuple[str, str, int]]:
    """Up to ``n_merges`` merges ``(left, right, count)``, symbols in hex.  ``words``: ``syms array<int>`` (bytes), ``cnt``.

    Words that fit are one phase, uncut.  Else a phase takes pairs down to the ``reach``-th part of the highest count, or to
    a larger part where their fragments are too many; the next phase starts from what went well."""
    from tracelake.operators.common import written

    names = [f"{b:02X}" for b in range(256)]
    ids = {s: i for i, s in enumerate(names)}
    kind = "<u2" if len(names) + n_merges < 1 << 16 else "<i4"
    merges: list[tuple[str, str, int]] = []
    words = written(words.where(F.size("syms") > 1), "bpe-words")

    def fits(df: DataFrame, size) -> bool:
        n, cells = df.agg(F.count(F.lit(1)), F.sum(size)).first()
        return n <= max_fragments and (cells or 0) <= 8 * max_fragments

    while len(merges) < n_merges:
        counts, rest, taken, fragments = np.zeros(1, np.int64), 0, set(), None
        if fits(words, F.size("syms")):
            fragments = fragment_counts(words, None, kind)
        else:
            top = pair_counts(words).orderBy(F.desc("c"), "pair").limit(top_pairs + 1).collect()
            if not top:
                break
            codes, counts = np.array([r["pair"] for r in top], np.int64), np.array([r["c"] for r in top], np.int64)
            floor = int(counts[-1]) if len(top) > top_pairs else 0  # what is not listed has at most this count
            least, first = max(int(counts[0] / reach), floor), True
            while (in_ := counts > least).any():
                found = written(fragment_counts(words, np.sort(codes[in_]), kind), "bpe-fragments")
                if fits(found, F.length("f") / np.dtype(kind).itemsize):
                    fragments = found
                    break
                reach, first = max(counts[0] / least, 1.0), False
                reach = reach / 2 if reach > 4 else reach ** 0.5
                least = max(int(counts[0] / reach), least + 1)
            if first:
                reach *= 2
            rest = int(counts[~in_].max(initial=0))
            taken = {(c >> 32, c & 0xFFFFFFFF) for c in codes[in_].tolist()} if rest else set()
        batch = []
        if fragments is not None:
            arrays = _fragment_arrays(fragments, kind)
            if not arrays:
                break
            batch = run_phase(arrays, taken, rest, names, ids, n_merges - len(merges))
        if not batch:
            if not rest:
                break
            batch = [_first_tied(words, int(counts[0]), names)]  # more ties than fit: the first of them by name is next
            left, right, _ = batch[0]
            if names[left] + names[right] not in ids:
                ids[names[left] + names[right]] = len(names)
                names.append(names[left] + names[right])
        merges += [(names[left], names[right], c) for left, right, c in batch]
        if len(merges) >= n_merges or not counts[0]:
            break
        made = [ids[names[left] + names[right]] for left, right, _ in batch]
        words = written(apply_merges(words, batch, made), "bpe-words")
    return merges
