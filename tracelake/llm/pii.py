"""Personal data in whole texts: exact base detectors, and bootstrapped contextual extraction beyond them.

1. Base spans: the four regular forms (e-mail, IPv4, card, phone), leftmost and without overlap in a kind.  They
   are the seeds.  Beside them each text gives its other identifier-like strings (with a digit or ``@``, not over a
   base span), each with the kinds that its shape allows, and two lexical patterns: the two words
   before it, and the words before and after it.
2. Patterns that hold at least ``min_seeds`` different seed values of a kind are the induced ones.  A second pass
   counts what else follows in them all over the corpus: a fixed bitmap of pattern hashes goes to the tasks, what
   passes it is joined exactly.
3. The graph of patterns and instances is scored in rounds: a pattern's confidence for a kind is the score of its
   instances of the kind by the number of its different followers plus one; an instance scores one minus
   the product of its patterns' doubts.  Only patterns of ``min_conf`` and of ``min_seeds`` instances count; an
   instance of ``accept`` or more takes part in the next round and is found wherever its shape fits,
   as is any seed value that the base forms passed over (say, two cards side by side).  A string whose shape fits no
   kind (a customer number in a place where others give their phone) needs one pattern of ``accept_loose``.

Values and patterns count once however often they are copied.  Patterns and instances stay in Spark
tables; nothing that grows with the corpus reaches the driver.

Base forms are matched without backtracking over long runs, so texts of any length take linear time.

Edge cases: a null text is an empty one; every row gives one row, equal rows and equal ids too, null ids stay null;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import materialise, small_batches

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str):
    """The local part is the run of its characters before an ``@``: none of them is an ``@``."""
    lo, at = 0, text.find("@")
    while at >= 0:
        start = lo + len(text[lo:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        lo = m.end() if m else at + 1
        at = text.find("@", lo)


def _ips(text: str):
    """Numbers in fours, from the left of each run of numbers parted by single dots."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        at, parts = run.start(), run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in four)):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start."""
    if not _MARK.search(text):
        return []
    out = [(EMAIL, s, e) for s, e in _emails(text)] + [(IP, s, e) for s, e in _ips(text)]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((PHONE, *m.span()))
    return out


# ---- identifier-like strings and their patterns ----------------------------------------

#: a word with a digit or an ``@``; tried at word starts only
_WORD = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_AT = re.compile(r"\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?([A-Za-z0-9-]+(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?)[A-Za-z0-9-]+)+)")
_NUMBER = re.compile(r"\+?\(?[0-9]+(?:[().\-/]+[0-9]+)*\)?")
_FOUR = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_COLONS = re.compile(r"(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}")
_LABEL = re.compile(r"[^\W\d_]+[=:]+")
_EDGE = ".,;:!?\"'`[]{}<>*#%$&=|~^_-/\\"
_M64 = (1 << 64) - 1
_K = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_START = 0x27D4EB2F165667C5  # the word before the first


def _code(word: str) -> int:
    """64-bit hash of a word without case, edge punctuation and the values of its digits."""
    w = re.sub("[0-9]", "0", word[-64:].lower().strip(_EDGE + "()") or word[-64:])
    return int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _patterns(text: str, start: int, end: int) -> tuple[int, int]:
    """Hashes of (two words before) and of (word before, word after), as signed integers."""
    before = [_code(w) for w in text[max(0, start - 200):start].split()[-2:]]
    w2, w1 = ([_START, _START] + before)[-2:]
    after = text[end:end + 100].split(None, 1)
    # what clings to the value itself (a comma, a quote) is no word
    after = [w for w in after[:2] if w.strip(_EDGE + "()")] if after else []
    w3 = _code(after[0].split()[0]) if after else _START
    both = (w2 * _K[0] + w1 * _K[1]) & _M64, (w1 * _K[0] + w3 * _K[2] + 1) & _M64
    return tuple(x - (1 << 64) if x >> 63 else x for x in both)


def _value(kind_shape: str) -> int:
    return int.from_bytes(hashlib.blake2b(kind_shape.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _normal(kind: int, s: str) -> str:
    return s.lower() if kind == EMAIL else s if kind == IP else _NOT_DIGIT.sub("", s)


#: the shape is that of no kind, but it may be an identifier
LOOSE = 1 << 4


def _mask(digits: int) -> int:
    return (1 << PHONE if 7 <= digits <= 15 else 0) | (1 << CARD if 13 <= digits <= 19 else 0)


def _loose(core: str) -> int:
    return LOOSE if len(core) <= 64 and sum(map(core.count, "0123456789")) >= 4 else 0


def _others(text: str, base: list) -> list[tuple[int, int, int, str]]:
    """``(start, end, mask of allowed kinds, normal form)`` of identifier-like strings that touch no base span."""
    taken = sorted((s, e) for _, s, e in base)
    found: list[tuple[int, int, int, str]] = []
    for m in _AT.finditer(text):
        local = text[max(0, m.start() - 64):m.start()]
        start = m.start() - (len(local) - len(local.rstrip(_LOCAL)))
        if start < m.start():
            found.append((start, m.end(), 1 << EMAIL, re.sub(r"\s|[\[({]|[\])}]", "", text[start:m.end()]).lower()))
            taken.append((start, m.end()))
    taken.sort()
    numbers: list[tuple[int, int, str]] = []

    def flush():
        digits = [_NOT_DIGIT.sub("", x[2]) for x in numbers]
        whole = "".join(digits)
        if numbers and _mask(len(whole)):
            found.append((numbers[0][0], numbers[-1][1], _mask(len(whole)), whole))
        else:
            found.extend((s, e, _mask(len(d)) or _loose(d), d) for (s, e, _), d in zip(numbers, digits))
        numbers.clear()

    i = 0
    for m in _WORD.finditer(text):
        s, e = m.span()
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        # the parts of the word that no span touches
        parts, j, at = [], i, s
        while j < len(taken) and taken[j][0] < e:
            if taken[j][0] > at:
                parts.append((at, taken[j][0]))
            at = max(at, taken[j][1])
            j += 1
        if at < e:
            parts.append((at, e))
        for s, e in parts:
            raw = text[s:e]
            label = _LABEL.match(raw)
            s += label.end() if label else 0
            raw = text[s:e]
            s += len(raw) - len(raw.lstrip(_EDGE))
            core = text[s:e].rstrip(_EDGE)
            while core and core[-1] == ")" and "(" not in core:
                core = core[:-1].rstrip(_EDGE)
            e = s + len(core)
            if not _MARK.search(core):
                continue
            if len(core) <= 64 and _NUMBER.fullmatch(core) and not _FOUR.fullmatch(core):
                if numbers and (text[numbers[-1][1]:s] != " " or core[0] == "+"):
                    flush()
                numbers.append((s, e, core))
                continue
            flush()
            if len(core) <= 64 and (_FOUR.fullmatch(core) or _COLONS.fullmatch(core.lower())):
                mask = 1 << IP
            else:
                mask = 1 << EMAIL if "@" in core[1:-1] and len(core) <= 254 else _loose(core)
            found.append((s, e, mask, core.lower()))
    flush()
    return found


_SPAN = "array<struct<k:int,s:long,e:long>>"
_SEEN = "array<struct<s:long,e:long,inst:long,seed:int,mask:int,c1:long,c2:long>>"


def _scan(docs: DataFrame) -> DataFrame:
    """``doc_id, base, seen, text_key``: the key is set where some string beyond the base spans may be personal data."""

    def scan(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))
        one = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("inst", pa.int64()), ("seed", pa.int32()),
                                  ("mask", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64())]))
        for b in batches:
            base, seen, keys = [], [], []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py() or ""
                own = base_spans(text)
                base.append([{"k": k, "s": s, "e": e} for k, s, e in own])
                if not _MARK.search(text):
                    seen.append([])
                    keys.append(None)
                    continue
                rows = [(s, e, _value(_normal(k, text[s:e])), k, 0) for k, s, e in own]
                other = _others(text, own)
                rows += [(s, e, _value(v), -1, mask) for s, e, mask, v in other]
                seen.append([dict(zip(("s", "e", "inst", "seed", "mask", "c1", "c2"), (*r, *_patterns(text, r[0], r[1])))) for r in rows])
                keys.append(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()
                            if any(x[2] for x in other) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(seen, one), pa.array(keys, pa.binary())],
                                             names=["doc_id", "base", "seen", "text_key"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(scan, f"doc_id long, base {_SPAN}, seen {_SEEN}, text_key binary")


_BITMAP_BITS = 24


def _followers(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """``ctx, inst``: the different plain words (no digit, no ``@``) met in the given patterns over all texts."""
    bit = F.shiftrightunsigned("ctx", 64 - _BITMAP_BITS)
    words = contexts.groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(ctx, {64 - _BITMAP_BITS}) & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (_BITMAP_BITS - 6), np.uint64)
    for r in words.collect():  # at most 2**18 rows, whatever the corpus
        bitmap[r["w"]] = r["bits"] & _M64
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def follow(batches):
        import pyarrow as pa

        bits = shared.value
        k = [np.uint64(x) for x in _K]

        class Codes(dict):
            def __missing__(self, w):
                self[w] = x = (0 if _MARK.search(w) else 1, _code(w))
                return x

        codes = Codes()
        for b in batches:
            pairs = []
            for i in range(b.num_rows):
                words = b.column(0)[i].as_py().split()
                if not words:
                    continue
                flat = np.array([codes[w] for w in words], np.uint64)
                plain, h = flat[:, 0] == 1, np.concatenate([[_START, _START], flat[:, 1], [_START]]).astype(np.uint64)
                w2, w1, w3, own = h[:-3], h[1:-2], h[3:], h[2:-1]
                for c in (w2 * k[0] + w1 * k[1], w1 * k[0] + w3 * k[2] + np.uint64(1)):
                    at = c >> np.uint64(64 - _BITMAP_BITS)
                    hit = plain & ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1)
                    if hit.any():
                        pairs.append(np.stack([c[hit], own[hit]], 1))
                if len(codes) > 200_000:
                    codes.clear()
            if pairs:
                found = np.unique(np.concatenate(pairs), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["ctx", "inst"])

    found = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(follow, "ctx long, inst long").distinct()
    return found.join(contexts, "ctx", "left_semi")


def _fits():
    return (F.expr("shiftright(mask, kind) & 1") == 1) | (F.col("mask") == LOOSE)


def instances(docs: DataFrame, scanned: DataFrame, min_seeds: int, min_conf: float, accept: float, accept_loose: float,
              rounds: int) -> DataFrame:
    """``inst, kind, score``: the seeds (score 1) and what the graph of patterns and instances accepts."""
    occ = scanned.where(F.size("seen") > 0).select(F.explode("seen").alias("x")).select("x.*")
    edges = occ.select(F.explode(F.array("c1", "c2")).alias("ctx"), "inst", "seed", "mask").distinct()
    edges = materialise(edges, "pii-edges")
    seeds = edges.where("seed >= 0").select("inst", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    seeds = materialise(seeds, "pii-seeds")
    contexts = edges.where("seed >= 0").select("ctx", "seed", "inst").distinct().groupBy("ctx", "seed").agg(F.count(F.lit(1)).alias("n"))
    contexts = materialise(contexts.where(F.col("n") >= min_seeds).select("ctx").distinct(), "pii-contexts")
    if contexts.isEmpty():
        return seeds
    graph = materialise(edges.join(contexts, "ctx", "left_semi"), "pii-graph")
    met = graph.select("ctx", "inst").unionByName(_followers(docs, contexts)).distinct()
    sizes = materialise(met.groupBy("ctx").agg(F.count(F.lit(1)).alias("n")), "pii-sizes")
    links = graph.select("ctx", "inst").distinct()
    open_ = graph.where("seed < 0 and mask > 0").select("ctx", "inst", "mask").distinct()
    scores, known = seeds, None
    for _ in range(rounds):
        p = links.join(scores, "inst").groupBy("ctx", "kind").agg(F.sum("score").alias("f"), F.count(F.lit(1)).alias("m"))
        p = p.join(sizes, "ctx").select("ctx", "kind", "m", (F.col("f") / (F.col("n") + 1)).alias("conf"))
        p = p.where((F.col("conf") >= min_conf) & (F.col("m") >= min_seeds))
        doubt = F.sum(F.log(1 - F.col("conf")))
        new = open_.join(p, "ctx").where(_fits()).groupBy("inst", "kind").agg(
            (1 - F.exp(doubt)).alias("score"), F.max("conf").alias("best"), F.min("mask").alias("mask"))
        enough = F.when(F.col("mask") == LOOSE, F.col("best") >= accept_loose).otherwise(F.col("score") >= accept)
        new = materialise(new.where(enough).join(seeds, ["inst", "kind"], "left_anti"), "pii-scores")
        scores = seeds.unionByName(new.select("inst", "kind", "score"))
        now = new.count()
        if now == known:
            break
        known = now
    return scores


def find(docs: DataFrame, min_seeds: int = 2, min_conf: float = 0.5, accept: float = 0.5, accept_loose: float = 0.75,
         rounds: int = 4) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone`` and ``base_sha256`` of the base spans,
    ``spans`` with the added ones, ``n_added``.  A span is ``kind:start:end`` in code points."""
    small_batches(docs.sparkSession)
    scanned = materialise(_scan(docs), "pii-scan")
    accepted = instances(docs, scanned, min_seeds, min_conf, accept, accept_loose, rounds)
    loose = F.filter("seen", lambda x: (x["seed"] < 0) & (x["mask"] > 0))
    texts = scanned.where(F.col("text_key").isNotNull()).select("text_key", loose.alias("seen"))
    occ = texts.select("text_key", F.explode("seen").alias("x")).select("text_key", "x.s", "x.e", "x.inst", "x.mask").distinct()
    hits = occ.join(accepted, "inst").where(_fits())
    best = F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")
    hits = hits.groupBy("text_key", "s", "e").agg(best).select("text_key", F.struct((-F.col("b.k")).alias("k"), "s", "e").alias("x"))
    added = materialise(hits.groupBy("text_key").agg(F.collect_list("x").alias("added")), "pii-added")
    none = F.lit(None).cast(_SPAN)
    rows = scanned.select("doc_id", "base", "text_key")
    out = rows.where(F.col("text_key").isNull()).withColumn("added", none).unionByName(
        rows.where(F.col("text_key").isNotNull()).join(added, "text_key", "left"))
    out = out.withColumn("added", F.coalesce("added", F.array().cast(_SPAN)))
    names = F.array(*map(F.lit, KINDS))

    def spelled(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", names[x["k"]], x["s"], x["e"])), ",")

    def number(i):
        return F.size(F.filter("base", lambda x: x["k"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    return out.select("doc_id", *map(number, range(4)), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
                      spelled(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
