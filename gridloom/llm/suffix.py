"""Suffix-array dedup: suffixes ordered through a depth limit by most-significant-digit passes, over bytes.

A digit is half the depth: 50 bytes named by a 64-bit fingerprint. The first pass looks at sampled suffixes only (of
every run of consecutive positions that one full-depth string spans, those with the smallest first digit): two equal
strings have the same samples, so a sample whose digit occurs once proves that no string around it is repeated. The
surviving samples are told apart by the digits on either side; what that leaves open goes through both digits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import rounds as R
from gridloom.llm.common import slices, texts_of

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2^64
_powers: dict = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Smallest (or largest) of every `width` consecutive values."""
    f, done = (np.minimum if least else np.maximum), 1
    while 2 * done <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


class _Part:
    """Digits of some documents laid one after the other."""

    def __init__(self, raws: list[bytes], depth: int) -> None:
        self.half, self.depth = depth // 2, depth
        n = np.array([len(r) for r in raws], dtype=np.int64)
        self.start = np.cumsum(n) - n
        x = np.frombuffer(b"".join(raws), dtype=np.uint8)
        self.size = len(x)
        up, self.down = _power(self.size + 1)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(_BYTE[x] * up[:-1], out=self.sums[1:])
        self.owner_n, self.n = n, n
        k = max(0, self.size - self.half + 1)
        self.h = R.mix((self.sums[self.half : self.half + k] - self.sums[:k]) * self.down[:k]) if k else np.zeros(0, np.uint64)

    def digest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A fingerprint of the bytes [a, b) and their number."""
        return R.mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, side="right") - 1

    def samples(self) -> np.ndarray:
        """Positions whose digit is the smallest of a full-depth string's."""
        d, half = self.depth, self.half
        if self.size < d:
            return np.zeros(0, np.int64)
        width = d - half + 1
        low = _sliding(self.h, width, True)  # of the string that starts here
        ends = self.start + self.n
        for e in ends[:-1].tolist():  # strings that would run over the end of their document
            low[max(0, e - d + 1) : e] = 0
        short = np.flatnonzero(self.n < d)
        for s, e in zip(self.start[short].tolist(), ends[short].tolist(), strict=True):
            low[s:e] = 0
        high = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]), width, False)
        return np.flatnonzero((high == self.h) & (high > 0))


def _parts(ids: list, raws: list[bytes], depth: int, most: int = 500_000):
    for a, b in slices([len(r) for r in raws], most):
        yield a, b, _Part(raws[a:b], depth)


def _samples(ids: list, raws: list[bytes], depth: int, keep_parts: bool = False) -> dict:
    """All samples of a chunk: h, context, number of the document in the chunk, position in it."""
    got: dict = {"h": [], "ctx": [], "k": [], "pos": [], "n": []}
    for a, _, p in _parts(ids, raws, depth):
        at = p.samples()
        k = p.owner(at)
        left, right = np.maximum(p.start[k], at - p.half), np.minimum(p.start[k] + p.n[k], at + p.depth)
        got["h"].append(p.h[at])
        got["ctx"].append(R.mix(p.digest(left, at) * np.uint64(5) + p.digest(at + p.half, right)))
        got["k"].append(k + a)
        got["pos"].append(at - p.start[k])
        got["n"].append(p.n[k])
    return {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k in ("h", "ctx") else np.int64) for k, v in got.items()}


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges [lo, hi)."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def dedup_bytes(docs: DataFrame, depth: int = 100, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4_000_000) -> DataFrame:
    """One row for each document: doc_id, n_bytes, removed (maximal removed byte ranges) and kept (bytes left).

    A byte goes if a string of `depth` bytes (even) over it starts earlier too: in a smaller doc_id, or before it in
    the same one; matches never cross documents. Rows with the same doc_id at the same start count as one place
    (neither precedes); null ids come last and equal; null texts are empty; whole texts are read, whatever their
    length or period; other columns are ignored."""
    if depth < 4 or depth % 2:
        raise ValueError("depth must be even and 4 or more")
    half = depth // 2
    texts = texts_of(docs, id_col, text_col)
    n = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = R.chunks_of(texts, chunk_bytes)

    def names(ids: list) -> np.ndarray:
        return np.array([R.NO_ID if i is None else i for i in ids], dtype=np.int64)

    def grouped(x: dict):
        """Distinct digits, each sample's one, flags (1: two contexts here, 2: twice here) and a mark of the context."""
        keys, inverse, count = np.unique(x["h"], return_inverse=True, return_counts=True)
        mark = x["ctx"]
        low, high = np.full(len(keys), 2**64 - 1, np.uint64), np.zeros(len(keys), np.uint64)
        np.minimum.at(low, inverse, mark)
        np.maximum.at(high, inverse, mark)
        return keys, inverse, ((low != high) | (count > 1) * np.uint8(2)).astype(np.uint8), low

    def first_pass(chunk, ids, raws, replies):
        keys, _, flags, mark = grouped(_samples(ids, raws, depth))
        yield from R.send_seen(chunk, keys, flags, mark, n)

    def classes(ids, raws, replies):
        """Samples whose digit is repeated, with the key of their digit and context and each key's first one here."""
        x = _samples(ids, raws, depth)
        keys, inverse, _, _ = grouped(x)
        seen = R.read_seen(keys, R.bits_of(replies, 1), n)[inverse]
        x = {k: v[seen[:, 0]] for k, v in x.items()} | {"open": seen[seen[:, 0], 1]}
        k1, k2 = R.pair_keys(x["h"], x["ctx"])
        doc = names(ids)[x["k"]]
        return x, k1, k2, doc, *R.firsts(k1, k2, doc, x["pos"])

    def second_pass(chunk, ids, raws, replies):
        x, k1, k2, doc, first, _ = classes(ids, raws, replies)
        yield from R.send_first(chunk, k1[first], k2[first], doc[first], x["pos"][first], n)

    def settled(ids, raws, replies):
        """Samples, whether each is the first of its class anywhere, and the strings that are still open."""
        x, k1, k2, doc, first, at = classes(ids, raws, replies)
        mine = R.read_first(k1[first], R.bits_of(replies, 2), n)
        x["lead"] = at & mine[_group(k1, k2)] if len(k1) else at
        pick = x["lead"] & x["open"]
        k, pos, size = x["k"][pick], x["pos"][pick], x["n"][pick]
        lo, hi = np.maximum(0, pos - half), np.minimum(pos, size - depth) + 1
        wide = np.array([len(r) for r in raws], dtype=np.int64)
        base = np.cumsum(wide) - wide
        open_ = np.unique(_ranges(base[k] + lo, base[k] + hi))
        return x, open_, base

    def strings(raws, open_, base, ids):
        """Keys and places of the open strings (given by their place in the chunk), from both their digits."""
        k1s, k2s = [], []
        for a, b, p in _parts(ids, raws, depth):
            s = open_[np.searchsorted(open_, base[a]) : np.searchsorted(open_, base[a] + p.size)] - base[a]
            k1, k2 = R.pair_keys(p.h[s], p.h[s + half])
            k1s.append(k1)
            k2s.append(k2)
        k = np.searchsorted(base, open_, side="right") - 1
        none = [np.zeros(0, np.uint64)]
        return np.concatenate(k1s or none), np.concatenate(k2s or none), names(ids)[k] if len(ids) else k, open_ - base[k] if len(base) else open_

    def third_pass(chunk, ids, raws, replies):
        _, open_, base = settled(ids, raws, replies)
        k1, k2, doc, pos = strings(raws, open_, base, ids)
        first, _ = R.firsts(k1, k2, doc, pos)
        yield from R.send_first(chunk, k1[first], k2[first], doc[first], pos[first], n)

    def cut(chunk, ids, raws, replies):
        x, open_, base = settled(ids, raws, replies)
        k1, k2, doc, pos = strings(raws, open_, base, ids)
        first, at = R.firsts(k1, k2, doc, pos)
        mine = R.read_first(k1[first], R.bits_of(replies, 3), n)
        gone = open_[~(at & mine[_group(k1, k2)])] if len(k1) else open_
        cover = np.zeros(sum(map(len, raws)) + 1, np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + depth, -1)
        late = ~x["lead"]
        k, p, size = x["k"][late], x["pos"][late], x["n"][late]
        np.add.at(cover, base[k] + np.maximum(0, p - half), 1)
        np.add.at(cover, base[k] + np.minimum(p + depth, size), -1)
        removed = np.cumsum(cover[:-1], dtype=np.int32) > 0
        yield from _kept(ids, raws, base, removed)

    one = R.seen_round(R.per_chunk(R.with_replies(chunks, []), first_pass, R.SENT), 1, "suffix-1")
    two = R.first_round(R.per_chunk(R.with_replies(chunks, [one]), second_pass, R.SENT), 2, "suffix-2")
    three = R.first_round(R.per_chunk(R.with_replies(chunks, [one, two]), third_pass, R.SENT), 3, "suffix-3")
    return R.per_chunk(R.with_replies(chunks, [one, two, three]), cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def _group(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """For each key its number among the distinct keys in ascending order."""
    order = np.lexsort((k2, k1))
    out = np.empty(len(k1), np.int64)
    if len(order):
        out[order] = np.cumsum(np.concatenate([[True], (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])])) - 1
    return out


def _kept(ids: list, raws: list[bytes], base: np.ndarray, removed: np.ndarray) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for a, b in slices([len(r) for r in raws], 1_000_000):
        spans, kept = [], []
        for i in range(a, b):
            own = removed[base[i] : base[i] + len(raws[i])]
            if own.any():
                edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                kept.append(np.frombuffer(raws[i], np.uint8)[~own].tobytes())
            else:
                spans.append([])
                kept.append(raws[i])
        yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array([len(r) for r in raws[a:b]], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])


def digest(cut: DataFrame, text: str, size: str) -> DataFrame:
    """Counts and the hash of what is kept, for byte and word dedup alike."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    more = [F.size("removed").cast("long").alias("n_spans")] if text == "bytes" else []
    return cut.select("doc_id", size, removed.alias("n_removed"), *more, F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], depth: int = 100) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row, by definition; for tests."""
    seen: dict = {}
    at_of = lambda i, s: (R.NO_ID if i is None else i, s)
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for s in range(len(raw) - depth + 1):
            w = raw[s : s + depth]
            seen[w] = min(seen.get(w, at_of(i, s)), at_of(i, s))
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - depth + 1):
            if seen[raw[s : s + depth]] < at_of(i, s):
                gone[s : s + depth] = True
        kept = bytes(b for b, g in zip(raw, gone[:-1].tolist(), strict=True) if not g)
        out.append((i, len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out
