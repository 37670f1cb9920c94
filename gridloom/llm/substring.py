"""Substring dedup by fixed-block anchors over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from gridloom.llm import rounds as R
from gridloom.llm.common import slices, texts_of


class _Names(dict):
    """64-bit names of words; the first 150,000 words met are remembered (frequent ones are met early)."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 1)
        if len(self) < 150_000:
            self[word] = h
        return h


_names = _Names()


class _Chunk:
    """Rolling blocks of all documents of a chunk, laid one after the other."""

    def __init__(self, ids: list, raws: list[bytes], block: int) -> None:
        each = [np.fromiter(map(_names.__getitem__, w), np.uint64, len(w)) for w in map(bytes.split, raws)]
        self.count = np.array([len(x) for x in each], dtype=np.int64)
        self.doc = np.array([R.NO_ID if i is None else i for i in ids], dtype=np.int64)
        self.names = names = np.concatenate(each)
        del each
        self.start = np.cumsum(self.count) - self.count
        self.pos = np.arange(len(names)) - np.repeat(self.start, self.count)
        self.left = np.repeat(self.count, self.count) - self.pos  # words from here to the end of the document
        h = np.zeros(max(0, len(names) - block + 1), np.uint64)
        for k in range(block):
            h = h * np.uint64(0x9E3779B97F4A7C15) + names[k : k + len(h)]
        h = R.mix(h)
        self.at = np.flatnonzero(self.left[: len(h)] >= block)
        self.h = np.zeros(len(names), np.uint64)
        self.h[: len(h)] = h
        self.owner = np.repeat(np.arange(len(ids)), self.count)

    def blocks(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct rolling blocks, the index of each position's one, and flags: 1 a reference block (it starts at a
        multiple of its length), 2 twice or more here."""
        keys, inverse, n = np.unique(self.h[self.at], return_inverse=True, return_counts=True)
        flags = np.where(n > 1, 2, 0).astype(np.uint8)
        flags[inverse[self.pos[self.at] % block == 0]] |= 1
        return keys, inverse, flags

    def candidates(self, keys: np.ndarray, inverse: np.ndarray, seen: np.ndarray, window: int, block: int) -> np.ndarray:
        """Starts of windows whose every rolling block occurs twice and one of which is a reference block."""
        twice, anchor = np.zeros(len(self.h) + 1, np.int64), np.zeros(len(self.h) + 1, np.int64)
        twice[self.at + 1], anchor[self.at + 1] = seen[inverse, 0], seen[inverse].all(axis=1)
        twice, anchor = np.cumsum(twice), np.cumsum(anchor)
        s = np.flatnonzero(self.left >= window)
        span = window - block + 1
        return s[(twice[s + span] - twice[s] == span) & (anchor[s + span] - anchor[s] > 0)]


def _windows(c: _Chunk, s: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and places of the windows that start at s: 64 bits of the two blocks at a window's ends and those between,
    and 32 bits of all its words by another polynomial, so that a shared block lends nothing to a second clash."""
    a = c.h[s]
    for k in range(block, window - block, block):
        a = R.mix(a * np.uint64(3) + c.h[s + k])
    k1, _ = R.pair_keys(a, c.h[s + window - block])
    k2 = np.zeros(len(s), np.uint64)
    for k in range(window):
        k2 = k2 * np.uint64(0xD1342543DE82EF95) + c.names[s + k]
    return k1, R.mix(k2) >> np.uint64(32), c.doc[c.owner[s]], c.pos[s]


def dedup_words(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 2_500_000) -> DataFrame:
    """One row for each document: doc_id, n_words, removed (maximal removed word ranges) and kept (words left, joined
    by one space).

    A word goes if a window of `window` words over it starts earlier too: in a smaller doc_id, or before it in the same
    one. Reference blocks of half a window stand side by side in every document; every rolling block probes them;
    windows whose blocks all occur twice, one of them a reference block, are the repeats that a hit extends to, and
    their first occurrences decide exactly. Rows with the same doc_id at the same start count as one place (neither
    precedes); null ids come last and equal; null or empty texts have no words; other columns are ignored; whole texts
    are read."""
    block = max(1, window // 2)
    texts = texts_of(docs, id_col, text_col)
    n = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = R.chunks_of(texts, chunk_bytes)

    def probe(chunk, ids, raws, replies):
        c = _Chunk(ids, raws, block)
        keys, _, flags = c.blocks(block)
        yield from R.send_seen(chunk, keys, flags, None, n)

    def found(c: _Chunk, replies):
        keys, inverse, _ = c.blocks(block)
        s = c.candidates(keys, inverse, R.read_seen(keys, R.bits_of(replies, 1), n), window, block)
        k1, k2, doc, pos = _windows(c, s, window, block)
        return s, k1, k2, doc, pos, *R.firsts(k1, k2, doc, pos)

    def extend(chunk, ids, raws, replies):
        _, k1, k2, doc, pos, first, _ = found(_Chunk(ids, raws, block), replies)
        yield from R.send_first(chunk, k1[first], k2[first], doc[first], pos[first], n)

    def cut(chunk, ids, raws, replies):
        c = _Chunk(ids, raws, block)
        s, k1, k2, doc, pos, first, at = found(c, replies)
        mine = R.read_first(k1[first], R.bits_of(replies, 2), n)
        order = np.lexsort((k2, k1))
        group = np.empty(len(k1), np.int64)
        if len(order):
            group[order] = np.cumsum(np.concatenate([[True], (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])])) - 1
        gone = s[~(at & mine[group])] if len(s) else s
        cover = np.zeros(len(c.h) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
        removed = np.cumsum(cover[:-1]) > 0
        yield from _kept(c, ids, raws, removed)

    asked = R.seen_round(R.per_chunk(R.with_replies(chunks, []), probe, R.SENT), 1, "substring-blocks")
    told = R.first_round(R.per_chunk(R.with_replies(chunks, [asked]), extend, R.SENT), 2, "substring-windows")
    return R.per_chunk(R.with_replies(chunks, [asked, told]), cut, "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string")


def _kept(c: _Chunk, ids: list, raws: list[bytes], removed: np.ndarray) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for a, b in slices([len(r) for r in raws], 1_000_000):
        spans, kept = [], []
        for i in range(a, b):
            own = removed[c.start[i] : c.start[i] + c.count[i]]
            if own.any():
                edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                words = raws[i].split()
                kept.append(b" ".join(words[k] for k in np.flatnonzero(~own).tolist()))
            else:
                spans.append([])
                kept.append(b" ".join(raws[i].split()))
        yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(c.count[a:b], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "removed", "kept"])


def brute_force(rows: list[tuple], window: int = 20) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) of each row, by definition; for tests."""
    seen: dict = {}
    words = {k: (t or "").encode().split() for k, (_, t) in enumerate(rows)}
    for k, (i, _) in enumerate(rows):
        for s in range(len(words[k]) - window + 1):
            w, at = tuple(words[k][s : s + window]), (R.NO_ID if i is None else i, s)
            seen[w] = min(seen.get(w, at), at)
    out = []
    for k, (i, _) in enumerate(rows):
        gone = set()
        for s in range(len(words[k]) - window + 1):
            if seen[tuple(words[k][s : s + window])] < (R.NO_ID if i is None else i, s):
                gone.update(range(s, s + window))
        kept = b" ".join(w for j, w in enumerate(words[k]) if j not in gone)
        out.append((i, len(words[k]), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
