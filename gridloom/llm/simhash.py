"""SimHash near-dedup: Golay-code fuzzy hashing of fingerprint segments, join and verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, materialize, texts_of
from gridloom.llm.components import components

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width: 64 bits, each at most a Golay word of 23
GENERATOR = 0xC75  # of the (23, 12) code
_golay: dict = {}


def shingles_of(raw: bytes, width: int = 3) -> list[bytes]:
    words = raw.lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[k:] for k in range(width)), strict=False)]


def fingerprints(raws: list[bytes], width: int = 3) -> np.ndarray:
    """64-bit fingerprint of each text: bits that over half the shingle hashes set; zero without words."""
    out, counts = np.zeros(len(raws), np.uint64), []
    hashes: list[np.ndarray] = []
    at: list[int] = []

    def flush() -> None:
        if at:
            h = np.concatenate(hashes)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            n = np.array(counts)
            sums = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
            over = (2 * sums > n[:, None]).astype(np.uint8)
            out[at] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
            hashes.clear()
            at.clear()
            counts.clear()

    held = 0
    for i, raw in enumerate(raws):
        s = shingles_of(raw, width)
        if s:
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(SEED)), np.uint64, len(s)))
            at.append(i)
            counts.append(len(s))
            held += len(s)
        if held > 200_000:
            flush()
            held = 0
    flush()
    return out


def _syndromes(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    v = v.astype(np.int64)
    for bit in range(22, 10, -1):
        v = np.where(v >> bit & 1, v ^ (GENERATOR << (bit - 11)), v)
    return v


def codeword_index(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one Golay codeword within three bits of each 23-bit word."""
    if not _golay:
        errors = [0, *(sum(1 << b for b in c) for w in (1, 2, 3) for c in combinations(range(23), w))]
        leader = np.zeros(2048, np.int64)
        leader[_syndromes(np.array(errors))] = errors
        unit = _syndromes(1 << np.arange(23))
        low, high = np.zeros(4096, np.int64), np.zeros(2048, np.int64)
        for t, first, bits in ((low, 0, 12), (high, 12, 11)):
            for b in range(bits):
                t ^= np.where(np.arange(len(t)) >> b & 1, unit[first + b], 0)
        _golay.update(leader=leader, low=low, high=high)
    v = v.astype(np.int64)
    return (v ^ _golay["leader"][_golay["low"][v & 4095] ^ _golay["high"][v >> 12]]) >> 11


def segment_keys(fps: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own codeword index of a segment of each fingerprint; and rows, indices: the distinct indices of the segment
    and of all words one bit from it. Two segments one bit apart: each one's own index is among the other's all."""
    seg = (fps >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
    own = codeword_index(seg)
    every = np.concatenate([own[:, None], codeword_index(seg[:, None] ^ (1 << np.arange(width))[None, :])], axis=1)
    every.sort(axis=1)
    new = np.concatenate([np.ones((len(every), 1), bool), np.diff(every, axis=1) != 0], axis=1)
    rows, cols = np.nonzero(new)
    return own, rows, every[rows, cols]


def keyed(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, side, fingerprint): of three segments with three errors in all, two have at most one each. For every pair
    of segments, side 0 has all indices of the one with the own index of the other, side 1 the reverse."""
    made = [segment_keys(fps, *s) for s in SEGMENTS]
    keys, sides, out = [], [], []
    for p, (i, j) in enumerate(combinations(range(3), 2)):
        (own_i, row_i, all_i), (own_j, row_j, all_j) = made[i], made[j]
        keys += [p << 24 | all_i << 12 | own_j[row_i], p << 24 | own_i[row_j] << 12 | all_j]
        sides += [np.zeros(len(row_i), np.uint8), np.ones(len(row_j), np.uint8)]
        out += [fps[row_i], fps[row_j]]
    return np.concatenate(keys), np.concatenate(sides), np.concatenate(out)


def _roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """parent after the links a-b; trees of depth one, each under its smallest member."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := parent[parent]).tolist() != parent.tolist() if n < 64 else not np.array_equal(up := parent[parent], parent):
            parent = up


def linked(left: np.ndarray, right: np.ndarray, lo: np.ndarray, hi: np.ndarray, nodes: np.ndarray, most: int, step: int = 1_000_000) -> np.ndarray:
    """Edges (fingerprint, smallest one of its tree) of a forest that spans all links of at most `most` bits between
    left[k] and right[lo[k]:hi[k]]. nodes: all fingerprints, sorted."""
    parent = np.arange(len(nodes))
    li, ri = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    n = hi - lo
    total = np.cumsum(n)
    k = 0
    while k < len(n):
        e = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + step)))
        m = n[k:e]
        l_ = np.repeat(np.arange(k, e), m)
        r = np.repeat(lo[k:e] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        near = np.bitwise_count(left[l_] ^ right[r]) <= most
        parent = _roots(len(nodes), li[l_[near]], ri[r[near]], parent)
        k = e
    under = np.flatnonzero(parent != np.arange(len(nodes)))
    return np.stack([nodes[under], nodes[parent[under]]], axis=1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view("<i8")


def links(fps: DataFrame, most: int = 3, crowd: int = 4096) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp, as signed 64-bit) that connect whatever links of at
    most `most` <= 3 bits connect. Inside a bucket a spanning forest stands for the links.

    Keys go to buckets as packed blobs, one per bucket and task. A key that over `crowd` fingerprints share on both
    sides is cut into cells of crowd x crowd, dealt out anew: no task gets a crowd whole, and no pair is left out."""
    n = 4 * int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for a in range(0, len(own), 20_000):
                key, side, fp = keyed(own[a : a + 20_000])
                bucket = (key * 0x9E3779B1 >> 7) % n
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                parts = np.split(order, cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([key[p].astype("<i4").tobytes() + side[p].tobytes() + fp[p].tobytes() for p in parts], pa.binary())], names=["bucket", "blob"]
                )

    def match(t: pa.Table) -> pa.Table:
        keys, sides, values = [], [], []
        for blob in t.column("blob").to_pylist():
            m = len(blob) // 13
            keys.append(np.frombuffer(blob, "<i4", m))
            sides.append(np.frombuffer(blob, np.uint8, m, 4 * m))
            values.append(np.frombuffer(blob, "<u8", m, 5 * m))
        key, side, fp = np.concatenate(keys), np.concatenate(sides), np.concatenate(values)
        lk, lf, rk, rf = key[side == 0], fp[side == 0], key[side == 1], fp[side == 1]
        order = np.argsort(rk, kind="stable")
        rk, rf = rk[order], rf[order]
        lo, hi = np.searchsorted(rk, lk, side="left"), np.searchsorted(rk, lk, side="right")
        busy = hi > lo
        lk, lf, lo, hi = lk[busy], lf[busy], lo[busy], hi[busy]
        crowded = hi - lo > crowd
        edges = linked(lf[~crowded], rf, lo[~crowded], hi[~crowded], np.unique(np.concatenate([lf, rf])), most) if len(lf) else np.zeros((0, 2), np.uint64)
        cells = []
        for k in np.unique(lk[crowded]).tolist():
            left, right = lf[crowded & (lk == k)], rf[np.searchsorted(rk, k, side="left") : np.searchsorted(rk, k, side="right")]
            for i in range(0, len(left), crowd):
                cells += [(left[i : i + crowd].tobytes(), right[j : j + crowd].tobytes()) for j in range(0, len(right), crowd)]
        e, c = len(edges), len(cells)
        return pa.table({"a": pa.array([*_signed(edges[:, 0]).tolist(), *[None] * c], pa.int64()), "b": pa.array([*_signed(edges[:, 1]).tolist(), *[None] * c], pa.int64()), "left": pa.array([None] * e + [x[0] for x in cells], pa.binary()), "right": pa.array([None] * e + [x[1] for x in cells], pa.binary())})

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left, right = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                edges = linked(left, right, np.zeros(len(left), np.int64), np.full(len(left), len(right)), np.unique(np.concatenate([left, right])), most)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(edges[:, 0])), pa.array(_signed(edges[:, 1]))], names=["a", "b"])

    first = materialize(fps.select("fp").mapInArrow(send, "bucket int, blob binary").groupBy("bucket").applyInArrow(match, "a long, b long, left binary, right binary"), "simhash-match")
    more = first.where("left is not null").select("left", "right").repartition(n).mapInArrow(cell, "a long, b long")
    return first.where("a is not null").select("a", "b").union(more)


def near_groups(docs: DataFrame, most: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, fp (signed 64-bit) and component_id, the smallest doc_id that links of at
    most `most` (0 to 3) differing bits reach.

    Texts without words (null ones too) have fingerprint zero and are linked like any other. Equal fingerprints are
    one node, so copies cost no pairs. Repeated rows give repeated results; null ids stay null and are never a
    component's id unless it has no other; other columns are ignored; whole texts count."""
    if not 0 <= most <= 3:
        raise ValueError("the codes find links of at most 3 bits")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(fingerprints(as_bytes(batch.column(1)), width)), pa.int64())], names=["doc_id", "fp"])

    own = materialize(texts_of(docs, id_col, text_col).mapInArrow(scan, "doc_id long, fp long"), "simhash-prints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes, most), "simhash-stars")
    rooted = materialize(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, most: int = 3, width: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest; columns unchanged. Rows that share a doc_id are one
    document, and stay or go together; rows without an id stay only where their group has no id at all."""
    found = near_groups(docs, most, width)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["_keep"]), "left_semi")
