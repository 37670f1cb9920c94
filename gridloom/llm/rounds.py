"""Question rounds over chunks of documents: which keys occur elsewhere, and which occurrence of a key comes first.

Documents are gathered into chunk rows. In a round every chunk sends its distinct keys to the buckets that own them,
one blob for each pair of chunk and bucket; a bucket answers each chunk with bits in the order of the keys it was
sent. A chunk makes the same keys again in the next pass and so reads the bits without locations having travelled.
However often a key occurs, each chunk sends it once: no bucket gets a key more often than there are chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, materialize

NO_ID = np.iinfo(np.int64).max
REPLY = "chunk long, round int, bucket int, bits binary"


def freeze(ids: list, raws: list[bytes]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.large_binary())], names=["i", "t"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def thaw(blob: bytes) -> tuple[list, list[bytes]]:
    t = pa.ipc.open_stream(blob).read_all()
    return t.column("i").to_pylist(), t.column("t").to_pylist()


def packed(texts: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, docs): rows of about chunk_bytes bytes of text (a longer document is a chunk of its own); a chunk's
    number is the task's, shifted by 33 bits, and its own in the task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, size, ids, raws = TaskContext.get().partitionId() << 33, 0, [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([freeze(ids, raws)], pa.binary())], names=["chunk", "docs"])

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if ids and size + len(raw) > chunk_bytes:
                    yield row()
                    chunk, size, ids, raws = chunk + 1, 0, [], []
                ids.append(i)
                raws.append(raw)
                size += len(raw) + 8
        if ids:
            yield row()

    return texts.mapInArrow(pack, "chunk long, docs binary")


def chunks_of(texts: DataFrame, chunk_bytes: int = 4_000_000) -> DataFrame:
    """packed() rows, sorted into partitions by chunk and kept on the executors' disks; a lost part is made again from
    the table."""
    n = 2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed(texts, chunk_bytes).repartition(n, "chunk").persist(StorageLevel.DISK_ONLY)


def with_replies(chunks: DataFrame, replies: list[DataFrame]) -> DataFrame:
    """Each chunk with all its bits so far, as an array of (round, bucket, bits)."""
    if not replies:
        return chunks.withColumn("replies", F.expr("array()").cast("array<struct<round:int,bucket:int,bits:binary>>"))
    all_ = replies[0]
    for r in replies[1:]:
        all_ = all_.unionByName(r)
    mine = all_.groupBy("chunk").agg(F.collect_list(F.struct("round", "bucket", "bits")).alias("replies"))
    return chunks.join(mine, "chunk", "left")


def bits_of(replies: list | None, round_: int) -> dict[int, bytes]:
    return {r["bucket"]: r["bits"] for r in replies or [] if r["round"] == round_}


def per_chunk(joined: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(chunk, ids, raws, replies) yields record batches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, raws = thaw(batch.column(1)[k].as_py())
                yield from run(batch.column(0)[k].as_py(), ids, raws, batch.column(2)[k].as_py())

    return joined.select("chunk", "docs", "replies").mapInArrow(each, schema)


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit key by its upper bits: sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Bytes by significance, so that equal upper bytes stand together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(blob: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def shrink(keys: np.ndarray) -> bytes:
    """Sorted keys by their upper 48 bits: differences in as few whole bytes as the largest needs."""
    top = keys >> np.uint64(16)
    step = np.diff(top, prepend=np.uint64(0))
    width = max(1, -(-int(step[1:].max(initial=0)).bit_length() // 8))
    first = int(top[0]).to_bytes(6, "little")
    step[0] = 0
    return bytes([width]) + first + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def grow(blob: bytes, n: int) -> np.ndarray:
    width = blob[0]
    step = np.zeros((n, 8), np.uint8)
    step[:, :width] = np.frombuffer(blob, np.uint8, n * width, 7).reshape(n, width)
    out = step.reshape(-1).view(np.uint64).copy()
    out[0] = int.from_bytes(blob[1:7], "little")
    return np.cumsum(out, dtype=np.uint64)


def send_seen(chunk: int, keys: np.ndarray, flags: np.ndarray, marks: np.ndarray | None, buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct sorted keys with two flag bits each and, where given, a 64-bit mark."""
    own = buckets_of(keys, buckets)
    cuts = np.flatnonzero(np.diff(own)) + 1
    rows = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        if b > a:
            two = np.packbits(np.stack([flags[a:b] & 1, flags[a:b] >> 1], axis=1).astype(np.uint8).ravel()).tobytes()
            rows.append((int(own[a]), b - a, shrink(keys[a:b]), two, None if marks is None else marks[a:b].astype("<u8").tobytes()))
    yield from _batches(chunk, rows)


def _batches(chunk: int, rows: list, most: int = 200) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), most):
        part = rows[k : k + most]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int32()), pa.array([chunk] * len(part), pa.int64()), pa.array([r[1] for r in part], pa.int32()), *(pa.array([r[j] for r in part], pa.binary()) for j in (2, 3, 4))],
            names=["bucket", "chunk", "n", "keys", "flags", "marks"],
        )


SENT = "bucket int, chunk long, n int, keys binary, flags binary, marks binary"


def _answers(table: pa.Table, round_: int, parts: list[bytes]) -> pa.Table:
    n = table.num_rows
    return pa.table({"chunk": table.column("chunk"), "round": pa.array([round_] * n, pa.int32()), "bucket": table.column("bucket"), "bits": pa.array(parts, pa.binary())})


def seen_round(sent: DataFrame, round_: int, tag: str) -> DataFrame:
    """Two bits for each key: it occurs twice or more anywhere; and flag 0 is set somewhere (without marks), or it
    has two different marks or flag 0 (with marks). Flag 1: twice or more in its chunk."""

    def answer(table: pa.Table) -> pa.Table:
        n = table.column("n").to_pylist()
        keys = np.concatenate([grow(k, m) for k, m in zip(table.column("keys").to_pylist(), n, strict=True)])
        flags = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=2 * m).reshape(m, 2) for f, m in zip(table.column("flags").to_pylist(), n, strict=True)])
        marked = table.column("marks").null_count == 0
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        size = np.diff(np.append(first, len(keys)))
        flag = np.maximum.reduceat(flags[order], first, axis=0)
        twice, other = (size > 1) | (flag[:, 1] > 0), flag[:, 0] > 0
        if marked:
            marks = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("marks").to_pylist()])[order]
            other |= np.minimum.reduceat(marks, first) != np.maximum.reduceat(marks, first)
        out = np.empty((len(keys), 2), np.uint8)
        out[order] = np.repeat(np.stack([twice, other], axis=1).astype(np.uint8), size, axis=0)
        ends = np.cumsum(n)
        return _answers(table, round_, [np.packbits(out[e - m : e].ravel()).tobytes() for e, m in zip(ends.tolist(), n, strict=True)])

    return materialize(sent.groupBy("bucket").applyInArrow(answer, REPLY), tag)


def read_seen(keys: np.ndarray, bits: dict[int, bytes], buckets: int) -> np.ndarray:
    """The bits of seen_round() for the sorted distinct keys, keys x 2."""
    return _read(keys, bits, buckets, 2).reshape(len(keys), 2).astype(bool)


def _read(keys: np.ndarray, bits: dict[int, bytes], buckets: int, each: int) -> np.ndarray:
    own = buckets_of(keys, buckets)
    cuts = np.flatnonzero(np.diff(own)) + 1
    parts = [np.unpackbits(np.frombuffer(bits[int(own[a])], np.uint8), count=each * (b - a)) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True) if b > a]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def firsts(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first occurrence (smallest doc, then pos) of each distinct key, keys ascending; and for every
    occurrence whether it is at that place."""
    order = np.lexsort((pos, doc, k2, k1))
    a, b = k1[order], k2[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.zeros(0, bool)
    first = order[new]
    group = np.cumsum(new) - 1
    at = np.zeros(len(order), bool)
    at[order] = (doc[order] == doc[first][group]) & (pos[order] == pos[first][group])
    return first, at


def send_first(chunk: int, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct keys (k1 64, k2 32 bits), ascending, with the place of each one's first occurrence in the chunk."""
    own = buckets_of(k1, buckets)
    cuts = np.flatnonzero(np.diff(own)) + 1
    rows = [(int(own[a]), b - a, k1[a:b].tobytes(), k2[a:b].astype("<u4").tobytes(), planes(doc[a:b].astype("<i8")) + planes(pos[a:b].astype("<i4"))) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k1)], strict=True) if b > a]
    yield from _batches(chunk, rows)


def first_round(sent: DataFrame, round_: int, tag: str) -> DataFrame:
    """One bit for each key: the chunk holds its first occurrence of all.

    A bucket orders its keys by most-significant-digit passes: by k1 first; groups of one are done with; the others
    by k2, and within equal keys by place."""

    def answer(table: pa.Table) -> pa.Table:
        n = table.column("n").to_pylist()
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
        k1, k2 = read("keys", "<u8"), read("flags", "<u4")
        place = table.column("marks").to_pylist()
        out = np.ones(len(k1), np.uint8)
        order = np.argsort(k1, kind="stable")
        same = k1[order][1:] == k1[order][:-1]
        many = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(k1) else order
        if len(many):
            doc = np.concatenate([unplanes(x[: 8 * m], np.int64, m) for x, m in zip(place, n, strict=True)])
            pos = np.concatenate([unplanes(x[8 * m :], np.int32, m) for x, m in zip(place, n, strict=True)])
            out[many] = firsts(k1[many], k2[many], doc[many], pos[many])[1]
        ends = np.cumsum(n)
        return _answers(table, round_, [np.packbits(out[e - m : e]).tobytes() for e, m in zip(ends.tolist(), n, strict=True)])

    return materialize(sent.groupBy("bucket").applyInArrow(answer, REPLY), tag)


def read_first(k1: np.ndarray, bits: dict[int, bytes], buckets: int) -> np.ndarray:
    return _read(k1, bits, buckets, 1).astype(bool)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pair_keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the pair (a, b)."""
    k1 = mix(a + mix(b + np.uint64(0x9E3779B97F4A7C15)))
    k2 = mix(a * np.uint64(0xD6E8FEB86659FD93) ^ b) >> np.uint64(32)
    return k1, k2
