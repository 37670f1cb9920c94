"""SimHash near-dedup by similarity: several fingerprints of a shingle set, Golay-decoded segments as keys, whole sets decide.

Two sets of Jaccard similarity 0.8 differ in 15 % of their SimHash bits, too many for one 64-bit fingerprint. Here a
sketch has 16 pairs of 23-bit segments. A segment is decoded to the codewords nearest to it and to all words one bit
away (some five indices); a pair of texts is a candidate if both segments of some pair share an index, which two sets at
0.8 miss with a probability of about 0.001 and more similar ones with much less."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, materialize, texts_of, trim
from gridloom.llm.components import components
from gridloom.llm.rounds import NO_ID
from gridloom.llm.simhash import _roots, codeword_index

SEED = 42
WIDTH = 5  # words of a shingle
TABLES, BITS = 16, 23  # pairs of segments, and the width of a segment: a word of the Golay code
WORDS, SEEN = 12, 4  # 64-bit words of a sketch, and those that travel to compare candidates
FAR = 73  # differing bits of these 256 at most: six deviations above the mean of two sets at 0.8
FAR_WHOLE = 200  # of all 768, likewise
_rng = np.random.Generator(np.random.PCG64(SEED))
_PLACE = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 1 << 64, WORDS, dtype=np.uint64)
_FLIPS = np.concatenate([[0], 1 << np.arange(BITS)])
_ROW = np.dtype([("key", "<u2"), ("seg", "<u4"), ("node", "<i8"), ("f", "<u8", SEEN)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of `width` words, sorted; of the whole where there are fewer."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    if not words:
        return h
    n = max(1, len(words) - width + 1)
    sums = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        sums += h[k : k + n] * _PLACE[k]
    return np.unique(_mixed(sums + np.uint64(min(width, len(words)))))


def sketches(sets: list[np.ndarray], step: int = 8_192) -> np.ndarray:
    """sets x WORDS: a bit is set where over half the set's hashes (mixed anew for each word) have it."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    sums = np.zeros((len(sets), 64 * WORDS), np.int32)
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), size)
    for a in range(0, len(every), step):
        own = owner[a : a + step]
        h = _mixed(every[a : a + step, None] ^ _XOR)
        lanes = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        # lanes of eight counters: no run of more than 255 rows is added up in one
        new = np.concatenate([[True], own[1:] != own[:-1]])
        since = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        starts = np.flatnonzero(since % 255 == 0)
        np.add.at(sums, own[starts], np.add.reduceat(lanes, starts, axis=0).view(np.uint8))
    return np.packbits(2 * sums > size[:, None], axis=1, bitorder="little").view("<u8").reshape(len(sets), WORDS)


def segments(sketch: np.ndarray) -> np.ndarray:
    """rows x 2 TABLES segments of BITS bits."""
    bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8).reshape(len(sketch), -1), axis=1, bitorder="little")
    used = bits[:, : 2 * TABLES * BITS].reshape(len(sketch), 2 * TABLES, BITS).astype(np.int64)
    return used @ (1 << np.arange(BITS))


def nearby(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct codeword indices of each segment and of all words one bit from it."""
    every = np.sort(codeword_index(seg[:, None] ^ _FLIPS), axis=1)
    new = np.concatenate([np.ones((len(every), 1), bool), np.diff(every, axis=1) != 0], axis=1)
    rows, cols = np.nonzero(new)
    return rows, every[rows, cols]


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets' intersection is at least `percent` of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    n = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * n >= percent * (len(a) + len(b) - n)


def stars(key: np.ndarray, node: np.ndarray, f: np.ndarray) -> np.ndarray:
    """2 x pairs. In each key the smallest node is a centre and takes all nodes whose sketches are near to its own; the
    smallest of those left over is the next centre, which also meets the nearest one of all that earlier centres took, if
    it is near. So every node that is near to another one of its key is in some pair, and there are at most two pairs
    for each entry. Entries are sorted by key and node."""
    start = np.searchsorted(key, key, side="left")
    taken, left, out = np.zeros(len(key), bool), np.arange(len(key)), [np.zeros((2, 0), np.int64)]
    while len(left):
        first = np.concatenate([[True], key[left[1:]] != key[left[:-1]]])
        own = left[first]
        before = np.cumsum(np.concatenate([[0], taken]))
        n = np.where(before[own] > before[start[own]], own - start[own], 0)
        centre, earlier = np.repeat(own, n), np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        if len(centre):
            d = np.where(taken[earlier], np.bitwise_count(f[earlier] ^ f[centre]).sum(axis=1), 999)
            busy = np.flatnonzero(n)
            begin = np.cumsum(n[busy]) - n[busy]
            least = np.minimum.reduceat(d, begin)
            at = np.flatnonzero((d == np.repeat(least, n[busy])) & (d <= FAR))
            at = at[np.unique(centre[at], return_index=True)[1]]  # one for each centre
            out.append(np.stack([node[earlier[at]], node[centre[at]]]))
        centre = own[np.cumsum(first) - 1]
        near = ~first & (np.bitwise_count(f[left] ^ f[centre]).sum(axis=1) <= FAR)
        out.append(np.stack([node[left[near]], node[centre[near]]]))
        taken[left[near]] = True
        left = left[~first & ~near]
    return np.concatenate(out, axis=1)


def _meet(nodes: DataFrame, count: int, bucket_rows: int = 200_000) -> DataFrame:
    """(a, b, root): from the stars() of all keys over nodes (fp, sketch), for each bucket and node a the smallest node b
    that it is paired with (null if there is none) and the smallest node of its tree. A node goes once to every
    index of the first segment of each table; the second one is decoded there. Rows travel as packed blobs, one per bucket and batch,
    and there are as many buckets as hold bucket_rows rows each."""
    n = max(1, min(TABLES << 12, count * TABLES * 6 // bucket_rows))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                part = batch.slice(a, 20_000)
                fp = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                sketch = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
                seg = segments(sketch)
                for t in range(TABLES):
                    rows, index = nearby(seg[:, 2 * t])
                    made = np.empty(len(rows), _ROW)
                    made["key"], made["seg"], made["node"], made["f"] = t << 12 | index, seg[rows, 2 * t + 1], fp[rows], sketch[rows, -SEEN:]
                    bucket = (made["key"].astype(np.int64) * 0x9E3779B1 >> 7) % n
                    order = np.argsort(bucket, kind="stable")
                    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([made[p].tobytes() for p in parts], pa.binary())], names=["bucket", "blob"])

    def match(t: pa.Table) -> pa.Table:
        got = np.frombuffer(b"".join(t.column("blob").to_pylist()), _ROW)
        out = [np.zeros((2, 0), np.int64)]
        got = got[np.argsort(got["key"], kind="stable")]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], got["key"][1:] != got["key"][:-1]])), len(got))
        at = 0
        while at < len(cuts) - 1:  # some keys at a time
            end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + 16_000, side="right")) - 1)
            own = got[cuts[at] : cuts[end]]
            rows, index = nearby(own["seg"].astype(np.int64))
            key = own["key"][rows].astype(np.int64) << 12 | index
            order = np.lexsort((own["node"][rows], key))
            key, rows = key[order], rows[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            several = ~(new & np.append(new[1:], True))
            key, rows = key[several], rows[several]
            if len(key):
                f, node = np.ascontiguousarray(own["f"][rows]), own["node"][rows]
                out.append(np.unique(stars(key, node, f), axis=1))
            at = end
        a, b = np.concatenate(out, axis=1)
        every = np.unique(np.concatenate([a, b]))
        a, b = np.searchsorted(every, np.maximum(a, b)), np.searchsorted(every, np.minimum(a, b))
        root = _roots(len(every), a, b, np.arange(len(every)))
        least = np.full(len(every), len(every))
        np.minimum.at(least, a, b)
        one = least < len(every)
        del got, out
        trim()
        return pa.table({"a": every, "b": pa.array(every[np.where(one, least, 0)] if len(every) else every, pa.int64(), mask=~one), "root": every[root]})

    return nodes.select("fp", "sketch").mapInArrow(send, "bucket int, blob binary").groupBy("bucket").applyInArrow(match, "a long, b long, root long")


def _text_print(words: list[bytes]) -> int:
    """A 64-bit hash of a text's words, signed."""
    x = xxhash.xxh3_64_intdigest(b" ".join(words), SEED)
    return x - (1 << 64) if x >> 63 else x


def _ticket(fp: int, doc_id: int | None) -> int:
    """A number of 32 bits for a node and the document that stands for it."""
    return xxhash.xxh32_intdigest(b"%d %d" % (fp, NO_ID if doc_id is None else doc_id), SEED)


def _marks(asked: DataFrame, most: int = 27) -> np.ndarray:
    """A bit for the lowest digits of the ticket of every (fp, first) asked for, of at most 2^27 bits."""
    bits = min(most, max(16, (64 * asked.count()).bit_length()))

    def tickets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_ticket(f, i) & (1 << bits) - 1 for f, i in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.int64())], names=["x"])

    def pack(t: pa.Table) -> pa.Table:
        on = np.zeros(1 << 16, np.uint8)
        on[t.column("x").to_numpy() & 0xFFFF] = 1
        return pa.table({"part": t.column("part").slice(0, 1), "blob": pa.array([np.packbits(on).tobytes()], pa.binary())})

    out = np.zeros((1 << bits - 16, 1 << 13), np.uint8)
    parts = asked.select("fp", "first").mapInArrow(tickets, "x long").select("x", F.shiftright("x", 16).alias("part"))
    for r in parts.groupBy("part").applyInArrow(pack, "part long, blob binary").toLocalIterator():
        out[r.part] = np.frombuffer(bytes(r.blob), np.uint8)
    return out.ravel()


def _sets(asked: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, tag: str) -> DataFrame:
    """(fp, grams): the shingle sets of the nodes asked for (fp, distinct). A scan lets one document for each of them
    through by its mark, so that a set travels once however many copies there are."""
    asked = materialize(nodes.join(asked, "fp", "left_semi").select("fp", "first"), f"{tag}-asked")
    shared = texts.sparkSession.sparkContext.broadcast(_marks(asked))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, sent = shared.value, set()
        for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
            fps, grams = [], []
            for i, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = raw.lower().split()
                fp = _text_print(words)
                at = _ticket(fp, i) & (8 * len(marks) - 1)
                if marks[at >> 3] >> (7 - (at & 7)) & 1 and (i is not None or fp not in sent):
                    if i is None:
                        sent.add(fp)
                    fps.append(fp)
                    grams.append(shingle_set(words, width).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(grams, pa.binary())], names=["fp", "grams"])
        trim()

    sets = texts.mapInArrow(take, "fp long, grams binary").join(asked.select("fp"), "fp", "left_semi")
    return materialize(sets.groupBy("fp").agg(F.first("grams").alias("grams")), f"{tag}-sets")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, width: int, tag: str) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are alike."""
    pairs = materialize(pairs, f"{tag}-pairs")
    sets = _sets(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), nodes, texts, width, tag)
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("grams").alias("y")), "b")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8"), percent) for p, q in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        trim()

    return materialize(both.select("a", "b", "x", "y").mapInArrow(decide, "a long, b long"), f"{tag}-links")


def joined(fp: np.ndarray, root: np.ndarray, sketch: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest (a, b) of links that join roots: nodes left x right with near sketches, different roots and like sets."""
    label, out = {r: r for r in root.tolist()}, []

    def top(r: int) -> int:
        while label[r] != r:
            label[r] = label[label[r]]
            r = label[r]
        return r

    for i in left.tolist():
        near = right[np.bitwise_count(sketch[right] ^ sketch[i]).sum(axis=1) <= FAR_WHOLE]
        for j in near.tolist():
            x, y = top(int(root[i])), top(int(root[j]))
            if x != y and alike(sets[i], sets[j], percent):
                label[max(x, y)] = min(x, y)
                out.append((int(fp[i]), int(fp[j])))
    return out


def _joined(nodes: DataFrame, texts: DataFrame, percent: int, width: int, block: int = 200) -> DataFrame:
    """(a, b): links among nodes (fp, first, sketch, root, area) that join the roots of an area (nodes that chains of
    near sketches connect). An area is cut into blocks, pairs of blocks are compared where they meet, and only links that
    join roots leave: an area of many unlike members costs comparisons, but neither rows for all its pairs nor one
    task."""
    sizes = nodes.groupBy("area").agg(F.count("*").alias("n"), F.countDistinct("root").alias("roots")).where("roots > 1")
    open_ = materialize(nodes.join(sizes, "area"), "similar-open")
    sets = _sets(open_.select("fp"), nodes.select("fp", "first"), texts, width, "similar-joined")
    cut = F.ceil(F.col("n") / block).cast("int")
    own = open_.withColumn("own", F.pmod(F.xxhash64("fp"), cut).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
    buckets = max(1, open_.count() // 2000)
    cells = own.join(sets, "fp").select(
        F.when(F.col("n") > block, F.col("area")).otherwise(F.pmod(F.xxhash64("area"), F.lit(buckets))).alias("cell"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "area", "fp", "root", "sketch", "grams"
    )

    def compare(t: pa.Table) -> pa.Table:
        own, area, fp, root = (t.column(c).to_numpy() for c in ("own", "area", "fp", "root"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u8").reshape(-1, WORDS)
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("grams")]
        i, j, out = t.column("i")[0].as_py(), t.column("j")[0].as_py(), []
        for k in np.unique(area):
            mine = np.flatnonzero(area == k)
            out += joined(fp, root, sketch, mine[own[mine] == i], mine[own[mine] == j], sets, percent)
        return pa.table({"a": pa.array([max(x) for x in out], pa.int64()), "b": pa.array([min(x) for x in out], pa.int64())})

    return materialize(cells.groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long"), "similar-joined")


def similar_groups(docs: DataFrame, percent: int = 80, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, fp (a 64-bit hash of its words) and component_id, the smallest doc_id that
    links of texts with a Jaccard similarity of at least `percent` / 100 (80 or more) reach.

    First every node meets the smallest of the nodes that a star of some key joins it to; the areas of near nodes that
    these links leave apart are compared block by block, see _joined(). So a group's size costs no pairs within it, but
    an area of nodes none of which are alike costs as many comparisons as it has pairs. Texts without words are one group; null ids are
    as in simhash.near_groups(); equal texts are one node; other columns are ignored; whole texts count."""
    if percent < 80:
        raise ValueError("the sketches find similarities of 80 percent or more")
    texts = texts_of(docs, id_col, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                words = [x.lower().split() for x in as_bytes(batch.column(1).slice(a, 500))]
                made = sketches([shingle_set(w, width) for w in words])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 500), pa.array(list(map(_text_print, words)), pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())], names=["doc_id", "fp", "sketch"])
        trim()

    own = materialize(texts.mapInArrow(scan, "doc_id long, fp long, sketch binary"), "similar-prints")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("sketch").alias("sketch")), "similar-nodes")
    count = nodes.count()
    met = materialize(_meet(nodes, count), "similar-met")
    tried = met.where("b is not null").groupBy("a").agg(F.min("b").alias("b"))
    links = _verified(tried, nodes, texts, percent, width, "similar-first")

    def rooted_by(links: DataFrame, name: str) -> DataFrame:
        of = components(links, f"similar-{name}", hubs=False).select(F.col("node").alias("fp"), F.col("root").alias("_to"))
        return nodes.join(of, "fp", "left").select("fp", F.coalesce("_to", "fp").alias(name))

    areas = rooted_by(met.select("a", F.col("root").alias("b")).distinct(), "area").join(rooted_by(links, "root"), "fp")
    more = _joined(nodes.join(areas, "fp"), texts, percent, width)
    found = components(links.union(more), "similar-all", hubs=False).withColumnRenamed("node", "fp")
    rooted = materialize(nodes.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "similar-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.select("doc_id", "fp").join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """As simhash.keep_one(), by similarity."""
    found = similar_groups(docs, percent, width)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["_keep"]), "left_semi")
