"""LM scoring: prediction by partial matching over byte contexts, beside smoothed word frequencies."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import rounds as R
from gridloom.llm.common import as_bytes, crc_of, materialize, segment_sums, slices, texts_of, trim

END = 256  # the symbol after a text's last byte, and before its first one
SYMBOLS = 257
BASE = 3  # contexts of this order and longer are dealt out, by their last BASE bytes
STEP = 9  # bits of a symbol


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and one end of each text: its context, last byte first, and itself as one number; and how many
    symbols each text has."""
    n = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    pad = b"\0" * order
    x = np.frombuffer(b"".join([pad + t + b"\0" for t in texts]), np.uint8).astype(np.int64)
    starts = np.cumsum(n + order) - n - order
    before = (starts[:, None] + np.arange(order)).ravel()
    x[before] = END
    x[starts + n + order - 1] = END
    out = x.copy()
    for back in range(1, order + 1):
        out[back:] |= x[:-back] << STEP * (order - back + 1)
    keep = np.ones(len(x), dtype=bool)
    keep[before] = False
    return out[keep], n


def _index(keys: np.ndarray, counts: np.ndarray) -> dict:
    """A trie level: keys (context and symbol, sorted), counts, and the contexts' totals and numbers of symbols."""
    ctx, first = np.unique(keys >> STEP, return_index=True)
    total = np.add.reduceat(counts, first) if len(keys) else counts
    return {"keys": keys, "counts": counts, "ctx": ctx, "total": total, "kinds": np.diff(np.append(first, len(keys)))}


def _level(keys: np.ndarray, counts: np.ndarray) -> dict:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return _index(distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64))


def _find(sorted_: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """values at the keys' places; 0 for keys that aren't there."""
    if not len(sorted_):
        return np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return np.where(sorted_[at] == keys, values[at], 0)


def short_levels(keys: np.ndarray, counts: np.ndarray, order: int) -> list[dict]:
    """Levels 0 to order from the counts of (context of `order` bytes, symbol)."""
    levels = []
    for k in range(order + 1):
        levels.append(_level((keys >> STEP * (order - k + 1)) << STEP | keys & 511, counts))
    return levels


def log_probabilities(grams: np.ndarray, counts: np.ndarray, order: int, short: list[dict]) -> np.ndarray:
    """log10 probability of each gram's symbol after its context: method C escapes with symbol exclusion.

    grams: sorted and distinct, all grams (of training or not) with the same last bytes; counts: how often each occurs
    in training; short: the levels below min(BASE, order). What a context has seen, each shorter one has seen too, so
    that all exclusions of a level are the symbols of the next longer context."""
    seen = counts > 0
    own, many = grams[seen], counts[seen]
    levels = [*short, *(_level((own >> STEP * (order - k + 1)) << STEP | own & 511, many) for k in range(len(short), order + 1))]
    sym = grams & 511
    left, p = np.ones(len(grams)), np.zeros(len(grams))
    open_ = np.ones(len(grams), dtype=bool)
    gone_n, gone_kinds = np.zeros(len(grams)), np.zeros(len(grams), np.int64)
    for k in range(order, -1, -1):
        level = levels[k]
        ctx = grams >> STEP * (order - k + 1)
        kinds = _find(level["ctx"], level["kinds"], ctx)
        c = _find(level["keys"], level["counts"], ctx << STEP | sym)
        total, new = _find(level["ctx"], level["total"], ctx) - gone_n, kinds - gone_kinds
        denom = np.where(kinds == SYMBOLS, total, total + new)
        some = open_ & (total > 0)
        hit = some & (c > 0)
        p[hit] = left[hit] * c[hit] / denom[hit]
        open_ &= ~hit
        some &= ~hit
        left[some] *= new[some] / denom[some]
        gone_kinds = kinds
        if k:  # what this level's symbols count for one level below
            entry = level["keys"] >> STEP
            lower = levels[k - 1]
            below = _find(lower["keys"], lower["counts"], (entry >> STEP) << STEP | level["keys"] & 511 if k > 1 else level["keys"] & 511)
            sums = np.add.reduceat(below, np.searchsorted(entry, level["ctx"])) if len(entry) else below
            gone_n = _find(level["ctx"], sums, ctx)
    p[open_] = left[open_] / (SYMBOLS - gone_kinds[open_])
    return np.log10(p)


def _bucket(grams: np.ndarray, order: int, n: int) -> np.ndarray:
    """Bucket of each gram by its last bytes."""
    last = (grams >> STEP * (order - min(BASE, order) + 1)).astype(np.uint64)
    return (R.mix(last + np.uint64(1)) % np.uint64(n)).astype(np.int64)


def _packed(grams: np.ndarray) -> bytes:
    return R.planes(np.diff(grams, prepend=0))


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(R.unplanes(blob, np.int64, len(blob) // 8))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([x[:1] == x[:1], x[1:] != x[:-1]]))


def _distinct(texts: list[bytes], order: int, piece: int = 1_000_000) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Distinct grams sorted; and for texts of about `piece` bytes at a time their symbols' codes, the index of each
    code's gram, and the texts' lengths in symbols."""
    made = []
    for a, b in slices([len(t) + 1 for t in texts], piece):
        grams, n = grams_of(texts[a:b], order)
        coded = pa.array(grams).dictionary_encode()
        keys = coded.dictionary.to_numpy()
        by = np.argsort(keys)
        made.append((coded.indices.to_numpy(), by, keys[by], n))
    every = np.sort(np.concatenate([np.zeros(0, np.int64), *(x[2] for x in made)]))
    every = every[_runs(every)]
    out = []
    for codes, by, keys, n in made:
        at = np.empty(len(by), np.int64)
        at[by] = np.searchsorted(every, keys)
        out.append((codes, at, n))
    return every, out


def _counted(texts: list[bytes], learn: list[bool], order: int, piece: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of all texts, sorted, and how often each occurs in those to learn from."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]

    def merge() -> None:
        every = np.concatenate(keys)
        by = np.argsort(every)
        every = every[by]
        first = _runs(every)
        counts[:] = [np.add.reduceat(np.concatenate(counts)[by], first).astype("<i4") if len(first) else counts[0]]
        keys[:] = [every[first]]

    for kind in (True, False):
        own = [t for t, x in zip(texts, learn, strict=True) if x == kind]
        for a, b in slices([len(t) + 1 for t in own], piece):
            grams = np.sort(grams_of(own[a:b], order)[0])
            first = _runs(grams)
            keys.append(grams[first])
            counts.append(np.diff(np.append(first, len(grams))).astype(np.int32) * kind)
            del grams, first
            if sum(map(len, keys)) > 2 * len(keys[0]) + piece // 2:
                merge()
    merge()
    return keys[0], counts[0]


def _words(raws: list[bytes], logs: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of each text: tokens (words and one end), those that logs holds and the sum of their logs; and the index of the
    text, word and number of occurrences of each word that logs doesn't hold."""
    split = [[*t.split(), b""] for t in raws]
    n = np.array([len(w) for w in split], dtype=np.int64)
    coded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
    size = max(1, len(coded.dictionary))
    pairs, times = np.unique(np.repeat(np.arange(len(raws)), n) * size + coded.indices.to_numpy(), return_counts=True)
    text, word = np.divmod(pairs, size)
    of = np.array([logs.get(w, np.nan) for w in coded.dictionary.to_pylist()], dtype=np.float64)[word]
    known = ~np.isnan(of)
    here = np.bincount(text[known], times[known], len(raws)).astype(np.int64)
    base = np.bincount(text[known], of[known] * times[known], len(raws))
    return n, here, base, text[~known], coded.dictionary.take(pa.array(word[~known])), times[~known]


def gram_logs(chunks: DataFrame, order: int, learns, count: int) -> DataFrame:
    """(chunk, replies): for each chunk of documents the log10 probabilities of its distinct grams, as an array of
    (bucket, logs), each in the order of the bucket's grams.

    Every chunk sends each distinct gram once, with the number of times that it has it in training documents, to the
    bucket of its last bytes, which holds the whole trie below these. Buckets first add up their grams over 500 chunks
    at a time, then over all, and answer in the same groups; there are as many as the chunks need."""
    buckets, parts = max(64, count // 8), -(-count // 500)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, raws = R.thaw(docs)
                keys, n = _counted([t.lower() for t in raws], learns(ids), order)
                own = _bucket(keys, order, buckets)
                by = np.argsort(own, kind="stable")
                groups = np.split(by, np.flatnonzero(np.diff(own[by])) + 1)
                for a in range(0, len(groups), 200):
                    some = groups[a : a + 200]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(own[g[0]]) for g in some], pa.int32()), pa.array([chunk % parts] * len(some), pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([_packed(keys[g]) for g in some], pa.binary()), pa.array([R.planes(n[g]) for g in some], pa.binary())],
                        names=["bucket", "part", "chunk", "grams", "counts"],
                    )
                del ids, raws, keys, n, own, by, groups
                trim()

    sent = materialize(chunks.select("chunk", "docs").mapInArrow(send, "bucket int, part int, chunk long, grams binary, counts binary"), "lm-grams")

    def add(t: pa.Table) -> pa.Table:
        grams = [_unpacked(x) for x in t.column("grams").to_pylist()]
        kind = "<i4" if "chunk" in t.column_names else "<i8"
        n = [R.unplanes(x, kind, len(g)) for x, g in zip(t.column("counts").to_pylist(), grams, strict=True)]
        level = _level(np.concatenate(grams), np.concatenate(n))
        keys = {c: t.column(c).slice(0, 1) for c in ("bucket", "part") if c in t.column_names}
        del grams, n
        trim()
        return pa.table({**keys, "grams": pa.array([_packed(level["keys"])], pa.binary()), "counts": pa.array([R.planes(level["counts"])], pa.binary())})

    some = sent.groupBy("bucket", "part").applyInArrow(add, "bucket int, part int, grams binary, counts binary")
    every = materialize(some.select("bucket", "grams", "counts").groupBy("bucket").applyInArrow(add, "bucket int, grams binary, counts binary"), "lm-trie")
    base = min(BASE, order)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                grams = _unpacked(x)
                n = R.unplanes(y, np.int64, len(grams))
                level = _level((grams[n > 0] >> STEP * (order - base + 2)) << STEP | grams[n > 0] & 511, n[n > 0])
                yield pa.RecordBatch.from_arrays([pa.array(level["keys"]), pa.array(level["counts"])], names=["key", "n"])

    short = []
    if base:  # at most 257^3 rows, whatever the corpus
        got = every.mapInArrow(heads, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        short = short_levels(got.column("key").to_numpy(), got.column("n").to_numpy(), base - 1)
    shared = chunks.sparkSession.sparkContext.broadcast(short)

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = _unpacked(x)
                logs = log_probabilities(grams, R.unplanes(y, np.int64, len(grams)), order, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x], pa.binary()), pa.array([logs.astype("<f4").tobytes()], pa.binary())], names=["bucket", "grams", "logs"])

    table = materialize(every.mapInArrow(model, "bucket int, grams binary, logs binary"), "lm-logs")

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "logs": pa.array([], pa.binary())})
        grams, logs = _unpacked(known.column("grams")[0].as_py()), np.frombuffer(known.column("logs")[0].as_py(), "<f4")
        out = [R.planes(logs[np.searchsorted(grams, _unpacked(x.as_py()))]) for x in asked.column("grams")]
        trim()
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "logs": pa.array(out, pa.binary())})

    told = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    replies = sent.select("bucket", "part", "chunk", "grams").groupBy("bucket", "part").cogroup(told.groupBy("bucket", "part")).applyInArrow(answer, "chunk long, bucket int, logs binary")
    return replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "logs")).alias("replies"))


def read_logs(keys: np.ndarray, replies: list, order: int, count: int) -> np.ndarray:
    """The replies of gram_logs() in the order of the sorted distinct grams."""
    own = _bucket(keys, order, max(64, count // 8))
    by = np.argsort(own, kind="stable")
    blobs = {r["bucket"]: r["logs"] for r in replies}
    out = np.empty(len(keys))
    at = 0
    while at < len(by):
        logs = R.unplanes(x := blobs[int(own[by[at]])], "<f4", len(x) // 4)
        out[by[at : at + len(logs)]] = logs
        at += len(logs)
    return out


def word_counts(docs: DataFrame, held_mod: int, held_rest: int, flush: int = 200_000) -> DataFrame:
    """(word, n): how often each word occurs in training documents (the empty word is a text's end), gathered in each
    task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])
            words.clear()
            return made

        for batch in batches:
            for t, c in zip(as_bytes(batch.column(1)), crc_of(batch.column(0).to_pylist()), strict=True):
                if c % held_mod != held_rest:
                    words[b""] += 1
                    words.update(t.lower().split())
                    if len(words) > flush:
                        yield rows()
        yield rows()

    return texts_of(docs).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _numbered(texts: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """(chunk, docs): documents in blobs of about chunk_bytes, numbered from 0 without gaps; and how many there are."""
    packed = materialize(R.packed(texts, chunk_bytes), "lm-chunks")
    sizes = {r.p: r.n for r in packed.groupBy(F.shiftright("chunk", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    start, at = {}, 0
    for p in sorted(sizes):
        start[p], at = at, at + sizes[p]
    first = texts.sparkSession.createDataFrame([(p, n) for p, n in start.items()] or [(0, 0)], "p long, first long")
    own = packed.withColumn("p", F.shiftright("chunk", 33)).join(F.broadcast(first), "p")
    return own.select((F.col("first") + F.col("chunk").bitwiseAND(F.lit((1 << 33) - 1))).alias("chunk"), "docs"), at


def score_documents(docs: DataFrame, held_mod: int = 7, held_rest: int = 2, order: int = 5, head_words: int = 200_000, chunk_bytes: int = 5_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out (crc32 of the id's text leaves held_rest), n_tokens, n_known,
    train_tokens, base_score and score.

    base_score sums log10((c+1)/(N+V+1)) over lower-cased words and one end token. score is the log10 probability
    of the lower-cased UTF-8 bytes and one end under PPM (contexts of up to `order` bytes, 0 to 6; method C escapes,
    symbol exclusion), over all 256 bytes and the end. The trie counts every byte of every training document and grows
    with the corpus; see gram_logs() for how it is dealt out.

    Words seen often (a frequency bound that at most head_words words reach) are looked up in the scan; the others
    go by word through a join, counts gathered beforehand by document and word. Null texts count as empty, null ids
    as the empty string; rows of the same doc_id and text get the same result; other columns are ignored; without
    training rows N = V = 0 and every context is new."""
    if not 0 <= order <= 6:
        raise ValueError("order must be 0 to 6")
    spark = docs.sparkSession
    own = texts_of(docs, id_col, text_col)
    chunks, count = _numbered(own, chunk_bytes)
    words = materialize(word_counts(own, held_mod, held_rest), "lm-words")
    by_size = {r.k: (r.v, r.t) for r in words.where("n > 0").groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("v"), F.sum("n").alias("t")).collect()}
    types, tokens = sum(v for v, _ in by_size.values()), sum(t for _, t in by_size.values())
    least, kept = 1 << 62, 0
    for k in sorted(by_size, reverse=True):
        kept += by_size[k][0]
        if kept > head_words:
            break
        least = 1 << int(k)
    floor = tokens + types + 1
    head = words.where(F.col("n") >= least).select("word", "n").toArrow()
    shared = spark.sparkContext.broadcast({bytes(w): math.log10((n + 1) / floor) for w, n in zip(head.column("word").to_pylist(), head.column("n").to_pylist(), strict=True)})
    replies = materialize(gram_logs(chunks, order, lambda ids: [c % held_mod != held_rest for c in crc_of(ids)], max(1, count)), "lm-replies")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with word null for each document (numbered, which tells repeated ids apart), and one for each word of
        it that the head doesn't hold."""
        logs = shared.value
        for batch in batches:
            for chunk, docs, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, raws = R.thaw(docs)
                raws = [t.lower() for t in raws]
                keys, made = _distinct(raws, order)
                of = read_logs(keys, told, order, max(1, count))
                scores = np.concatenate([segment_sums(of[at][codes], n) for codes, at, n in made]).tolist()
                held = [c % held_mod == held_rest for c in crc_of(ids)]
                del keys, made, of
                for a, b in slices([len(t) + 1 for t in raws], 1_000_000):
                    n, here, base, text, rest, times = _words(raws[a:b], logs)
                    row = chunk << 20 | np.arange(a, b)
                    for k in (0, 1):
                        size = (b - a, len(text))[k]
                        none = lambda kind: pa.nulls(size, kind)  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(row), pa.array(ids[a:b], pa.int64()), pa.array(held[a:b], pa.bool_()), none(pa.binary()), pa.array(n), pa.array(here), pa.array(base), pa.array(scores[a:b], pa.float64())]
                            if k == 0
                            else [pa.array(row[text]), none(pa.int64()), none(pa.bool_()), rest, pa.array(times), none(pa.int64()), none(pa.float64()), none(pa.float64())],
                            names=["row", "doc_id", "held_out", "word", "n", "in_head", "base", "score"],
                        )
                trim()

    schema = "row long, doc_id long, held_out boolean, word binary, n long, in_head long, base double, score double"
    scanned = materialize(chunks.join(replies, "chunk").select("chunk", "docs", "replies").mapInArrow(scan, schema), "lm-scan")
    tail = scanned.where("word is not null").select("row", "word", "n")
    rare = words.where(F.col("n") < least).select("word", F.col("n").alias("c"))
    logs = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(floor)))
    sums = (
        tail.join(rare, "word", "left")
        .groupBy("row")
        .agg(F.sum(logs).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    )
    none = tokens == 0
    return (
        scanned.where("word is null")
        .join(sums, "row", "left")
        .select(
            "doc_id",
            "held_out",
            F.col("n").alias("n_tokens"),
            (F.lit(0).cast("long") if none else F.col("in_head") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("tail", F.lit(0.0))).alias("base_score"),
            "score",
        )
    )
