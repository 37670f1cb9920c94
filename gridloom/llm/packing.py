"""Packing: documents routed to context-size tiers, each tier packed, gaps filled from shorter tiers."""

from __future__ import annotations

import string
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, slices, texts_of

_encoders: dict = {}
_MARKS = string.punctuation.encode()


class _Ids(dict):
    """Ids of words met early, and of the words at hand beyond them."""

    extra: dict = {}

    def __missing__(self, word: bytes) -> bytes:
        return self.extra[word]


class WordEncoder:
    """Ids of texts as little-endian uint32 bytes. Only for vocabularies like the default one: lower case, splits that
    never cross white space, every run of letters a unit whose last token ends a word. Distinct words are encoded, not
    their occurrences; the first `most` are remembered."""

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, _Ids()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words of letters only, many in one call; the tokens that end a word tell them apart."""
        out = {}
        for a in range(0, len(words), 500):
            part = words[a : a + 500]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                raw = ids.tobytes()
                for w, s, e in zip(part, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                    out[w] = raw[4 * s : 4 * e]
            else:
                out |= {w: self._one(w.decode()) for w in part}
        return out

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words; one that ends in ASCII punctuation after an ASCII letter takes the ids of these two parts."""
        parts = {}
        for w in words:
            stem = w.rstrip(_MARKS)
            if stem != w and (stem[-1:].isalpha() or not stem):
                parts[w] = (stem, w[len(stem) :])
        need = {x for p in parts.values() for x in p if x and x not in self.known} | {w for w in words if w not in parts}
        letters = [w for w in need if w.isalpha() or w.decode().isalpha()]
        new = self._letters(letters)
        new |= {w: self._one(w.decode()) for w in need.difference(letters)}
        of = lambda x: b"" if not x else new[x] if x in new else self.known[x]
        return new | {w: of(stem) + of(end) for w, (stem, end) in parts.items()}

    def __call__(self, raws: list[bytes]) -> list[bytes]:
        # a special token's text stands for itself, in its own case
        split = [None if b"<|" in r else r.lower().split() for r in raws]
        known = self.known
        new = self._learn({w for w in set().union(*(w for w in split if w)) if w not in known})
        if len(known) + len(new) <= self.most:
            known.update(new)
        else:
            known.extra = new
        return [self._one(r.decode()) if w is None else b"".join(map(known.__getitem__, w)) for r, w in zip(raws, split, strict=True)]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@dataclass
class Sequence:
    """Pieces (document, start, length) laid one after the other; `tier` is the window they are packed into."""

    tier: int
    pieces: list[tuple[int, int, int]] = field(default_factory=list)
    used: int = 0

    def put(self, doc: int, start: int, n: int) -> None:
        self.pieces.append((doc, start, n))
        self.used += n


def pack(sizes: list[int], tiers: tuple[int, ...]) -> list[Sequence]:
    """Packs documents of the given sizes. tiers: powers of two, ascending; the last is the longest window.

    Full windows are cut from what is longer than the longest tier; the rest goes to the smallest tier that holds it.
    From the longest tier down, each document opens a window, whose gap takes the largest waiting documents of
    shorter tiers that surely fit, then a cut of the shortest one; where nothing shorter is left, of one of the same
    tier. The one window that nothing is left to fill is split into full windows of smaller powers of two."""
    top = tiers[-1]
    waiting: dict[int, deque] = {t: deque() for t in tiers}
    out: list[Sequence] = []

    def route(doc: int, start: int, n: int) -> None:
        while n >= top:
            out.append(Sequence(top, [(doc, start, top)], top))
            start, n = start + top, n - top
        if n:
            waiting[next(t for t in tiers if t >= n)].append((doc, start, n))

    for doc, n in enumerate(sizes):
        route(doc, 0, n)
    for i in range(len(tiers) - 1, -1, -1):
        tier = tiers[i]
        while waiting[tier]:
            s = Sequence(tier)
            s.put(*waiting[tier].popleft())
            while s.used < tier:
                gap = tier - s.used
                fit = next((t for t in reversed(tiers[:i]) if t <= gap and waiting[t]), None)
                if fit:
                    s.put(*waiting[fit].popleft())
                    continue
                cut = next((t for t in tiers[: i + 1] if waiting[t]), None)
                if cut is None:
                    break
                doc, start, n = waiting[cut].popleft()
                take = min(n, gap)
                s.put(doc, start, take)
                if n > take:
                    waiting[next(t for t in tiers if t >= n - take)].append((doc, start + take, n - take))
            out += [s] if s.used == tier else _split(s)
    return out


def _split(s: Sequence) -> list[Sequence]:
    """The pieces of s over windows of the powers of two that its length is made of, longest first."""
    out, left = [], s.used
    pieces = deque(s.pieces)
    while left:
        size = 1 << (left.bit_length() - 1)
        now = Sequence(size)
        while now.used < size:
            doc, start, n = pieces.popleft()
            take = min(n, size - now.used)
            now.put(doc, start, take)
            if n > take:
                pieces.appendleft((doc, start + take, n - take))
        out.append(now)
        left -= size
    return out


def step_groups(sequences: list[Sequence], budget: int) -> list[int]:
    """A group for each sequence: longest first into the group with the fewest tokens, so that the groups of one
    packing run, as many as budget asks for, hold about as many tokens each."""
    import heapq

    total = sum(s.used for s in sequences)
    heap = [(0, g) for g in range(max(1, round(total / budget)))]
    out = [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: (-sequences[i].used, i)):
        load, g = heap[0]
        heapq.heapreplace(heap, (load + sequences[i].used, g))
        out[i] = g
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = (64, 128, 256, 512, 1024, 2048, 4096), buffer_tokens: int = 4_000_000, group_tokens: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start (tokens of the document before it), length, ids (little-endian uint32),
    doc_tokens (with the end token), sequence_id, offset, tier and step_group.

    Each task packs its documents in buffers of about buffer_tokens tokens (a longer document is a buffer of its
    own), so memory is bounded and nothing is shuffled; what is left in the last window of a buffer becomes full
    windows of smaller powers of two: no sequence is padded. Step groups of a buffer hold about group_tokens tokens
    each. Null or empty texts are the end token alone; repeated rows are packed each; null ids stay null; other
    columns are ignored. sequence_id and step_group are unique by task and count, not consecutive over the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        first = group = TaskContext.get().partitionId() << 36
        ids: list = []
        tokens: list[bytes] = []
        held = 0

        def flush():
            nonlocal first, group, held
            sizes = [len(t) // 4 for t in tokens]
            packed = pack(sizes, tiers)
            groups = step_groups(packed, group_tokens)
            rows = [(d, s, n, k, o) for k, q in enumerate(packed) for (d, s, n), o in zip(q.pieces, np.cumsum([0, *(p[2] for p in q.pieces)]).tolist(), strict=False)]
            for a in range(0, len(rows), 2000):
                part = rows[a : a + 2000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d] for d, *_ in part], pa.int64()),
                        pa.array([s for _, s, *_ in part], pa.int64()),
                        pa.array([n for _, _, n, *_ in part], pa.int64()),
                        pa.array([tokens[d][4 * s : 4 * (s + n)] for d, s, n, *_ in part], pa.binary()),
                        pa.array([sizes[d] for d, *_ in part], pa.int64()),
                        pa.array([first + k for *_, k, _ in part], pa.int64()),
                        pa.array([o for *_, o in part], pa.int64()),
                        pa.array([packed[k].tier for *_, k, _ in part], pa.int32()),
                        pa.array([group + groups[k] for *_, k, _ in part], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"],
                )
            first += len(packed)
            group += max(groups, default=-1) + 1
            ids.clear()
            tokens.clear()
            held = 0

        for batch in batches:
            names, raws = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for a, b in slices([len(r) for r in raws], 200_000):
                for i, made in zip(names[a:b], encode(raws[a:b]), strict=True):
                    ids.append(i)
                    tokens.append(made + end)
                    held += len(tokens[-1]) // 4
                    if held >= buffer_tokens:
                        yield from flush()
        if ids:
            yield from flush()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
