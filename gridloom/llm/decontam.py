"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes

#: Bytes that belong to a word stay (A-Z lower-cased); all others become a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def windows_of(items: list[tuple], window: int) -> dict[tuple, list[int]]:
    """Words of each window -> indices of the items that hold it."""
    out = defaultdict(set)
    for i, (_, text) in enumerate(items):
        words = words_of((text or "").encode())
        for s in range(max(1, len(words) - window + 1) if words else 0):
            out[tuple(words[s : s + window])].add(i)
    return {k: sorted(v) for k, v in out.items()}


@dataclass(frozen=True)
class Matcher:
    """An Aho-Corasick automaton whose alphabet writes every benchmark word with `digits` characters: digit k is one of
    the 64 characters from 64 k + 1 on, so that no match begins inside a word. All other words are written NONE."""

    codes: dict
    digits: int
    machine: ahocorasick.Automaton


NONE = "\0"


def automaton(windows: dict[tuple, list[int]], most_bytes: int = 1 << 30) -> Matcher | None:
    """Values: (words, item indices). ValueError where the automaton could take more than most_bytes (56 for each
    character of each window)."""
    if not windows:
        return None
    codes = {w: n for n, w in enumerate(sorted({w for k in windows for w in k}))}
    digits = max(1, -(-(len(codes) - 1).bit_length() // 6))
    size = 56 * digits * sum(map(len, windows))
    if size > most_bytes:
        raise ValueError(f"{len(windows)} benchmark windows may take {size} bytes, more than most_bytes ({most_bytes})")
    codes = {w: "".join(chr(1 + 64 * k + (n >> 6 * k & 63)) for k in range(digits)) for w, n in codes.items()}
    a = ahocorasick.Automaton()
    for words, items in windows.items():
        a.add_word("".join(codes[w] for w in words), (len(words), tuple(items)))
    a.make_automaton()
    return Matcher(codes, digits, a)


def hits_of(raw: bytes, a: Matcher | None) -> tuple[int, list[tuple[int, int, tuple]]]:
    """Number of words, and (first word, words, items) of each occurrence, from one pass over the text."""
    words = words_of(raw)
    if a is None or not words:
        return len(words), []
    none, get = NONE * a.digits, a.codes.get
    line = "".join([get(w, none) for w in words])
    return len(words), [((end + 1) // a.digits - n, n, items) for end, (n, items) in a.machine.iter(line)]


def runs(found: list[tuple[int, int, tuple]]) -> list[tuple[int, int]]:
    """Maximal (first, end) word ranges of the occurrences."""
    out: list[list[int]] = []
    for s, n, _ in sorted(found):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [(s, e) for s, e in out]


def _shared(benchmark: DataFrame, id_col: str, text_col: str, window: int, most_bytes: int):
    """Broadcast of (item ids as strings, automaton): a stated query set of a checked size, built once and unpickled
    once by each Python worker."""
    items, chars = [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        chars += len(row.t or "")
        if chars > most_bytes:
            raise ValueError(f"the benchmark has more characters than most_bytes ({most_bytes})")
        items.append((row.i, row.t))
    return benchmark.sparkSession.sparkContext.broadcast(([i for i, _ in items], automaton(windows_of(items, window), most_bytes)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_bytes: int = 1 << 30, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, items (sorted as strings, distinct) and spans, the
    maximal hit ranges as (start, end) code points of the original text.

    The benchmark is a query set: its windows make one automaton, broadcast, that every document passes once;
    ValueError where that could take more than most_bytes. Null or empty texts have no words; an item of fewer than
    `window` words is one window; null item ids are left out of items; other columns are ignored."""
    shared = _shared(benchmark, item_col, item_text_col, window, most_bytes)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        names, a = shared.value
        for batch in batches:
            counts, hit, items, spans = [], [], [], []
            for raw in as_bytes(batch.column(1)):
                n, found = hits_of(raw, a)
                merged = runs(found)
                counts.append(n)
                hit.append(sum(e - s for s, e in merged))
                items.append(sorted({names[i] for x in found for i in x[2] if names[i] is not None}))
                at = [m.span() for m in _WORD.finditer(raw.lower().decode())] if merged else []  # bytes.lower() touches A-Z only
                spans.append([{"start": at[s][0], "end": at[e - 1][1]} for s, e in merged])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(find, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", most_bytes: int = 1 << 30) -> DataFrame:
    """The rows of docs whose text holds no window of the benchmark, columns unchanged; null texts stay."""
    shared = _shared(benchmark, "item_id", "text", window, most_bytes)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, a = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not hits_of(raw, a)[1] for raw in as_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
