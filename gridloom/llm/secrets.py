"""Secret scans: rule spans plus character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, bounded_sample, texts_of

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_-]{3,}")
_PLAIN = re.compile(r"(?:[a-z]{1,12}|[A-Z]{1,12}|[A-Z][a-z]{1,11}|[0-9]{1,4})")
_PART = re.compile(r"[A-Za-z]*[0-9]{0,4}|[0-9]+")
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_CODE = {c: i + 1 for i, c in enumerate(_SYMBOLS)}  # 0: start of a string
_RUN = np.zeros(256, dtype=bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True


@dataclass(frozen=True)
class RandomStringModel:
    """Log-likelihood ratio (random over ordinary) of each character after the one before it, and its threshold."""

    ratio: np.ndarray
    threshold: float

    def score(self, token: str) -> float:
        codes = [_CODE[c] for c in token if c in _CODE]
        r = self.ratio
        return float(sum(r[a, b] for a, b in zip([0, *codes], codes, strict=False)))


def random_strings(n: int, seed: int = 11) -> list[str]:
    """Labelled positives by rule: uniform strings over the alphabets that keys are written in."""
    rng = random.Random(seed)
    kinds = ("0123456789abcdef", _SYMBOLS[:62], _SYMBOLS[:64], _SYMBOLS[:26] + _SYMBOLS[52:62], _SYMBOLS)
    return ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(16, 64))) for i in range(n)]


def _transitions(strings: list[str], alpha: float = 0.5) -> np.ndarray:
    n = len(_SYMBOLS) + 1
    counts = np.full((n, n), alpha)
    for s in strings:
        codes = [_CODE[c] for c in s if c in _CODE]
        np.add.at(counts, (np.array([0, *codes[:-1]], dtype=int)[: len(codes)], np.array(codes, dtype=int)), 1)
    counts[:, 0] = 1e-12
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def fit(positives: list[str], negatives: list[str], odds: float = 1e4) -> RandomStringModel:
    """Two first-order chains. The threshold is the log of the prior odds against a secret, or the score that one
    in a hundred ordinary training identifiers of 16 or more characters passes, where that is higher."""
    ratio = _transitions(positives) - _transitions(negatives)
    model = RandomStringModel(ratio, 0.0)
    scores = sorted(model.score(x) for x in negatives if len(x) >= 16)
    high = scores[int(0.99 * (len(scores) - 1))] if scores else 0.0
    return RandomStringModel(ratio, max(math.log(odds), high))


def identifiers(words: list[str], n: int, seed: int = 5) -> list[str]:
    """Ordinary identifiers: the words themselves, and words joined in snake, kebab, camel and path form."""
    words = sorted({w for w in words if w})
    if not words:
        return []
    rng = random.Random(seed)
    out = list(words)
    for i in range(n):
        parts = rng.choices(words, k=rng.randint(2, 4))
        sep = ("_", "-", "/", "")[i % 4]
        out.append(sep.join(p.capitalize() if not sep else p for p in parts) + (str(rng.randint(0, 99)) if i % 7 == 0 else ""))
    return out


def ordinary(words: list[str], positives: list[str], odds: float = 1e4) -> list[str]:
    """The words that can stand for ordinary ones, though nobody has reviewed them. Words whose parts are short and of
    one case do. Words with a part that mixes letters and digits (but for a short number at its end) don't. A first
    pass, fitted to the former, scores all others, and those that it takes for random are left out."""
    words = sorted(set(words))
    parts = [re.split("[_-]+", w) for w in words]
    sure = [w for w, p in zip(words, parts, strict=True) if all(_PLAIN.fullmatch(x) for x in p if x)]
    rest = [w for w, p in zip(words, parts, strict=True) if not all(_PLAIN.fullmatch(x) for x in p if x) and all(_PART.fullmatch(x) for x in p)]
    ratio = _transitions(positives) - _transitions(identifiers(sure, 4000))
    first = RandomStringModel(ratio, math.log(odds))
    return sorted(sure + [w for w in rest if first.score(w) <= first.threshold])


def base_spans(text: str, raw: bytes | None = None, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points of the rule kinds, leftmost non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    raw = text.encode() if raw is None else raw
    place = _Places(raw)
    for a, b in _long_runs(raw) if runs is None else runs:
        run = raw[a:b].decode()
        hits = [(m.start(), 1, m.end()) for m in _ACCESS.finditer(run) if m.end() - m.start() >= 20]
        hits += [(m.start(), 2, m.end()) for m in _HEX.finditer(run)]
        if hits:
            at = place(a)
            found += [(at + x, k, at + y) for x, k, y in hits]
    return found


class _Places:
    """Code points before ascending byte offsets; each stretch of the text is counted once."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.chars = raw, 0, 0

    def __call__(self, at: int) -> int:
        self.chars += len(self.raw[self.at : at].decode())
        self.at = at
        return self.chars


def _long_runs(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges of 16 or more characters that a key can hold; every rule match but assignments lies in one."""
    if len(raw) < 16:
        return []
    on = np.empty(len(raw) + 2, dtype=bool)
    on[0] = on[-1] = False
    on[1:-1] = _RUN[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.flatnonzero(on[1:] != on[:-1])
    a, b = edges[::2], edges[1::2]
    keep = b - a >= 16
    return list(zip(a[keep].tolist(), b[keep].tolist(), strict=True))


def spans_of(raw: bytes, model: RandomStringModel | None) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind, end), sorted; kind indexes KINDS. Model spans never touch rule spans."""
    text, runs = raw.decode(), _long_runs(raw)
    found = base_spans(text, raw, runs)
    if model is not None and runs:
        extra, place = [], _Places(raw)
        for a, b in runs:
            run = raw[a:b].decode()
            for m in _TOKEN.finditer(run):
                if model.score(m.group()) > model.threshold:
                    at = place(a)
                    extra.append((at + m.start(), 3, at + m.end()))
        taken = _merged(found)
        begins = [s for s, _ in taken]
        found += [x for x in extra if not ((k := bisect_left(begins, x[2])) and taken[k - 1][1] > x[0])]
    return sorted(found)


def _merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Disjoint (start, end) ranges that the spans cover, ascending."""
    out: list[tuple[int, int]] = []
    for s, _, e in sorted(found):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def train(docs: DataFrame, max_train_docs: int = 2000, words_per_doc: int = 40, id_col: str = "doc_id", text_col: str = "text") -> RandomStringModel:
    """Fits the two chains on labelled strings of at most max_train_docs documents: access keys and hexadecimal values
    that the rules matched (secret; assigned values are left out, for they are as often words as keys) and at most
    words_per_doc distinct other words (ordinary, see ordinary()), with random_strings() besides."""

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, bad = [], []
            for raw in as_bytes(batch.column(1)):
                text = raw.decode()
                spans = base_spans(text, raw)
                bad += [text[s:e] for s, k, e in spans if k > 0]
                for s, _, e in sorted(spans, reverse=True):
                    text = text[:s] + " " + text[e:]
                words = sorted({w for w in _WORD.findall(text) if not (w.isalnum() and not w.isalpha() and len(w) > 12)}, key=lambda w: hashlib.md5(w.encode()).digest())
                good += words[:words_per_doc]
            yield pa.RecordBatch.from_pydict({"secret": pa.array([True] * len(bad) + [False] * len(good), pa.bool_()), "s": pa.array(bad + good, pa.string())})

    rows = bounded_sample(texts_of(docs, id_col, text_col), max_train_docs).mapInArrow(labelled, "secret boolean, s string").collect()
    bad = sorted(r.s for r in rows if r.secret)
    good = sorted({r.s for r in rows if not r.secret})
    positives = bad + random_strings(4000)
    return fit(positives, identifiers(ordinary(good, positives), 4000))


def scan_secrets(docs: DataFrame, model: RandomStringModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id and secrets, an array of (kind, start, end, value) sorted by start then
    kind; offsets count code points, ends are exclusive.

    Null or empty texts have no secrets; null ids stay null; repeated rows give repeated results; other columns
    are ignored. Texts are scanned whole. Without a model one is trained on a bounded sample of docs."""
    model = model or train(docs, id_col=id_col, text_col=text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            out = []
            for raw in as_bytes(batch.column(1)):
                spans = spans_of(raw, model)
                text = raw.decode() if spans else ""
                out.append([{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e]} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "secrets"])

    return texts_of(docs, id_col, text_col).mapInArrow(scan, "doc_id long, secrets array<struct<kind:string,start:long,end:long,value:string>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of scan_secrets()."""
    of = lambda kinds: F.filter("secrets", lambda x: x["kind"].isin(*kinds))
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(line(of(KINDS[:3])), 256).alias("base_sha256"),
        line(F.col("secrets")).alias("spans"),
        F.size(of(["random"])).cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, model: RandomStringModel | None = None, mark: str = "[SECRET]", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs, every secret in text_col replaced by mark and count_col (where there is one) counted anew; every row
    stays, with the columns of docs in their order. A null text stays null."""
    model = model or train(docs, text_col=text_col)
    names = docs.columns

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index(text_col)
            out, changed = [], {}
            for i, raw in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                spans = spans_of(raw, model) if raw else []
                text = None if raw is None else raw.decode()
                end = 0
                if spans:
                    parts = []
                    for s, _, e in spans:
                        if s >= end:
                            parts += [text[end:s], mark]
                        end = max(end, e)
                    text = "".join([*parts, text[end:]])
                    changed[i] = len(text)
                out.append(text)
            columns = batch.columns
            columns[at] = pa.array(out, columns[at].type)
            if count_col in names and changed:
                c = names.index(count_col)
                counts = columns[c].to_pylist()
                for i, n in changed.items():
                    counts[i] = n
                columns[c] = pa.array(counts, columns[c].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(mend, docs.schema)
