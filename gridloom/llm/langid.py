"""Language ID: language family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, bounded_sample, crc_of, segment_sums, slices, texts_of

#: ISO 639-1 codes by family; a language not listed is a family of its own. Fixed values.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "rm", "la"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be", "bs"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "celtic": ("ga", "cy", "gd", "br"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk", "tt"),
    "indo-aryan": ("hi", "bn", "mr", "gu", "pa", "ne", "ur", "si"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "mt", "am"),
}
_FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs}
_LATIN = re.compile("[A-Za-z]")
BINS = 4096
_FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L (number signs such as ² or Ⅷ are not)."""
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def bins_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-cased bytes (anything but letters is a space) of every text, one after the other,
    and how many each text has (as many as its bytes: a space stands before and after)."""
    low = [r.decode().lower().encode() for r in raws]
    lengths = np.array([len(x) for x in low], dtype=np.int64)
    x = _FOLD[np.frombuffer(b" " + b"  ".join(low) + b"  ", dtype=np.uint8)]
    code = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    bins = (code * np.uint32(2654435761) >> np.uint32(20)).astype(np.int32)
    own = np.ones(len(bins), dtype=bool)
    ends = np.cumsum(lengths + 2)
    for back in (1, 2):  # trigrams that begin after the last byte of a text
        at = ends - back
        own[at[at < len(own)]] = False
    return bins[own], lengths


@dataclass(frozen=True)
class Machine:
    """One linear decision: positive for the first class. scale and shift turn margins into probabilities."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float


def train_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-3, rounds: int = 150) -> Machine:
    """Squared hinge, L2 penalty, classes weighted evenly, by accelerated gradient steps; then a logistic curve over
    the margins. y: +1 or -1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, c = w.copy(), b
    step = 0.5 / (float((share[:, None] * x * x).sum()) + 1 + reg)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v + c))
        pull = 2 * share * slack * y
        w2, b2 = v - step * (reg * v - x.T @ pull), c + step * float(pull.sum())
        v, c = w2 + t / (t + 3) * (w2 - w), b2 + t / (t + 3) * (b2 - b)
        w, b = w2, b2
    m = x @ w + b
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    s, o = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(s * m + o, -30, 30)))
        g, h = p - target, p * (1 - p) + 1e-6
        a = np.array([[float((h * m * m).sum()) + 1e-3, float((h * m).sum())], [float((h * m).sum()), float(h.sum()) + 1e-3]])
        ds, do = np.linalg.solve(a, [float((g * m).sum()), float(g.sum())])
        s, o = s - float(np.clip(ds, -2, 2)), o - float(np.clip(do, -2, 2))
    return Machine(w, b, max(s, 1e-3), o)


@dataclass(frozen=True)
class LanguageModel:
    """families: name -> languages; machines: (first, second) -> decision, for families and for languages alike."""

    families: dict
    machines: dict

    def predict(self, raws: list[bytes | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(raws), [0.0] * len(raws)
        at = [i for i, r in enumerate(raws) if r and has_letter(r.decode())] if self.families else []
        for a, b in slices([len(raws[i]) for i in at], 2_000_000):
            for i, (lang, score) in zip(at[a:b], self._choose([raws[i] for i in at[a:b]]), strict=True):
                langs[i], scores[i] = lang, score
        return langs, scores

    def _choose(self, raws: list[bytes]) -> list[tuple[str, float]]:
        bins, lengths = bins_of(raws)
        n = np.maximum(lengths, 1)
        p = {}
        for pair, m in self.machines.items():
            margin = segment_sums(m.weights[bins], lengths) / n + m.bias
            p[pair] = 1 / (1 + np.exp(-np.clip(m.scale * margin + m.shift, -30, 30)))
        names, sure = _vote(list(self.families), p, len(raws))
        out = []
        inner = {f: _vote(langs, p, len(raws)) for f, langs in self.families.items()}
        for i, f in enumerate(names):
            lang, q = inner[f][0][i], inner[f][1][i]
            out.append((lang, float(sure[i] * q)))
        return out


def _vote(names: list[str], p: dict, n: int) -> tuple[list[str], np.ndarray]:
    """The name with most pairwise wins (ties: larger summed probability, then the earlier name), and its mean
    probability over its pairs."""
    wins, total = np.zeros((len(names), n)), np.zeros((len(names), n))
    for a, b in combinations(range(len(names)), 2):
        q = p[names[a], names[b]]
        wins[a] += q >= 0.5
        wins[b] += q < 0.5
        total[a] += q
        total[b] += 1 - q
    best = np.argmax(wins * 1e6 + total, axis=0)
    mean = total[best, np.arange(n)] / max(1, len(names) - 1) if len(names) > 1 else np.ones(n)
    return [names[i] for i in best], mean


def fit(features: np.ndarray, langs: list[str]) -> LanguageModel:
    """features: relative frequencies of the bins. Columns are scaled by their root mean, which the weights take in."""
    if not langs:
        return LanguageModel({}, {})
    kinds = sorted(set(langs))
    families = {f: [x for x in kinds if family(x) == f] for f in sorted({family(x) for x in kinds})}
    scale = (1 / np.sqrt(features.mean(axis=0) + 1e-5)).astype(np.float32)
    x, machines = features * scale, {}
    own = np.array([family(y) for y in langs])
    each = np.array(langs)
    for names, labels in ((list(families), own), *((v, each) for v in families.values())):
        for a, b in combinations(names, 2):
            pick = (labels == a) | (labels == b)
            m = train_svm(x[pick], np.where(labels[pick] == a, 1.0, -1.0).astype(np.float32))
            machines[a, b] = Machine((m.weights * scale).astype(np.float32), m.bias, m.scale, m.shift)
    return LanguageModel(families, machines)


def train(docs: DataFrame, held_mod: int = 4, held_rest: int = 2, max_train_docs: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from labelled documents alone whose crc32 of the id's text doesn't leave held_rest, at most
    max_train_docs of them, chosen by a hash of the id; their whole texts count."""
    usable = texts_of(docs, id_col, text_col, F.col(lang_col).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % held_mod != held_rest)
    )
    known = bounded_sample(usable, max_train_docs)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, bins, shares = [], [], []
            for raw, lang in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                b, n = bins_of([raw])
                if n[0] and has_letter(raw.decode()):
                    count = np.bincount(b, minlength=BINS)
                    at = np.flatnonzero(count)
                    langs.append(lang)
                    bins.append(at.astype("<i4").tobytes())
                    shares.append((count[at] / n[0]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(bins, pa.binary()), pa.array(shares, pa.binary())], names=["lang", "bins", "shares"])

    rows = sorted(known.mapInArrow(vectors, "lang string, bins binary, shares binary").collect(), key=lambda r: (r.lang, bytes(r.bins), bytes(r.shares)))
    features = np.zeros((len(rows), BINS), np.float32)
    for i, r in enumerate(rows):
        features[i, np.frombuffer(r.bins, "<i4")] = np.frombuffer(r.shares, "<f4")
    return fit(features, [r.lang for r in rows])


def identify(docs: DataFrame, model: LanguageModel | None = None, held_mod: int = 4, held_rest: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred and score (0 to 1).

    `und` with score 0 where the text is null or has no letter, or where nothing could be learned. Whole texts are
    read; repeated rows get the same result; null ids count as the empty string for held_out; other columns are
    ignored. Without a model one is trained, on at most the bounded sample of train()."""
    model = model or train(docs, held_mod, held_rest, id_col=id_col, text_col=text_col, lang_col=lang_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = model.predict(as_bytes(batch.column(1)))
            held = [c % held_mod == held_rest for c in crc_of(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return texts_of(docs, id_col, text_col).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel | None = None, least: float = 0.0, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is determined with a score of at least `least`; a null language becomes the
    predicted one, other columns are unchanged."""
    model = model or train(docs, text_col=text_col, lang_col=lang_col)
    names = docs.columns
    at, label = names.index(text_col), names.index(lang_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = model.predict(as_bytes(batch.column(at)))
            columns = batch.columns
            old = columns[label].to_pylist()
            columns[label] = pa.array([p if o is None else o for o, p in zip(old, langs, strict=True)], columns[label].type)
            stays = pa.array([p != "und" and s >= least for p, s in zip(langs, scores, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(stays)

    return docs.mapInArrow(keep, docs.schema)
