"""The near-dedup stage against all pairs of five-word shingle sets, compared exactly."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_corpus import SCHEMA, SF, awkward, lower, words


def kept(rows):
    sets = []
    for _, t, _ in rows:
        w = words(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    stays = {i for k, (i, _, _) in enumerate(rows) if i == least.get(root(k))}
    return sorted((i is None, i or 0) for i, _, _ in rows if i in stays)


def edited():
    """Families of a text and copies of it with some words changed, similarities on both sides of 0.8."""
    rng = random.Random(12)
    rows = []
    for f in range(12):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        for _ in range(12):
            copy = list(text)
            for k in rng.sample(range(len(copy)), max(1, int(len(copy) * rng.random() * 0.04))):
                copy[k] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy), None, None, None, 0.0, "", 0))
    return rows


@pytest.mark.parametrize("which", ["table", "awkward", "edited", "empty"])
def test_stage(spark, which):
    made = {"awkward": awkward, "edited": edited, "empty": list}
    docs = spark.createDataFrame(made[which](), SCHEMA) if which in made else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, None) for r in docs.select("doc_id", "text").collect()]
    got = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == kept(rows)
