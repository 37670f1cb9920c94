"""The secret model of a corpus whose rows often hold keys of formats that no rule knows."""

import random
import string

import pytest

from gridloom.llm import secrets

ALNUM = string.ascii_letters + string.digits
FORMATS = {
    "ghp": lambda r: "ghp_" + "".join(r.choices(ALNUM, k=36)),
    "xoxb": lambda r: f"xoxb-{r.randrange(10**11, 10**12)}-{r.randrange(10**12, 10**13)}-" + "".join(r.choices(ALNUM, k=24)),
    "jwt": lambda r: "eyJ" + "".join(r.choices(ALNUM + "_-", k=80)),
    "lower": lambda r: "tok_" + "".join(r.choices(string.ascii_lowercase, k=32)),
}


@pytest.mark.parametrize("name", FORMATS)
def test_a_third_of_the_rows_holds_an_unknown_key(spark, name):
    rng = random.Random(4)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rows = [(k, t + " " + FORMATS[name](rng) if k % 3 == 0 else t) for k, t in enumerate(docs)]
    model = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(model.score(FORMATS[name](rng)) > model.threshold for _ in range(300)) >= 294
    plain = ["http_request_handler", "user-session-manager", "utf8_general_config", "getConnectionPoolSize"]
    assert not [x for x in plain if model.score(x) > model.threshold]


def test_planted_keys_in_documents(spark):
    """Keys of unknown formats inside whole texts: spans of the model alone, found where they were put; rule spans stay."""
    rng = random.Random(6)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect() if r.text]
    model = secrets.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = planted = extra = 0
    for k, t in enumerate(texts[:400]):
        words = t.split(" ")
        at = rng.randrange(len(words) + 1)
        key = FORMATS[sorted(FORMATS)[k % 4]](rng)
        before = "".join(w + " " for w in words[:at])
        spans = secrets.spans_of((before + key + " " + " ".join(words[at:])).encode(), model)
        mine = [(s, e) for s, kind, e in spans if kind == 3]
        planted += 1
        hit = (len(before), len(before) + len(key)) in mine
        found += hit
        extra += len(mine) - hit
        assert all(x in spans for x in secrets.base_spans(t.encode().decode()) if x[2] < len(before))
    assert found >= 0.95 * planted and extra <= 0.01 * planted, (found, planted, extra)


def test_many_keys_in_one_text():
    text = "é deadbeefdeadbeefdeadbeef password=hunter22x " * 20_000
    spans = secrets.spans_of(text.encode(), None)
    assert len(spans) == 40_000 and text[spans[-2][0] : spans[-2][2]] == "deadbeef" * 3
