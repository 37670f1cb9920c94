"""Licence notices wrapped, inline, damaged and among prose of their own words; and the gate against scoring all."""

import random
import textwrap

import pytest

from gridloom.llm import license

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return license.train(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect() if r.text]



def test_prose_with_the_words_of_notices():
    prose = [f"Chapter {k} tells how the band was licensed and the record released while under way with no license." for k in range(300)]
    model = license.fit(prose)
    for text, family in (("Released under the MIT License.", "mit"), ("Licensed under CC BY 4.0.", "cc-by")):
        assert [x[0] for x in model.scan(("Intro.\n" + text + "\nEnd.").encode())[1]] == [family]
    assert not any(model.scan(x.encode())[1] for x in prose)


def test_three_lines_of_prose_take_no_notice_away():
    model = license.fit(["the mit campus released a report", "licensed drivers hold a license", "software under study"])
    for text in ("Released under the MIT License.", "Licensed under the MIT License."):
        assert [x[0] for x in model.scan(text.encode())[1]] == ["mit"]


@pytest.mark.parametrize("width", [40, 60, 76])
def test_wrapped_notices_are_one_span(model, texts, width):
    for name in ("apache", "mit", "gpl"):
        for t in license.TEMPLATES[name]:
            if len(t) > 100:
                notice = "\n".join(textwrap.wrap(t, width))
                for before, after in (("", ""), ("A line é.\n\n", "\n\nMore of it."), (texts[3].replace("\n\n", "\n") + "\n", "\n" + texts[5])):
                    n = len(before)
                    assert [x[:3] for x in model.scan((before + notice + after).encode())[1] if x[1] < n + len(notice) and x[2] > n] == [(name, n, n + len(notice))]


def test_planted_notices(model, texts):
    rng, found, planted = random.Random(3), 0, 0
    for name, notices in license.TEMPLATES.items():
        for t in notices:
            for _ in range(8):
                words = t.split()
                if len(words) > 8:  # reworded: a tenth of the words changed
                    for k in rng.sample(range(len(words)), len(words) // 10):
                        words[k] = rng.choice(("the", "this", "any", "such"))
                notice = "\n".join(textwrap.wrap(" ".join(words), rng.choice((50, 70, 200))))
                lines = rng.choice(texts).split("\n")
                k = rng.randrange(len(lines) + 1)
                gap = rng.choice(("\n", "\n\n"))
                before, after = "\n".join(lines[:k]) + gap, gap + "\n".join(lines[k:])
                spans = model.scan((before + notice + after).encode())[1]
                planted += 1
                found += any(f == name and s < len(before) + len(notice) and e > len(before) for f, s, e, _ in spans)
    assert found >= 0.9 * planted, (found, planted)


def test_gate_takes_nothing_away(model, texts):
    rng = random.Random(5)
    every = [t for of in license.TEMPLATES.values() for t in of]
    for k, t in enumerate(texts[:300]):
        t += ("\n", "\n\n", " ")[k % 3] + "\n".join(textwrap.wrap(license.noisy(rng.choice(every), rng), 50))
        assert model.scan(t.encode()) == model.scan(t.encode(), gate=False)
