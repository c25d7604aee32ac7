"""License scan against plain Python containment."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from vigilog.llm import licenses as s


def shingles(text):
    words = [w.lower() for w in re.findall("[A-Za-z0-9]+", text or "")]
    return [tuple(words[i : i + 3]) for i in range(len(words) - 2)]


def expected(docs, templates=s.TEMPLATES):
    out = []
    for doc, text in docs:
        own = shingles(text)
        for name, template in templates:
            places = shingles(template)
            wanted, reach, best = set(places), math.ceil(len(places) * s.STRETCH), None
            hits = [i for i, x in enumerate(own) if x in wanted]
            for i in hits:
                inside = [j for j in range(i, min(i + reach, len(own))) if own[j] in wanted]
                best = max(best or (0,), (len({own[j] for j in inside}), -i, inside[-1] + 2))
            if best and best[0] >= s.CONTAINED * len(wanted):
                out.append((doc, name, best[0], len(wanted), -best[1], best[2]))
    return sorted(out, key=str)


NAMES = ["doc_id", "license", "n_matched", "n_shingles", "first_word", "last_word"]
MIT = dict(s.TEMPLATES)["MIT-permission"]


@pytest.mark.parametrize(
    "docs",
    [
        [],
        [(1, None), (2, ""), (3, "MIT"), (None, "released UNDER the mit licence"), (4, "x " * 20000 + "Released under the MIT License. y")],
        [(1, "a " + MIT.upper() + " b"), (1, "a " + MIT + " b"), (2, MIT[:150]), (3, MIT.replace("copy, modify,", "COPY; change;").replace(" of charge", "")), (4, " ".join(t for _, t in s.TEMPLATES) * 3)],
    ],
)
def test_small(spark, docs):
    df = spark.createDataFrame([(d, t, "L") for d, t in docs], "doc_id long, text string, license string")
    got = sorted((tuple(r[n] for n in NAMES) for r in s.licenses(df).collect()), key=str)
    assert got == expected(docs)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r[n] for n in NAMES) for r in s.licenses(docs).collect()), key=str)
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_scattered_shingles_are_no_notice(spark):
    words = re.findall("[A-Za-z0-9]+", MIT)
    apart = " ".join(" ".join(words[i : i + 3]) + " x" * 9 for i in range(len(words) - 2))
    df = spark.createDataFrame([(1, apart), (2, apart + " " + MIT)], "doc_id long, text string")
    got = sorted(tuple(r[n] for n in NAMES) for r in s.licenses(df).collect())
    assert got == expected([(1, apart), (2, apart + " " + MIT)]) and [x[:2] for x in got] == [(2, "MIT-permission")]


def test_notices_at_every_place_of_long_texts(spark):
    """The shortest and the longest templates, whole and with changed words, anywhere in random words."""
    draw = random.Random(3)
    filler = [f"w{i}" for i in range(5000)]
    docs = []
    for i in range(600):
        name, text = draw.choice(s.TEMPLATES)
        words = text.split()
        if i % 3 == 0 and len(words) > 40:
            words[draw.randrange(len(words))] = "changed"
        at = draw.randrange(400)
        docs.append((i, " ".join([*draw.choices(filler, k=at), *words, *draw.choices(filler, k=draw.randrange(300))])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r[n] for n in NAMES) for r in s.licenses(df).collect()), key=str)
    assert got == expected(docs) and len({x[0] for x in got}) == 600


def test_minima_of_bands(spark):
    """The least of each band, against plain Python."""
    draw = random.Random(4)
    windows = [[draw.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 30, 400)] + [[5, 5, -1, -1]]
    rows = spark.createDataFrame(list(enumerate(windows)), "i int, w array<long>").select("i", s._minima(F.col("w")).alias("m")).collect()
    for r in rows:
        least = {}
        for h in windows[r["i"]]:
            band = (h % 2**64) >> (64 - s.BAND_BITS)
            least[band] = min(least.get(band, h), h)
        assert sorted(r["m"]) == sorted(least.values())


def test_short_template_is_refused(spark):
    with pytest.raises(ValueError):
        s.template_tables(spark, [("x", "two words")])
