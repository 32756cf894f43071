import hashlib
import re

import pytest
from pyspark.sql import functions as F

from spanforge.functions.stats import bootstrap_interval, wilson
from spanforge.functions.text import char_ngrams, content_hash, cosine, count_tokens, l2_normalize, stable_hash, strip, union_length, word_tokens

TEXTS = ["Café 42 naïve", "", "  tabs\tand　wide  ", "漢字 かな!", "don’t stop… it’s 3.14", "a b c", "ONE_two 𝒌-nearest", "\x1c\x1d sep"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")


def by_id(df):
    return [r[1] for r in sorted(df.collect(), key=lambda r: r[0])]


def test_word_tokens(texts):
    got = by_id(texts.select("i", word_tokens(F.col("t"))))
    assert got[:-1] == [re.findall(r"[a-z0-9]+", t.lower()) for t in TEXTS] and got[-1] is None


def test_count_tokens_is_unicode(texts):
    got = by_id(texts.select("i", count_tokens(F.col("t"))))
    assert got == [len(re.findall(r"\w+|[^\w\s]", t)) for t in TEXTS] + [0]


def test_char_ngrams(texts):
    def expected(t):
        flat = re.sub(r"\s+", " ", t.lower()).strip()
        return [flat[i : i + n] for n in (3, 1) for i in range(len(flat) - n + 1)]

    got = by_id(texts.select("i", char_ngrams(F.coalesce("t", F.lit("")), (3, 0, 1))))
    assert got == [expected(t) for t in TEXTS] + [[]]


def test_strip(texts):
    assert by_id(texts.select("i", strip(F.col("t"))))[:-1] == [t.strip() for t in TEXTS]


def test_hashes(spark):
    row = spark.range(1).select(stable_hash(F.lit("d"), F.lit(3), F.lit("x")), content_hash(F.lit("é"))).first()
    assert row[0] == hashlib.sha256(b"d\x003\x00x\x00").hexdigest()
    assert row[1] == hashlib.sha256("é".encode()).hexdigest()


@pytest.mark.parametrize("iv,total", [([], 0), ([(0, 5)], 5), ([(0, 5), (5, 7)], 7), ([(3, 9), (0, 4), (2, 3)], 9), ([(0, 2), (8, 9)], 3)])
def test_union_length(spark, iv, total):
    df = spark.createDataFrame([(iv,)], "iv array<struct<s:int,e:int>>")
    assert df.select(union_length(F.col("iv"))).first()[0] == total


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(l2_normalize(F.col("a")), l2_normalize(F.col("z")), cosine(F.col("a"), F.col("z")), cosine(F.col("a"), F.col("a"))).first()
    assert r[0] == pytest.approx([0.6, 0.8]) and r[1] == [0, 0] and r[2] == 0 and r[3] == pytest.approx(1)


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 10), (2, 10, 10), (3, 5, 10)], "i int, x int, n int")
    got = by_id(df.select("i", wilson(F.col("x"), F.col("n"))))
    assert tuple(got[0]) == (0, 0)
    assert got[1]["lo"] == 0 and got[2]["hi"] == pytest.approx(1) and got[3]["lo"] == pytest.approx(0.2366, abs=1e-3)


def test_bootstrap_is_seeded_and_blocked():
    v = [0, 1, 1, 0, 1, 0.5, 0.25, 1]
    assert bootstrap_interval(v) == bootstrap_interval(v) and bootstrap_interval([]) == (0, 0)
    lo, hi = bootstrap_interval([1.0] * 5)
    assert lo == hi == 1
