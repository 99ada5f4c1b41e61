"""Importance resampling: brute force with plain counters, n-grams, the dictionary's two ways, odd rows."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import pytest

from voxframe.llm import importance

SCHEMA = "doc_id long, text string, row long, n long, feature string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def features(text, least, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, least, most, buckets, seed, least_words, percent):
    mine = [features(t, least, most) for _, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, fs in mine for f in fs), Counter(bucket(f) for x in target for f in features(x, least, most)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000.0 * math.log(float(t[b] + 1) * (all_s + buckets) / (float(s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for (i, _), (n, fs) in zip(docs, mine, strict=True):
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    can = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(can[: len(can) * percent // 100]):
        r[4] = k + 1
    return sorted(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("least,most,head", [(1, 1, 200_000), (1, 1, 20), (1, 3, 30), (2, 2, 0)])
def test_equals_brute_force(spark, monkeypatch, least, most, head):
    monkeypatch.setattr(importance, "HEAD", head)
    rng = random.Random(3)
    words = ["the", "The", "of", "a1", "é", "日本", "x" * 300, *(f"w{i}" for i in range(200))]
    text = lambda n: "".join(rng.choice(words[: rng.choice([7, 207])]) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)] + [(200, None), (201, ""), (202, "?! ..."), (203, "one")]
    docs += [(300 + i, "the same words here " * 6) for i in range(20)]
    target = [text(40) for _ in range(5)] + [None, ""]
    table = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], SCHEMA)
    got = importance.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), least, most, 50, 7, 5, 30)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == brute(docs, target, least, most, 50, 7, 5, 30)


def test_nulls_repeated_rows_ties_and_empty_tables(spark):
    rows = [(None, "a b c", 0, 0, ""), (None, "a b c", 0, 0, ""), (5, "a b c", 0, 0, ""), (5, "a b c", 0, 0, ""), (6, None, 0, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "text string")
    got = importance.resample(docs, none, least_words=0, percent=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
    assert len({(r["weight"], r["score"]) for r in got if r["doc_id"] == 5}) == 1 and {r["n_features"] for r in got} == {0, 3}
    assert importance.resample(docs.limit(0), none).collect() == []
