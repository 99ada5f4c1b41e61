"""Repeated passages: brute force over all windows, odd rows, hot groups, and texts with no room for a window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from voxframe.llm import substrings, words

SCHEMA = "doc_id long, text string, h long, t1 long, copies int"


def brute(texts, window):
    split = [(t or "").encode().split() for t in texts]
    starts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i + j for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, window, base=8):
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], SCHEMA)
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeated(docs, window, base).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts, window)


@pytest.mark.parametrize("window,base", [(35, 8), (5, 2), (8, 8), (1, 8), (12, 3)])
def test_equals_brute_force(spark, window, base):
    rng = random.Random(window)
    word = lambda: rng.choice("a b c d ee ff é 日本 x.y Zz".split())
    passages = [[word() for _ in range(rng.randint(window, 3 * window))] for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [w for _ in range(rng.randint(0, 3)) for w in (rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.random()}" for _ in range(rng.randint(0, 30))])]
        for _ in range(rng.choice([0, 0, 1, 3])):
            if parts:
                parts[rng.randrange(len(parts))] = f"edit{rng.random()}"
        texts.append(rng.choice([" ", "\t", "\n "]).join(parts))
    check(spark, texts + texts[:5] + [None, "", " \t\n", "one", "a " * 200, "a b " * 100, "a\x1cb\x85c d " * 40], window, base)


def test_periodic_and_overlapping_windows(spark):
    run = [f"w{i}" for i in range(50)]
    check(spark, [" ".join(run), " ".join(run[7:43]), " ".join(run[20:] + run[:34]), "z " * 36, "y " * 35, " ".join(["p", "q", "r"] * 30)], 35)


def test_a_hot_passage_and_hot_copies_in_many_rows(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"own {i} {passage} end {i}" for i in range(1500)] + ["same text " * 30] * 1500 + [f"clean {i} text" for i in range(1500)]
    check(spark, texts, 35)


def test_nulls_repeated_ids_and_an_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(36))
    docs = spark.createDataFrame([(None, text, 0, 0, 0), (1, text, 0, 0, 0), (1, None, 0, 0, 0), (None, "short", 0, 0, 0)], SCHEMA)
    rows = substrings.remove_repeated(docs, 35).collect()
    assert sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in rows) == [(False, 0, 0), (False, 36, 36), (True, 1, 0), (True, 36, 36)]
    assert substrings.remove_repeated(docs.limit(0), 35).collect() == []


def test_a_text_of_a_million_words(spark):
    rng = np.random.default_rng(5)
    text = " ".join(map(str, rng.integers(0, 10**9, 1_000_000)))
    tail = " ".join(text.split()[-40:])
    docs = spark.createDataFrame([(0, text), (1, f"so {tail}")], "doc_id long, text string")
    assert sorted((r["n_words"], r["n_removed"]) for r in substrings.remove_repeated(docs, 35).collect()) == [(41, 40), (1_000_000, 40)]


def test_levels():
    assert substrings.levels(35) == [8, 16, 32, 35] and substrings.levels(8) == [8] and substrings.levels(3) == [3]


def test_word_hashes_equal_for_equal_words_only(monkeypatch):
    monkeypatch.setattr(words, "_CHUNK", 7)
    data = np.frombuffer("ab ba ab abab  a b é averylongword ab".encode(), np.uint8)
    starts, ends, row = words.spans(data, np.array([0, 10, len(data)]), words.NO_BLANK)
    told = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    assert told == [b"ab", b"ba", b"ab", b"a", b"bab", b"a", b"b", "é".encode(), b"averylongword", b"ab"] and row.tolist() == [0] * 4 + [1] * 6
    h = words.hashes(data, starts, ends).tolist()
    assert {(a == b) == (x == y) for a, x in zip(told, h, strict=True) for b, y in zip(told, h, strict=True)} == {True}
