"""Operators do the whole job: every row, word and character counts, whatever the order and the size of the others."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.llm import decontamination, fingerprints, jaccard, langid, toxicity


def test_characters_of_rare_and_unlabelled_words_are_learned(spark):
    letters = "abcdefghijklmnopqrst"
    common = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in letters[:5])  # 40,000 words
    docs = spark.createDataFrame([(0, common), (1, common), (2, "zyqxv")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, label int")
    chars = toxicity.fit_toxicity(docs, labels).chars
    assert chars.log_prob("zyq", "x") > chars.log_prob("zyq", "a")
    assert chars.counts["zyqx"] == 1 and chars.totals["zyq"] == 1


def test_a_long_document_leaves_room_for_other_languages(spark):
    rows = [(0, "aba " * 800_000, "x"), *((i, "bab ccb", "y") for i in range(1, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    assert langid.fit_languages(docs, ["▁", "a", "b", "c", "ab"]).languages == ["x", "y"]


def test_long_runs_of_letters_are_learned():
    model = langid.fit_pieces({"x": Counter({"▁" + "ab" * 60: 3}), "y": Counter({"▁" + "cd" * 60: 3})}, ["▁", "a", "b", "c", "d"])
    assert model.languages[model.log_likelihood(["▁cdc"])[0].argmax()] == "y" and model.prob[3, 1] > 10 * model.prob[3, 0]


@pytest.mark.parametrize("written", ["iddiot", "i_d_i_o_t", "id.iot", "idi-ot", "hello,1d10t", "x" * 60 + ".1d10t"])
def test_every_run_with_a_second_path_is_decoded(written):
    model = toxicity.CharModel(Counter({"idiot": 50, "hello": 50, "the": 90, "and": 60, "other": 9}))
    assert "idiot" in toxicity.Restorer(model).words(written)


@pytest.mark.parametrize("written,word", [("you a s s there", "ass"), ("you i  d  i  o  t there", "idiot")])
def test_short_and_wide_spaced_words_are_joined(written, word):
    model = toxicity.CharModel(Counter({"idiot": 5, "ass": 9, "the": 50, "you": 20}))
    assert word in toxicity.Restorer(model).spaced(written)


def test_rows_without_an_id_are_searched(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(None, f"so {item} it is"), (None, "clean words"), (0, "clean words"), (0, f"so {item} it is"), (None, "brief note")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "brief note")], "item_id int, text string")
    rows = decontamination.find_benchmark(docs, items).collect()
    assert sorted((r["doc_id"] is None, r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in rows) == [
        (False, 2, 0, ()), (False, 14, 11, ("1",)), (True, 2, 0, ()), (True, 2, 2, ("2",)), (True, 14, 11, ("1",)),
    ]


def test_decoding_equals_brute_force_over_all_paths():
    model = toxicity.CharModel(Counter({"idiot": 50, "scum": 20, "loser": 9, "too": 30, "to": 60, "the": 90}))

    def paths(run, i):
        if i == len(run):
            yield "", 0.0
            return
        for rest, cost in paths(run, i + 1):
            for out, own in toxicity._offers(run, i, -2.5, -1.0, -1.5):
                yield out + rest, cost + own

    def score(text, cost):
        if text.startswith(" ") or "  " in text:
            return -1e9
        seen = " "
        for ch in text + " ":
            cost += model.log_prob(seen, ch)
            seen += ch
        return cost

    for run in ("1d10t", "iddiot", "s_c_u_m", "tto0", "l0-ser", "too", "a1!b"):
        best = max(score(t, c) for t, c in paths(run, 0))
        got = toxicity.decode(run, model, beam=10_000)
        assert max(score(t, c) for t, c in paths(run, 0) if t == got) == pytest.approx(best)


def test_grams_by_brute_force():
    words = {"idiot": 5, "été": 2, "a": 9}
    want = Counter()
    for w, n in words.items():
        s = f" {w} "
        for i in range(1, len(s)):
            for at in range(max(0, i - 3), i + 1):
                want[s[at : i + 1]] += n
    assert toxicity.CharModel(words).counts == want


@pytest.mark.parametrize("written,word", [("sc\u200bum", "scum"), ("stuupid", "stupid"), ("iidiioott", "idiot"), ("stu_pid", "stupid"), ("s_c_u_m", "scum")])
def test_listed_disguises(written, word):
    model = toxicity.CharModel(Counter({"idiot": 50, "scum": 20, "stupid": 20, "the": 90, "and": 60, "other": 9}))
    assert word in toxicity.Restorer(model).words(written)
    assert "idiot" in toxicity.Restorer(model).spaced("you\ni\nd\ni\no\nt there")


def test_fits_do_not_depend_on_the_layout(spark):
    rows = [(i, f"word{i % 7} zz{i % 5} 1d10t {'idiot' if i % 3 else 'fine'} " * 3, "ab"[i % 2], int(i % 3 > 0)) for i in range(300)]
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, label int")
    found = []
    for order in (rows, sorted(rows, key=lambda r: (r[2], -r[0]))):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, label int").repartition(5, "lang") if order is not rows else spark.createDataFrame(order, "doc_id long, text string, lang string, label int").coalesce(1)
        model = toxicity.fit_toxicity(docs, labels, most=100)
        lang = langid.fit_languages(docs, ["▁", "w", "o", "r", "d", "wo"], most=40)
        found.append((model.chance, model.base, model.chars.counts, lang.prob.round(12).tolist()))
    assert found[0] == found[1]


def test_rare_languages_are_learned(spark):
    rows = [(i, "bab ccb", "y") for i in range(5000)] + [(9000, "aba", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit_languages(docs, ["▁", "a", "b", "c", "ab"], most=20).languages == ["x", "y"]
    ids = langid.language_sample(docs, 20).join(docs, "doc_id").groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in ids} == {"x": 1, "y": 20}


@pytest.mark.parametrize("text", ["½ ² Ⅷ ① 12 _ -", "", "\u0301", None])
def test_texts_without_a_letter_are_und(spark, text):
    docs = spark.createDataFrame([(0, "abc", "x"), (1, text, "x")], "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, ["▁", "a", "b", "c"])
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(docs, model).collect()} == {0: "x", 1: "und"}


def test_a_long_word_alone_has_the_score_it_has_among_others():
    model = langid.fit_pieces({"x": Counter({"▁abab": 3}), "y": Counter({"▁ba": 2})}, ["▁", "a", "b", "ab", "aba"])
    word = "▁" + "abba" * 100
    assert model.log_likelihood([word])[0] == pytest.approx(model.log_likelihood([word, word[::-1]])[0])


def test_an_item_with_two_texts_is_named_once(spark):
    one, two = "a b c d e f g h i j k", "l m n o p q r s t u v"
    docs = spark.createDataFrame([(1, f"x {one} y {two}"), (None, f"{two} {one}"), (2, "the end of it"), (3, "the end")], "doc_id long, text string")
    items = spark.createDataFrame([("a", one), ("a", two), ("b", one), ("c", "The end of"), ("d", "of it"), ("e", "end")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in decontamination.find_benchmark(docs, items).collect()}
    assert got == {1: (22, ["a", "b"]), None: (22, ["a", "b"]), 2: (4, ["c", "d", "e"]), 3: (1, ["e"])}


def test_groups_come_from_bytes_in_equal_buckets(spark, monkeypatch):
    rows = [(3, "Straße"), (1, "STRASSE"), (2, "other"), (5, "Other "), (4, "alone"), (None, "alone"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(3, 1), (1, 1), (2, 2), (5, 2), (4, 4), (None, 4), (None, None)}
    assert {(r["doc_id"], r["group_id"]) for r in fingerprints.edited_likeness(docs).collect()} == want
    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.lit("0" * 32))  # every text in one bucket
    assert {(r["doc_id"], r["group_id"]) for r in fingerprints.edited_likeness(docs).collect()} == want


def test_words_have_hashes_of_their_own():
    text = b"  Foo bar\tBAZ foo \x1c \x0b" + b"x" * 300 + b" "
    h = jaccard.word_hashes(text)
    assert len(h) == 6 and h[0] == h[3] and len(set(h.tolist())) == 5
    long = " ".join(f"w{i}" for i in range(700_000)).encode()  # in several parts
    assert len(jaccard.word_hashes(long)) == len(set(jaccard.word_hashes(long).tolist())) == 700_000


def test_prefixes_follow_the_order():
    rng = np.random.default_rng(3)
    token = np.unique(rng.integers(0, 2**64, 500, np.uint64))
    often = rng.integers(2, 9, len(token))
    order = jaccard.PrefixOrder(token, often)
    for share in (0.0, 0.5, 1.0):
        s = np.unique(np.concatenate((rng.choice(token, int(200 * share)), rng.integers(0, 2**64, int(200 * (1 - share)), np.uint64))))
        count = dict(zip(token.tolist(), often.tolist()))
        want = sorted(s.tolist(), key=lambda x: (count.get(x, 0), x))[: jaccard.prefix_length(len(s))]
        assert order.prefix(s).tolist() == want


def test_rare_grams_beyond_the_dictionary_keep_their_counts(spark, monkeypatch):
    docs = spark.createDataFrame([("the nation and the others",), ("über naïve façade 東京都 the",), ("zyqx the",)], "text string")
    whole = toxicity.fit_chars(docs)
    counts, totals = dict(whole.counts), dict(whole.totals)
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 7)
    part = toxicity.fit_chars(docs)
    assert {k: part.counts.get(k, 0) for k in counts} == counts
    assert {k: part.totals.get(k, 0) for k in totals} == totals
    assert len(part.counts) == 7 and part.counts.get("zzz", 0) == 0
    assert part.log_prob(" zy", "q") == whole.log_prob(" zy", "q")


def test_the_language_model_learns_from_every_position(spark, monkeypatch):
    from voxframe.llm import lm

    made, keep = {}, lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: made.setdefault(name, keep(df, name)))
    docs = spark.createDataFrame([(i, f"the cat {i} sat on mat {i % 7} and ran") for i in range(300)], "doc_id long, text string").repartition(3)
    counts = keep(lm.corpus_counts(docs), "lm-counts")
    monkeypatch.setattr(lm, "drop", lambda df: None)
    lm.fit_lm(docs, counts)
    assert made["lm-nets"].selectExpr("sum(n)").first()[0] == 300 * 10  # nine words and the end
