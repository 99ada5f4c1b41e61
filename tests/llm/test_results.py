"""Results against brute force, oracles and held-out labels on small tables."""

import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from voxframe.llm import decontamination, fingerprints, jaccard, langid, packing, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return queries.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", ["op3_decontamination", "op9_chat_format"])
def test_sql_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)


def test_shards(spark, texts):
    rows = result(spark, "op1_sharding")
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    places = {}
    for r in rows:
        places.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in places.values())


def test_a_group_larger_than_a_shard_is_cut_as_little_as_can_be(spark):
    df = spark.createDataFrame([(i, "copy" if i < 500 else f"text {i}") for i in range(1000)], "doc_id long, text string")
    rows = sharding.shard_documents(df, 4).collect()
    assert Counter(r["shard"] for r in rows) == {s: 250 for s in range(4)}
    assert len({r["shard"] for r in rows if r["doc_id"] < 500}) == 2


def test_without_room_linked_pairs_swap_shards(spark):
    df = spark.createDataFrame([(i, f"text {i // 2}") for i in range(800)], "doc_id long, text string")
    rows = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, 4).collect()}
    assert Counter(rows.values()) == {s: 200 for s in range(4)}
    assert all(rows[2 * i] == rows[2 * i + 1] for i in range(400))


@pytest.mark.parametrize("members,groups,shards,least", [(4, 240, 24, 0), (3, 240, 24, 0), (7, 100, 7, 0), (30, 20, 24, 20)])
def test_groups_are_cut_as_little_as_can_be(spark, members, groups, shards, least):
    df = spark.createDataFrame([(i, f"text {i // members}") for i in range(members * groups)], "doc_id long, text string")
    places = {}
    for r in sharding.shard_documents(df, shards).collect():
        places.setdefault(r["doc_id"] // members, set()).add(r["shard"])
    size = members * groups / shards
    # with whole groups in every shard none need be cut, else one at a part's end
    assert sum(len(s) > 1 for s in places.values()) <= (0 if size % members == 0 else max(least, shards - 1))


@pytest.mark.parametrize("written,word", [("1d10t", "idiot"), ("l0ser", "loser"), ("tra$h", "trash"), ("stuuuupid", "stupid"), ("s.c.u.m", "scum"), ("p4th3tic", "pathetic")])
def test_restored_words(written, word):
    model = toxicity.CharModel(Counter({"idiot": 5, "loser": 5, "trash": 5, "stupid": 5, "scum": 5, "pathetic": 5, "the": 90, "and": 60, "other": 9}))
    assert word in toxicity.Restorer(model).words(written)


def test_spaced_letters_are_joined():
    model = toxicity.CharModel(Counter({"idiot": 5, "the": 50, "you": 20}))
    assert "idiot" in toxicity.Restorer(model).spaced("you i d i o t there")


def test_clean_decoration_stays_clean():
    model = toxicity.CharModel(Counter({"the": 50, "nation": 20}))
    assert toxicity.Restorer(model).words("nation$$$") == ("nation",)


def _held_out(spark, name, column):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in queries.queries()[name](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    return np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows])


def test_toxicity_held_out(spark):
    assert _held_out(spark, "op2_toxicity", "toxic") > 0.95


def test_quality_held_out(spark):
    assert _held_out(spark, "op7_quality", "quality") > 0.95


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in result(spark, "op6_language_id") if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.95


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "▁", "▁a"]
    model = langid.fit_pieces({"x": Counter({"▁abab": 3, "▁ba": 2}), "y": Counter({"▁bbb": 4})}, pieces)

    def brute(w, col):
        if not w:
            return 1.0
        return sum(model.prob[model.index[w[:k]], col] * brute(w[k:], col) for k in range(1, len(w) + 1) if w[:k] in model.index)

    for word in ("▁abab", "▁aba", "▁b" + "ab" * 40):
        got = model.log_likelihood([word])[0]
        if len(word) < 12:
            assert got == pytest.approx([math.log(brute(word, c)) for c in range(2)])
        assert np.isfinite(got).all()


def test_benchmark_windows_by_brute_force(spark):
    rng = random.Random(4)
    item = [rng.choice("abcdefgh") for _ in range(25)]
    texts = []
    for _ in range(60):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            at, n = rng.randrange(0, 16), rng.randrange(5, 25)
            words += item[at : at + n] + [rng.choice("abcdefgh") for _ in range(5)]
        texts.append(words)
    items = [item, item[:9], ["a", "b"]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontamination.find_benchmark(df, bench).collect()}
    for i, w in enumerate(texts):
        hit, ids = set(), set()
        for k, it in enumerate(items):
            m = min(10, len(it))
            windows = {tuple(it[s : s + m]) for s in range(len(it) - m + 1)}
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit.update(range(s, s + m))
                    ids.add(str(k))
        assert got[i] == (len(w), len(hit), sorted(ids))


def test_edited_texts(spark, texts):
    order = sorted(texts)
    rows = {r["doc_id"]: r for r in result(spark, "op4_exact_digest")}
    for i, k in enumerate(order):
        t, nxt = texts[k], texts[order[(i + 1) % len(order)]]
        half = len(t) // 2
        assert rows[k]["n_chars"] == len(t)
        assert rows[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    by_text = {}
    for k, t in texts.items():
        by_text.setdefault(t, set()).add(rows[k]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_canonical_forms_meet(spark):
    forms = ["Straße  é\n", "STRASSE é", " strasse é ", "ﬁn", "FIN", "other"]
    df = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    got = [r["fingerprint"] for r in fingerprints.with_fingerprint(df).orderBy("doc_id").collect()]
    assert got[0] == got[1] == got[2] and got[3] == got[4] and len(set(got)) == 3
    assert {(r["group_id"], r["n"]) for r in fingerprints.canonical_groups(df).collect()} == {(0, 3), (3, 2)}
    assert unicodedata.normalize("NFC", "é") == "é"


def test_lm_base_by_brute_force_and_better_on_new_texts(spark, texts):
    def tokens(t):
        return t.encode().lower().split() + [b""]

    count = Counter(w for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    rows = result(spark, "op5_lm_score")
    for r in rows:
        w = tokens(texts[r["doc_id"]])
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(x in count for x in w) and r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w))
    new = [r for r in rows if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in new) > 0.17 * sum(r["n_tokens"] for r in new)


def test_net_is_normalised_and_learns_an_order():
    from voxframe.llm import lm

    words = [b"", *(f"w{i}".encode() for i in range(40))]
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{(s + i) % 40}" for i in range(30)).encode() for s in rng.integers(0, 40, 300)]  # each word follows its own
    net = lm._start(words, np.ones(len(words) + lm.TAILS), texts)
    for _ in lm._learned(net, words, [pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])], 1, passes=30):
        pass
    near = net.number[5]
    p = 10 ** net.log_probs(np.full(len(net.number), net.number[4]), np.full(len(net.number), near), net.number)
    assert p.sum() == pytest.approx(1, abs=1e-4)
    assert p.argmax() == 6


def test_lm_probabilities_by_brute_force(spark):
    """Scores equal the sum over tokens of the net's probability and the share in the kind, computed word by word."""
    from voxframe.llm import lm

    texts = ["a b c d", "a b c e rare", "", None, "b b B unknownword"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = lm.corpus_counts(df.where("doc_id < 4")).persist()
    model = lm.fit_lm(df.where("doc_id < 4"), counts)
    got = {r["doc_id"]: r["score"] for r in lm.score_lm(df, counts, model).collect()}
    numbers = lm.WordNumbers(model.words, model.net.number)
    count = {bytes(r["word"]): r["n"] for r in counts.collect()}
    for i, t in enumerate(texts):
        far = near = numbers[b""]
        total = 0.0
        for w in [*(t or "").lower().encode().split(), b""]:
            m, k = model.net.params, numbers[w]
            h = m["p"][0] * m["r"][far] + m["p"][1] * m["r"][near]
            c = k // model.net.size
            of_class = np.exp((m["qc"] @ h + m["bc"]).astype(float))
            own = slice(c * model.net.size, (c + 1) * model.net.size)
            of_word = np.exp((m["q"][own] @ h + m["b"][own]).astype(float))
            total += math.log10(of_class[c] / of_class.sum()) + math.log10(of_word[k - c * model.net.size] / of_word.sum())
            if w not in numbers:
                total += math.log10((count.get(w, 0) + 1) / model.kind_parts[lm.tail_kind(w)])
            far, near = near, k
        assert got[i] == pytest.approx(total, abs=1e-4)


def _components(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    texts = {}
    for i in range(220):
        words = list(base) if i % 2 else [rng.choice(vocabulary) for _ in range(rng.randrange(0, 90))]
        if i % 2:
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif i % 4 == 0:
            words += base[:30]
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {k: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for k, w in ((k, t.split()) for k, t in texts.items())}
    want = _components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in texts}


def test_packing_round_trip(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = result(spark, "op10_best_fit_packing")
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for k, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(by[k], key=lambda r: r["piece"])
        assert sum(p["length"] for p in parts) == len(ids)
        assert all(zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in parts)
    least = math.ceil(sum(r["length"] for r in rows) / 4096)
    assert len({r["sequence_id"] for r in rows}) <= least * 1.05 + 1


def test_sum_of_squares_fills_bins():
    lengths = np.array([3, 7, 5, 5, 2, 8, 10, 1, 9])
    bins, offsets = packing.sum_of_squares(lengths, 10)
    assert len(set(bins)) == 5
    for b in set(bins):
        at = 0
        for i in sorted(np.flatnonzero(bins == b), key=lambda i: offsets[i]):
            assert offsets[i] == at
            at += lengths[i]
