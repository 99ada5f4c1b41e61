"""Toxicity by noisy-channel deobfuscation: decode leetspeak, spacing and repetition, then score the restored words."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import bounded_sample, drop, slices, texts_of, written

#: Characters often written for a letter, and the letters they may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou",
}

#: Three or more single characters with up to three white space characters between each two.
_SINGLES = re.compile(r"\s(\S(?:\s{1,3}\S){2,})(?!\S)")
_ORDER = 3  # characters of history in the language model
#: The commonest character n-grams of the language model are held in a dictionary, all others packed; four Latin-letter languages have fewer.
MOST_GRAMS = 600_000


def word_grams(words: dict[str, int]) -> pa.Table:
    """gram, n: the character n-grams of words, each with a space before and after, that end behind that first space."""
    if not words:
        return pa.table({"gram": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    code = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
    letters, rank = np.unique(code, return_inverse=True)
    if len(letters) > 60_000:  # ranks are 16 bits of a key
        items = list(words.items())
        return pa.concat_tables([word_grams(dict(items[::2])), word_grams(dict(items[1::2]))])
    rank = rank.astype(np.uint64) + np.uint64(1)
    spaces = np.flatnonzero(code == ord(" "))
    size = np.diff(spaces)  # of each word with the space after it
    weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), size)
    place = np.arange(len(weight)) - np.repeat(spaces[:-1], size) + 1  # in the word, 1 is its first letter
    key, out = np.zeros(len(weight), np.uint64), []
    for k in range(_ORDER + 1):
        back = rank[1:] if k == 0 else np.concatenate((np.zeros(k - 1, np.uint64), rank[: len(rank) - k]))  # k characters before
        key = key | back << np.uint64(16 * k)
        whole = place >= k
        sums = pa.table({"key": key[whole], "n": weight[whole]}).group_by("key", use_threads=False).aggregate([("n", "sum")])
        found = sums["key"].to_numpy()
        chars = np.column_stack([letters[(found >> np.uint64(16 * j) & np.uint64(0xFFFF)).astype(np.int64) - 1] for j in range(k, -1, -1)])
        text = np.ascontiguousarray(chars).tobytes().decode("utf-32-le")
        out.append(pa.table({"gram": pa.array([text[i : i + k + 1] for i in range(0, len(text), k + 1)], pa.string()), "n": sums["n_sum"]}))
    return pa.concat_tables(out)


class CharModel:
    """Interpolated character n-grams over lower-case words, each with a space before and after.

    The tables stay packed until they are asked for, so that the driver, which only hands them on, holds no dictionary.
    """

    def __init__(self, words: dict[str, int] | None = None, grams: pa.Table | None = None, totals: pa.Table | None = None):
        """From word counts, or from n-gram counts (gram, n) and the totals of their histories (past, n)."""
        grams = word_grams(words or {}) if grams is None else grams
        if totals is None:
            sums: Counter = Counter()
            for gram, n in zip(grams["gram"].to_pylist(), grams["n"].to_pylist(), strict=True):
                sums[gram[:-1]] += n
            totals = pa.table({"past": pa.array(list(sums), pa.string()), "n": pa.array(list(sums.values()), pa.int64())})
        self.packed = grams, totals
        self.cache: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "cache": {}}

    @cached_property
    def counts(self) -> dict[str, int]:
        return counts_of(self.packed[0])

    @cached_property
    def totals(self) -> dict[str, int]:
        return counts_of(self.packed[1])

    def log_prob(self, history: str, ch: str) -> float:
        """Of ch after the history: its last three characters, or all since the space before the word."""
        key = history[-_ORDER:] + ch
        if key not in self.cache:
            if len(self.cache) > 150_000:
                self.cache.clear()
            p = 1 / 300
            for k in range(_ORDER + 1):
                past = history[-k:] if k else ""
                seen = self.totals.get(past, 0)
                p = (self.counts.get(past + ch, 0) + 3 * p) / (seen + 3)
            self.cache[key] = math.log(p)
        return self.cache[key]


def _dictionary(table: pa.Table) -> dict[str, int]:
    return dict(zip(table[0].to_pylist(), table[1].to_pylist(), strict=True))


def counts_of(table: pa.Table) -> dict[str, int]:
    """Every count of a table (string, n), found by get."""
    return Counts(table) if len(table) > MOST_GRAMS else _dictionary(table)


class Counts(dict):
    """The MOST_GRAMS greatest counts in a dictionary, the rest as sorted columns that get searches."""

    def __init__(self, table: pa.Table):
        order = pc.sort_indices(table, [(table.column_names[1], "descending")])
        super().__init__(_dictionary(table.take(order[:MOST_GRAMS])))
        rest = table.take(order[MOST_GRAMS:])
        rest = rest.take(pc.sort_indices(rest[0])).combine_chunks()  # UTF-8 and Python strings have one order
        self.rest, self.numbers = rest[0].chunk(0), rest[1].chunk(0)

    def get(self, name: str, default: int = 0) -> int:
        n = super().get(name)
        if n is None:
            at = bisect_left(self.rest, name, key=pa.StringScalar.as_py)
            n = self.numbers[at].as_py() if at < len(self.rest) and self.rest[at].as_py() == name else None
        return default if n is None else n


def _offers(run: str, i: int, swap: float, repeat: float, gap: float) -> list[tuple[str, float]]:
    """What the place i of a run's lattice may stand for, with log costs."""
    ch = run[i]
    if ch == " ":
        return [("", 0.0), (" ", gap)]
    offers = [(ch, 0.0)] if ch.isalpha() else []
    offers += [(x, swap) for x in LEET.get(ch, "")]
    if not ch.isalpha():
        offers.append(("", swap))
        if not ch.isalnum():
            offers.append((" ", gap))
    if i and run[i - 1] == ch:
        offers.append(("", repeat if i > 1 and run[i - 2] == ch else 3 * repeat))
    return offers


def decode(run: str, model: CharModel, swap: float = -2.5, repeat: float = -1.0, gap: float = -1.5, beam: int = 32) -> str:
    """The likeliest word behind a run of characters: Viterbi over its character lattice.

    A place of the lattice offers its own letter, the letters it may stand for (log cost swap), leaving out
    a mark (swap), a mark other than a digit as the end of a word (gap), taking a repeated letter once (repeat, or three times that for
    the second of two), or, at a blank between single letters, joining (free) or keeping the blank (gap). Characters without a width
    are left out. States are the model's history, and paths of one history merge; where only one state is left and a place has one
    offer, the letter is certain and nothing is scored. The beam bounds the states kept at a place; up to so many the result is exact.
    """
    run = _NO_WIDTH.sub("", run.lower())
    known, log_prob = model.cache, model.log_prob
    certain: list[str] = []  # what all paths that are left begin with
    states: dict[str, tuple[float, tuple | None]] = {" ": (0.0, None)}
    for i, ch in enumerate(run):
        plain = ch.isalpha() and not (i and run[i - 1] == ch)
        if len(states) == 1:
            ((history, (_, path)),) = states.items()
            certain += _unwound(path)
            if plain:
                certain.append(ch)
                states = {(history + ch)[-_ORDER:]: (0.0, None)}
                continue
            states = {history: (0.0, None)}
        after: dict[str, tuple[float, tuple | None]] = {}
        offers = ((ch, 0.0),) if plain else _offers(run, i, swap, repeat, gap)
        for history, (score, path) in states.items():
            for out, cost in offers:
                if not out:
                    to, now = history, score + cost
                elif out == " " and ch != " " and history[-1] == " ":  # no empty word
                    continue
                else:
                    to = (history + out)[-_ORDER:]
                    p = known.get(history + out)
                    now = score + cost + (log_prob(history, out) if p is None else p)
                held = after.get(to)
                if held is None or now > held[0]:
                    after[to] = (now, (path, out) if out else path)
        states = after if len(after) <= beam else dict(sorted(after.items(), key=lambda kv: -kv[1][0])[:beam])
    if len(states) > 1:
        _, path = max(((score + log_prob(history, " "), path) for history, (score, path) in states.items()), key=lambda x: x[0])
    else:
        ((_, path),) = states.values()
    return "".join(certain + _unwound(path))


def _unwound(path: tuple | None) -> list[str]:
    out = []
    while path:
        path, ch = path
        out.append(ch)
    return out[::-1]


#: Soft hyphen, zero-width space, joiners, direction marks, word joiner and byte order mark.
_NO_WIDTH = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_OPENING, _CLOSING = "\"'([{", "\"'.,;:!?)]}"
_REPEATED_MARK = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")
_DOUBLE = re.compile(r"([^\W\d_])\1")


def _bare(run: str) -> str:
    """The run without closing punctuation and without marks repeated at its edges, which decorate and stand for no letter."""
    before = None
    while run != before:
        before, run = run, _REPEATED_MARK.sub("", run).lstrip(_OPENING).rstrip(_CLOSING)
    return run


class Restorer:
    """Restored words of a white-space run."""

    def __init__(self, model: CharModel):
        self.model = model

    def words(self, run: str) -> tuple[str, ...]:
        """Lower-case words of the run and, where its lattice has more than one path, those of its decoding."""
        bare = run.lower()
        if not bare.isalpha():
            bare = bare.lstrip(_OPENING).rstrip(_CLOSING)
            if not bare.isalpha():
                bare = _bare(bare)
        if bare.isalpha():
            if not _DOUBLE.search(bare):
                return (bare,)
            word = decode(bare, self.model)
            return (bare,) if word == bare else (bare, word)
        out = [w for w in re.split(r"\W+", bare) if w]
        letters = [w for w in re.split(r"[\W_]+", bare) if w]
        if len(letters) >= 3 and all(len(w) == 1 for w in letters):
            bare = "".join(letters)
        elif not any(c.isalpha() for c in bare):
            return tuple(out)
        return (*out, *(w for w in dict.fromkeys(decode(bare, self.model).split()) if w not in out))

    def spaced(self, text: str) -> list[str]:
        """Words decoded from every run of three or more single characters with white space between each two."""
        found = []
        for m in _SINGLES.finditer(" " + text):
            found += decode(" ".join(m.group(1).split()), self.model).split()
        return found


_PREFIXES = range(4, 9)


def word_features(words: tuple[str, ...] | list[str]) -> list[str]:
    """Each whole word and its first 4 to 8 characters, marked apart."""
    return [x for w in words for x in (w, *(w[:k] + "*" for k in _PREFIXES if len(w) > k))]


def document_features(per_run: Iterable[tuple[str, ...]]) -> set[str]:
    """The features of a text's distinct runs; a beginning that 2 or 3 of them share is also a feature of that rank."""
    count = Counter(chain.from_iterable(per_run))
    return {*count, *(f"{f}{rank}" for f, n in count.items() if n > 1 and f[-1] == "*" for rank in range(2, min(n, 3) + 1))}


@dataclass
class ToxicModel:
    """A decision list: the chance of label 1 given each feature, and that of a text without any of them."""

    chars: CharModel
    chance: dict[str, float]
    base: float


def copy_bands(text: str, bands: int = 8, rows: int = 2) -> list[int]:
    """Min-hashes of the text's three-word shingles, two to a band; near copies share a band."""
    rng = np.random.default_rng(11)
    a, b = rng.integers(1, 2**31, bands * rows, np.uint64) | np.uint64(1), rng.integers(0, 2**31, bands * rows, np.uint64)
    w = text.lower().split()
    grams = {zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))}
    h = np.fromiter(grams, np.uint64, len(grams))
    low = np.array([((h * x + y) >> np.uint64(7) & np.uint64(0xFFFFFFFF)).min() for x, y in zip(a, b, strict=True)]).reshape(bands, rows)
    return (low[:, 0] << np.uint64(32) | low[:, 1]).view(np.int64).tolist()


def copy_families(banded: list[list[int]]) -> list[int]:
    """A number for each text, given its bands; texts that share a band, directly or through others, have the same one."""
    family = list(range(len(banded)))

    def find(i: int) -> int:
        while family[i] != i:
            family[i] = family[family[i]]
            i = family[i]
        return i

    seen: dict[tuple, int] = {}
    for i, bands in enumerate(banded):
        for key in enumerate(bands):
            x, y = find(seen.setdefault(key, i)), find(i)
            family[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(banded))]


def fit_chars(docs: DataFrame) -> CharModel:
    """The character model of every word of letters in docs (text).

    Tasks count words and hand on their n-grams whenever they hold many; the sums of all n-grams and of their histories are
    packed columns of some 20 bytes an n-gram, which is how the driver hands them on.
    """

    def run(batches):
        runs: Counter = Counter()

        def out():
            words: Counter = Counter()
            for r, n in runs.items():
                for w in (r,) if r.isalpha() else re.split(r"\W+", r):
                    if w.isalpha():
                        words[w] += n
            runs.clear()
            yield from word_grams(words).to_batches()

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                runs.update(text.lower().split())
                if len(runs) > 300_000:
                    yield from out()
        yield from out()

    raw = docs.select("text").where("text is not null").mapInArrow(run, "gram string, n long")
    grams = written(raw.groupBy("gram").agg(F.sum("n").alias("n")), "toxic-grams")
    totals = grams.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("past")).agg(F.sum("n").alias("n"))
    model = CharModel(None, grams.toArrow().combine_chunks(), totals.toArrow().combine_chunks())
    drop(grams)
    return model


def labelled_features(rows: DataFrame, chars: CharModel) -> DataFrame:
    """row, label, bands (of label 1) and features of each row (text, label), computed in tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(chars)

    def run(batches):
        restorer, cache = Restorer(shared.value), {}
        for b in slices(batches, 64):
            bands, features = [], []
            for text, label in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(cache) > 100_000:
                    cache.clear()
                runs = set(text.split())
                for r in runs.difference(cache):
                    cache[r] = tuple(word_features(restorer.words(r)))
                features.append(list(document_features([word_features(restorer.spaced(text)), *map(cache.__getitem__, runs)])))
                bands.append(copy_bands(text) if label else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bands, pa.list_(pa.int64())), pa.array(features, pa.list_(pa.string()))], names=["row", "label", "bands", "features"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "label", "text")
    return numbered.mapInArrow(run, "row long, label int, bands array<long>, features array<string>")


def fit_toxic(rows: DataFrame, chars: CharModel, least_g: float = 24.0, least_precision: float = 0.9) -> ToxicModel:
    """The features that mark label 1 in rows (text, label), each with its smoothed precision.

    A feature is taken if its G squared against the label is at least least_g, about one chance in a million,
    and at least least_precision of the texts with it have label 1. Near copies with label 1 count once, else every
    word of a text that was copied often would seem a sign. Features are made and counted in tasks; to the driver
    come the bands of the rows with label 1 and the signs.
    """
    held = written(labelled_features(rows, chars), "toxic-features")
    n_of = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, ones = n_of.get(0, 0), n_of.get(1, 0)
    if not n0 or not ones:
        return ToxicModel(chars, {}, (ones + 0.5) / (n0 + ones + 1) if n_of else 0.0)
    marked = held.where("label = 1").select("row", "bands").collect()
    families = copy_families([r["bands"] for r in marked])
    n1 = len(set(families))
    n = n1 + n0
    family = held.sparkSession.createDataFrame([(r["row"], f) for r, f in zip(marked, families, strict=True)], "row long, family int")
    each = held.select("row", "label", F.explode("features").alias("f"))
    positive = each.where("label = 1").join(F.broadcast(family), "row").groupBy("f").agg(F.countDistinct("family").alias("a"))
    may = positive.where(F.lit(2 * float(np.log(n / n1))) * F.col("a") >= least_g)
    both = may.join(each.where("label = 0").groupBy("f").agg(F.count("*").alias("b")), "f", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    a, b = F.col("a"), F.col("b")
    g = 2 * (a * F.log(a * n / ((a + b) * n1)) + F.when(b > 0, b * F.log(b * n / ((a + b) * n0))).otherwise(0.0))
    signs = both.withColumn("g", g).where((a >= least_precision * (a + b)) & (F.col("g") >= least_g)).collect()
    chance = {r["f"]: (r["a"] + 0.5) / (r["a"] + r["b"] + 1.5) for r in signs}
    names = held.sparkSession.createDataFrame([(f,) for f in chance], "f string")
    signed = each.join(F.broadcast(names), "f", "left_semi").select("row").distinct()
    rest = held.join(signed, "row", "left_anti").agg(F.coalesce(F.sum("label"), F.lit(0)).alias("s"), F.count("*").alias("n")).first()
    drop(held)
    return ToxicModel(chars, chance, (rest["s"] + 0.5) / (rest["n"] + 1))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 6_000) -> ToxicModel:
    """Fit on at most `most` labelled documents (doc_id, text; doc_id, label), whole, and the words of all docs.

    The choice follows a hash of the id. Null ids, texts and labels teach nothing, an id that is repeated counts once, with
    its text of the least hash; without both labels every score is the base rate.
    """
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = bounded_sample(known.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", most)
    return fit_toxic(texts_of(docs, chosen).join(F.broadcast(chosen), "doc_id"), fit_chars(docs))  # at most `most` ids


class ToxicScorer:
    def __init__(self, model: ToxicModel, most: int = 250_000):
        self.restorer, self.model, self.most = Restorer(model.chars), model, most
        self.known = {f.rstrip("23") if f.rstrip("23").endswith("*") else f for f in model.chance}
        self.starts = {f[: _PREFIXES.start] for f in self.known if f.endswith("*")}
        self.cache: dict[str, tuple[str, ...]] = {}

    def features(self, words: tuple[str, ...] | list[str]) -> tuple[str, ...]:
        signs = [w for w in words if w in self.known or w[: _PREFIXES.start] in self.starts]
        return tuple(f for f in word_features(signs) if f in self.known) if signs else ()

    def __call__(self, text: str) -> float:
        runs, cache = set(text.split()), self.cache
        new = runs.difference(cache)
        if new:
            if len(cache) > self.most:
                cache.clear()
                new = runs
            for r in new:
                cache[r] = self.features(self.restorer.words(r))
        per_run = [*filter(None, map(cache.__getitem__, runs)), self.features(self.restorer.spaced(text))]
        chance = self.model.chance
        return max((chance[f] for f in document_features(per_run) if f in chance), default=self.model.base)


def score_toxicity(docs: DataFrame, model: ToxicModel, cut: float = 0.5) -> DataFrame:
    """docs with toxic_score (0 to 1) and toxic_predicted (1 if score >= cut).

    Null and empty texts have the model's base chance. All rows and columns stay, clashing names are
    replaced; texts are read whole, and long ones need no more memory than their own words.
    """
    keep = [c for c in docs.columns if c not in ("toxic_score", "toxic_predicted")]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        model = shared.value
        scorer = model.__dict__.get("scorer") or model.__dict__.setdefault("scorer", ToxicScorer(model))  # stays with the worker
        for b in slices(batches):
            p = np.array([scorer(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= cut).astype(np.int32))], names=[*b.schema.names, "toxic_score", "toxic_predicted"])

    return docs.select(*keep).mapInArrow(run, schema)
