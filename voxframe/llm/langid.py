"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary of pieces."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import written

_LETTERS = regex.compile(r"\p{L}+")  # by category, as str.isalpha: no numerals such as fractions and Roman numbers
SPACE = "▁"
#: Longer runs of letters are learned in pieces of so many characters; scoring reads them whole.
LONGEST = 40
#: Sampled ids are broadcast only if a count finds at most so many.
MOST_BROADCAST = 200_000


def vocabulary(model_path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model, in the order of their ids."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


@dataclass
class PieceModel:
    """log p(piece | language): row of `prob` by piece, the last row for a character without a piece."""

    languages: list[str]
    index: dict[str, int]
    longest: int
    prob: np.ndarray  # (pieces + 1, languages)

    def arcs(self, words: list[str]) -> np.ndarray:
        """(words, end, length - 1): the piece of each span of equally long words; -1 where there is none."""
        n, unknown = len(words[0]), len(self.index)
        width = min(self.longest, n)
        col, piece = [], []
        for k, w in enumerate(words):
            base = k * (n + 1) * width
            for start in range(n):
                node = self.trie.get(w[start])
                if node is None or node[0] is None:
                    col.append(base + (start + 1) * width)
                    piece.append(unknown)
                    if node is None:
                        continue
                end = start + 1
                while True:
                    if node[0] is not None:
                        col.append(base + end * width + end - start - 1)
                        piece.append(node[0])
                    if end == n:
                        break
                    node = node[1].get(w[end])
                    if node is None:
                        break
                    end += 1
        out = np.full(len(words) * (n + 1) * width, -1, np.int32)
        out[col] = piece
        return out.reshape(len(words), n + 1, width)

    @cached_property
    def trie(self) -> dict:
        """character -> [piece or None, the same for the next character]."""
        top: dict = {}
        for text, i in self.index.items():
            node, below = None, top
            for ch in text:
                node = below.setdefault(ch, [None, {}])
                below = node[1]
            if node is not None:
                node[0] = i
        return top

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "trie"}

    def forward(self, arcs: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha (words, place, languages), scaled, and the log of each word's scale, summed over all segmentations."""
        count, places, longest = arcs.shape
        alpha = np.zeros((count, places, prob.shape[1]))
        alpha[:, 0] = 1
        scale = np.zeros((count, prob.shape[1]))
        for e in range(1, places):
            if count == 1 and places > 64:  # a long word alone: only the arcs there are
                m = np.flatnonzero(arcs[0, e] >= 0)
                alpha[0, e] = (alpha[0, e - 1 - m] * prob[arcs[0, e, m]]).sum(axis=0)
            for m in () if count == 1 and places > 64 else range(1, min(longest, e) + 1):
                here = arcs[:, e, m - 1]
                rows = np.flatnonzero(here >= 0)
                if len(rows) == count:
                    alpha[:, e] += alpha[:, e - m] * prob[here]
                elif len(rows):
                    alpha[rows, e] += alpha[rows, e - m] * prob[here[rows]]
            if e >= 24:  # shorter words can't underflow
                small = alpha[:, e] < 1e-100
                if small.any():
                    lift = np.where(small, 1e100, 1.0)
                    alpha[:, max(0, e - longest) : e + 1] *= lift[:, None, :]
                    scale -= np.where(small, 100 * np.log(10), 0)
        return alpha, scale

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """(words, languages) natural logs, each summed over every segmentation of the word."""
        out = np.zeros((len(words), len(self.languages)))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, all_rows in by_length.items():
            step = max(1, 400_000 // (n * max(1, len(self.languages)) + 1))
            for at in range(0, len(all_rows), step):
                rows = all_rows[at : at + step]
                alpha, scale = self.forward(self.arcs([words[k] for k in rows]), self.prob)
                out[rows] = np.log(np.maximum(alpha[:, -1], 1e-300)) + scale
        return out


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _LETTERS.findall(text.lower())


def fit_pieces(samples: dict[str, Counter], pieces: list[str], rounds: int = 4, smoothing: float = 0.1) -> PieceModel:
    """Expectation maximisation of each language's piece probabilities on its word counts; words have the space mark before them.

    The expected count of a piece comes from forward and backward sums over all segmentations.
    """
    index = {p: i for i, p in enumerate(pieces)}
    model = PieceModel(sorted(samples), index, max(map(len, pieces), default=1), np.zeros((len(pieces) + 1, len(samples))))
    size = len(pieces) + 1
    for col, lang in enumerate(model.languages):
        parts: Counter = Counter()
        for w, n in samples[lang].items():
            for at in range(0, len(w), LONGEST):
                parts[w[at : at + LONGEST]] += n
        by_length: dict[int, list[str]] = {}
        for w in parts:
            by_length.setdefault(len(w), []).append(w)
        groups = [(model.arcs(ws), np.array([parts[w] for w in ws], float)) for ws in by_length.values()]
        prob = np.full((size, 1), 1 / size)
        for _ in range(rounds):
            expected = np.zeros(size)
            for arcs, weight in groups:
                alpha, _ = model.forward(arcs, prob)
                count, places, longest = arcs.shape
                p = np.append(prob[:, 0], 0)
                beta = np.zeros((count, places))
                beta[:, -1] = 1
                total = np.maximum(alpha[:, -1, 0], 1e-300)
                for e in range(places - 1, 0, -1):
                    for m in range(1, min(longest, e) + 1):
                        use = p[arcs[:, e, m - 1]] * beta[:, e]
                        beta[:, e - m] += use
                        here = arcs[:, e, m - 1]
                        gained = weight * alpha[:, e - m, 0] * use / total
                        expected += np.bincount(here[here >= 0], gained[here >= 0], minlength=size)
            expected += smoothing * expected.sum() / size + 1e-9
            prob = (expected / expected.sum())[:, None]
        model.prob[:, col] = prob[:, 0]
    return model


def _word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n of rows (lang, text): tasks count before the shuffle and hand on what they hold past a bound."""

    def run(batches):
        held: dict[str, Counter] = {}

        def out():
            lang, word, n = zip(*((k, w, n) for k, c in held.items() for w, n in c.items()), strict=True) if any(held.values()) else ((), (), ())
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(lang, Counter()).update(SPACE + w for w in words_of(text))
                if sum(map(len, held.values())) > 200_000:
                    yield from out()
        yield from out()

    return rows.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def language_sample(known: DataFrame, most: int) -> DataFrame:
    """doc_id of the `most` rows (doc_id, lang) of least id hash in each language; all where a language has no more.

    Counts of the languages set a bound on the hash first, so the rows that are ordered are few, whatever the table holds.
    """
    h = F.xxhash64("doc_id")
    share = F.least(F.lit(1.0), F.lit(1.2 * most + 50) / F.col("n"))
    of = written(known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (share * F.lit(2.0**64) - F.lit(2.0**63)).alias("upto")), "language-shares")
    of = F.broadcast(of) if of.count() <= MOST_BROADCAST else of
    low = known.select("doc_id", "lang", h.alias("h")).join(of, "lang").where(F.col("h").cast("double") <= F.col("upto"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return low.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id")


def fit_languages(docs: DataFrame, pieces: list[str], most: int = 250) -> PieceModel:
    """Fit on at most `most` documents (doc_id, text, lang) of each language, each whole.

    Rows without text or lang teach nothing. The choice of documents follows a hash of the id alone, in each language on its
    own, so a rare one is learned from all it has; tasks count the words, and the distinct ones of each language come to the driver.
    """
    known = docs.where("text is not null and lang is not null and doc_id is not null")
    ids = written(language_sample(known.select("doc_id", "lang"), most).distinct(), "languages")
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)  # 8 bytes a row
    counts = _word_counts(known.join(ids, "doc_id")).toArrow()  # words of `most` ids a language
    samples: dict[str, Counter] = {}
    for lang, word, n in zip(*(counts[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        samples.setdefault(lang, Counter())[word] = n
    return fit_pieces(samples, pieces)


class Scorer:
    """Sums cached word vectors over whole texts."""

    def __init__(self, model: PieceModel, most: int = 250_000):
        self.model, self.most = model, most
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.value = np.zeros((4096, len(self.model.languages)))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihoods (texts, languages), letter runs of each text)."""
        words = [words_of(t) for t in texts]
        if len(self.at) > self.most:
            self._reset()
        at = self.at
        new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in at]
        if new:
            first = len(at)
            at.update(zip(new, range(first, first + len(new)), strict=True))
            if len(at) > len(self.value):
                self.value = np.vstack([self.value, np.zeros((max(len(self.value), len(at)), self.value.shape[1]))])
            self.value[first : first + len(new)] = self.model.log_likelihood([SPACE + w for w in new])
        count = np.array([len(w) for w in words])
        total = np.zeros((len(texts), self.value.shape[1]))
        full = np.flatnonzero(count)
        if len(full):
            rows = np.fromiter(map(at.__getitem__, chain.from_iterable(words)), np.int64, count.sum())
            total[full] = np.add.reduceat(self.value[rows], np.concatenate(([0], count.cumsum()[full[:-1]])))
        return total, count


def _in_steps(texts: list[str], chars: int = 500_000):
    """Slices of texts of about so many characters; a longer text is a slice of its own."""
    step, size = [], 0
    for t in texts:
        step.append(t)
        size += len(t)
        if size >= chars:
            yield step
            step, size = [], 0
    if step:
        yield step


def predict_languages(docs: DataFrame, model: PieceModel) -> DataFrame:
    """docs with lang_pred and lang_score, the posterior of lang_pred under equal priors.

    A null text, one without a letter, and any text under a model without languages gets `und` and 0.
    Columns of these names are replaced, all others and all rows stay; texts are read whole.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages numbers

    def run(batches):
        score = Scorer(shared.value)
        for b in batches:
            best, chance = [], []
            for texts in _in_steps([t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]):
                total, count = score(texts)
                if not shared.value.languages:
                    count, total = count * 0, np.zeros((len(texts), 1))
                top = total.argmax(axis=1)
                posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                best += [shared.value.languages[k] if n else "und" for k, n in zip(top, count, strict=True)]
                chance += np.where(count > 0, posterior, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(chance, pa.float64())], names=[*b.schema.names, "lang_pred", "lang_score"])

    return docs.select(*keep).mapInArrow(run, schema)
