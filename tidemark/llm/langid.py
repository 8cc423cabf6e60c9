"""Word-first backoff language identification.

A known word scores its smoothed log frequency in each language. An unseen word falls back to
its character n-grams, longest first: at each place the longest known n-gram (``orders``)
speaks, and the word's score is their mean, less a penalty for every order given up. A
document's score is the sum over its words; the probability is the softmax of the sum,
damped by the document's length.

The model is fitted on a bounded sample of the labelled rows (about ``sample_docs`` documents
and ``sample_chars`` characters, chosen by a hash of id and text, so that the same documents are
chosen however the table is partitioned) and holds every word and every n-gram of it. These
two bounds are what bounds the model that is shipped to the executors once.

Letters are the code points of the Unicode category L; ½, ² or ① are none.

Defined edge cases: a null text, or one without a letter, is ``und`` with score 0; a null
lang is not learned from; without any labelled row every document is ``und``; ties between
languages go to the first in alphabetical order; a null doc_id is neither held out nor learned
from; repeated rows get equal predictions; whole texts are read, however long; only doc_id,
text and lang are read, and lang never by the prediction.
"""

from __future__ import annotations

import math
import re
import weakref
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, texts_of, tidied

UNKNOWN = "und"
#: The sample that is learned from: about so many documents and characters over all languages.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 8_000_000
ORDERS = (4, 3, 2, 1)
#: Up to so many rows, one a language, the limits are broadcast.
BROADCAST_LANGUAGES = 10_000
#: Words that a worker remembers the scores of.
WORDS_HELD = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. The pattern also takes numbers that are no digits, which isalpha() tells apart."""
    found = _WORD.findall(text.lower())
    if text.isascii():
        return found
    out = []
    for word in found:
        if word.isalpha():
            out.append(word)
        else:
            out += "".join([c if c.isalpha() else " " for c in word]).split()
    return out


def units(word: str, order: int) -> list[str]:
    """The n-grams of a word with its ends marked."""
    marked = f"^{word}$"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


#: The model that this process predicts with. Only weakly: it goes with Spark's broadcast, before other operators need the memory.
_IN_USE: weakref.WeakSet[WordFirstModel] = weakref.WeakSet()


class WordFirstModel:
    """Log frequencies by language: ``words`` and, for each order, ``grams``."""

    def __init__(self, languages: list[str], counts: dict[tuple[str, int], dict[str, int]]):
        """counts: (language, 0 for words or else the n-gram order) -> unit -> count."""
        self.languages = languages
        self.orders = sorted({n for _, n in counts if n}, reverse=True)
        self.words = self._table(counts, 0)
        self.grams = {n: self._table(counts, n) for n in self.orders}
        self.floor = min([float(logs.min()) for _, logs in [self.words, *self.grams.values()] if logs.size], default=0.0) - 1
        self._forget()

    def _table(self, counts, order: int) -> tuple[dict[str, int], np.ndarray]:
        """The row of each unit, and rows of log frequencies by language."""
        row: dict[str, int] = {}
        for x in self.languages:
            for u in counts.get((x, order), {}):
                row.setdefault(u, len(row))
        n = np.zeros((len(row), len(self.languages)), np.float32)
        for k, x in enumerate(self.languages):
            for u, c in counts.get((x, order), {}).items():
                n[row[u], k] = c
        logs = np.log((n + 0.5) / (n.sum(0, dtype=np.float64) + 0.5 * len(row))).astype(np.float32) if len(row) else n
        return row, logs

    def word_score(self, word: str) -> np.ndarray:
        row, logs = self.words
        known = row.get(word)
        return logs[known] if known is not None else self.backoff(word)

    def backoff(self, word: str) -> np.ndarray:
        marked, total, places, at = f"^{word}$", np.zeros(len(self.languages)), 0, 0
        while at < len(marked):
            for back, n in enumerate(self.orders):
                row, logs = self.grams[n]
                found = row.get(marked[at : at + n]) if at + n <= len(marked) else None
                if found is not None:
                    total = total + logs[found] - back * 0.5
                    at += max(1, n - 1)
                    break
            else:
                total = total + self.floor
                at += 1
            places += 1
        return total / max(1, places)

    def use(self) -> WordFirstModel:
        """This model; the scores that the process remembers of another one go, so that models of earlier queries cost no more than their tables."""
        for other in [*_IN_USE]:
            if other is not self:
                other._forget()
                _IN_USE.discard(other)
        _IN_USE.add(self)
        return self

    def _forget(self) -> None:
        self._seen = {}
        self._scores = np.zeros((1024, len(self.languages)))

    def _index(self, word: str) -> int:
        k = self._seen[word] = len(self._seen)
        if k == len(self._scores):
            self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
        self._scores[k] = self.word_score(word)
        return k

    def predict(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        if len(self._seen) > WORDS_HELD:
            self._forget()
        seen = self._seen
        for w in {*words}.difference(seen):
            self._index(w)
        total = self._scores[[seen[w] for w in words]].sum(0)
        best = int(total.argmax())
        odds = np.exp((total - total[best]) / np.sqrt(len(words)))
        return self.languages[best], float(1 / odds.sum())


def _count(orders: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, int], Counter] = {}
            langs, texts = batch.column("lang").to_pylist(), texts_of(batch, "text")
            words: dict[str, Counter] = {}
            for lang, text in zip(langs, texts, strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, found in words.items():
                counts[lang, 0] = found
                for n in orders:
                    grams = counts[lang, n] = Counter()
                    for word, k in found.items():
                        for u in units(word, n):
                            grams[u] += k
            rows = [(lang, n, u, k) for (lang, n), c in counts.items() for u, k in c.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["lang", "n", "unit", "k"])

    return run


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled documents whose crc32(doc_id as text) mod 4 is not 2."""
    return docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, orders: tuple[int, ...] = ORDERS) -> WordFirstModel:
    """A model of the rows (doc_id, text, lang), from about sample_docs of them or sample_chars of their characters.

    Every language gets an equal share of the sample, so a rare language is learned as well
    as a common one. A sampled document is learned from as a whole.
    """
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    rows = sizes.collect()
    languages = sorted(r["lang"] for r in rows)
    if not languages:
        return WordFirstModel([], {})
    scale = 1 << 30
    share = lambda r: min(1, sample_docs / len(rows) / r["n"], sample_chars / len(rows) / max(1, r["chars"]))
    limits = labelled.sparkSession.createDataFrame([(r["lang"], math.ceil(share(r) * scale)) for r in rows], "lang string, limit long")
    if len(rows) <= BROADCAST_LANGUAGES:
        limits = F.broadcast(limits)
    sample = labelled.join(limits, "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < F.col("limit"))
    counted = sample.select("text", "lang").mapInArrow(tidied(_count(orders)), "lang string, n int, unit string, k long").groupBy("lang", "n", "unit").agg(F.sum("k").alias("k"))
    rows = counted.toArrow()  # the sample's own units: bounded as it is
    found: dict[tuple[str, int], dict[str, int]] = {(x, n): {} for x in languages for n in (0, *orders)}
    for lang, n, unit, k in sorted(zip(*(rows.column(c).to_pylist() for c in ("lang", "n", "unit", "k")), strict=True)):
        found[lang, n][unit] = k
    return WordFirstModel(languages, found)


def _predict(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value.use()
        for batch in batches:
            ids, held, lang, score = batch.column("doc_id").to_pylist(), [], [], []
            texts = texts_of(batch, "text")
            for a, b in slices((len(x) for x in texts), 8 << 20):
                for doc, text in zip(ids[a:b], texts[a:b], strict=True):
                    best, p = model.predict(text)
                    lang.append(best)
                    score.append(p)
                    held.append(doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        model._forget()

    return run


def predict(docs: DataFrame, model: WordFirstModel) -> DataFrame:
    """The contract's columns for each row of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(tidied(_predict(shipped)), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fit on the training rows of docs, predict all rows."""
    return predict(docs, fit(training_rows(docs), **options))


def _identified(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value.use()
        for batch in batches:
            yield batch.filter(pa.array([model.predict(x)[0] != UNKNOWN for x in texts_of(batch, "text")], pa.bool_()))
        model._forget()

    return run


def identified(docs: DataFrame, model: WordFirstModel) -> DataFrame:
    """The rows of docs, with all their columns, whose language is not ``und``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(tidied(_identified(shipped)), docs.schema)
