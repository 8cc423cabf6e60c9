"""Quality rules: base counts, and perplexity bands of a modified Kneser-Ney model by language.

The model is over character n-grams (order 4). Invented or rare words make word n-grams of a
corpus nearly all singletons. Symbols are the code points themselves, whatever the script;
letters are lower-cased, decimal digits are one symbol, and so are spaces and line ends. Every
language has its own model, and every model is a table of Spark's, dealt by the hash of
language and n-gram: no task and no driver holds a model.

The n-grams of *all* documents are counted by Spark, and their probabilities are computed as
joins. The model is then stored in shards: a shard holds a range of 64-bit n-gram hashes as a
sorted array, and an array of their log probabilities. Texts are dealt to blocks, each of one
language. A block sends the hashes of its distinct n-grams to their shards, in sorted arrays
too, and gets an array of log probabilities back. A scored n-gram has been counted, so each is
found. Shards that many blocks ask are copied, a copy for every so many blocks.

A language's band is centred on its median log perplexity. The mean over a text's characters
strays less from it the longer the text is, so the half width is ``least`` plus ``width``
times the language's spread over the square root of the number of characters; the spread is
the median of |deviation| * sqrt(characters). Both medians are taken over all documents that
pass the base rules. Documents above or below the band are rejected.

Defined edge cases: a null or empty text has no words, fails the base rules and has a null
perplexity; a null lang is the language "und"; a language of one document has a model and a
band of that document alone; an empty table gives no rows; repeated rows get equal results; a
null doc_id stays null; whole texts are read, and one that is longer than a block is a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_ranges, mix, stored, texts_of

ORDER = 4
#: Symbols of the in-memory model that the tests hold probabilities() against.
SYMBOLS = 48
#: Characters of a block, and of all blocks that a task holds at a time; any numbers give the same results.
BLOCK, HELD = 4 << 20, 16 << 20
#: A code point takes 21 bits; the start symbol is the first number that is none.
BITS, START = 21, 0x110000
#: N-grams of a shard, and blocks that ask one copy of it.
SHARD, ASKERS = 1 << 20, 64
#: Tables of one row a language are broadcast up to so many languages.
BROADCAST_LANGUAGES = 10_000
UNKNOWN = "und"
#: Band half width in spreads, and what is added to it in log units.
WIDTH, LEAST = 5.0, 0.02
_WORDS = re.compile("[^\x20\x09-\x0d]+").findall
_SYMBOLS = re.compile("[#*$%&|<>]").findall


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = _WORDS(text)
    lines = [x for x in text.split("\n") if _WORDS(x)]
    repeats = 0
    n = len(words)
    if n > 2:
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
        if len(number) < 1 << 21:
            windows = ids[:-2] << np.uint64(42) | ids[1:-1] << np.uint64(21) | ids[2:]
            order = np.argsort(windows, kind="stable")
            same = windows[order[1:]] == windows[order[:-1]]
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
        else:
            seen: dict[tuple, int] = {}
            for w in zip(words, words[1:], words[2:], strict=False):
                seen[w] = seen.get(w, 0) + 1
            twice = np.array([seen[w] > 1 for w in zip(words, words[1:], words[2:], strict=False)])
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeats = int(covered.sum())
    return n, sum(map(len, words)), len(_SYMBOLS(text)), len(lines) - len({*lines}), repeats


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


@cache
def symbol_table() -> np.ndarray:
    """Symbol of each code point: lower case, one decimal digit, one space, one line end. No code point is lost."""
    table = np.arange(START + 1, dtype=np.uint32)
    for k in range(0x20000):  # no cased letters, digits or spaces beyond
        c = chr(k)
        if c.isdecimal():
            table[k] = ord("0")
        elif c.isspace():
            table[k] = ord("\n" if c in "\n\r\x85\u2028\u2029" else " ")
        elif len(c.lower()) == 1:
            table[k] = ord(c.lower())
    return table


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams_of(texts: list[str], where: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of non-empty texts as two longs of two symbols each, and how often or (where) which each character's is.

    A text is preceded by ORDER - 1 start symbols, so its first character has a history too.
    """
    pad = np.full(ORDER - 1, START, np.uint32)
    table = symbol_table()
    symbols = np.concatenate([x for t in texts for x in (pad, table[points(t)])])
    keep = np.ones(len(symbols), bool)
    starts = np.cumsum([0] + [len(t) + ORDER - 1 for t in texts])[:-1]
    for k in range(ORDER - 1):
        keep[starts + k] = False
    keep = keep[ORDER - 1 :]
    used = np.zeros(START + 1, bool)
    used[symbols] = True
    (letters,) = used.nonzero()
    ids = (np.cumsum(used) - 1)[symbols].astype(np.uint64)
    bits = np.uint64(max(1, int(len(letters) - 1).bit_length()))
    pairs = ids[:-1] << bits | ids[1:]
    wide = 4 * int(bits) > 64
    if wide:
        known, pairs = np.unique(pairs, return_inverse=True)
        pairs = pairs.astype(np.uint64)
    half = np.uint64(32) if wide else bits + bits
    keys = (pairs[:-2] << half | pairs[2:])[keep]
    found, other = np.unique(keys, return_inverse=True) if where else np.unique(keys, return_counts=True)
    first, last = found >> half, found & ((np.uint64(1) << half) - np.uint64(1))
    if wide:
        first, last = known[first.astype(np.int64)], known[last.astype(np.int64)]
    low = (np.uint64(1) << bits) - np.uint64(1)
    unpack = lambda x: letters[(x >> bits).astype(np.int64)] << BITS | letters[(x & low).astype(np.int64)]
    return unpack(first), unpack(last), other


def gram_hashes(lang: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))
    return mix(mix(a.astype(np.uint64) ^ seed) + b.astype(np.uint64))


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    """(language, [(doc_id, text)]): about BLOCK characters of one language at a time."""
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for d, t, lang in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), batch.column("lang").to_pylist(), strict=True):
            held.setdefault(lang, []).append((d, t))
            # A row counts too, so that empty texts fill a block.
            sizes[lang] = sizes.get(lang, 0) + len(t) + 16
            if sizes[lang] > BLOCK:
                del sizes[lang]
                yield lang, held.pop(lang)
        while sum(sizes.values()) > HELD:
            lang = max(sizes, key=sizes.get)
            del sizes[lang]
            yield lang, held.pop(lang)
    for lang in sorted(held):
        yield lang, held[lang]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, rows in _by_language(batches):
        texts = [t for _, t in rows if t]
        if texts:
            a, b, k = grams_of(texts, where=False)
            columns = [pa.array(x.astype(np.int64)) for x in (a, b, k)]
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(a), np.int32))), *columns], ["lang", "a", "b", "k"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its texts, compressed."""
    number = TaskContext.get().partitionId() << 32
    for lang, rows in _by_language(batches):
        texts = [t for _, t in rows]
        data = "".join(texts).encode("utf-8", "surrogatepass")
        packed = pa.Codec("zstd").compress(data, asbytes=True)
        number += 1
        lists = [pa.array([x], pa.list_(pa.int64())) for x in ([d for d, _ in rows], list(map(len, texts)))]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang], pa.string()), *lists, pa.array([len(data)], pa.int64()), pa.array([packed], pa.binary())], ["block", "lang", "ids", "sizes", "n_bytes", "texts"])


def _texts(block: pa.Table) -> tuple[str, list[str]]:
    """The language and the texts of a block."""
    row = {c: block.column(c)[0].as_py() for c in ("lang", "sizes", "n_bytes", "texts")}
    whole = pa.Codec("zstd").decompress(row["texts"], row["n_bytes"], asbytes=True).decode("utf-8", "surrogatepass")
    ends = np.cumsum(row["sizes"]).tolist()
    return row["lang"], [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _hashed(n_shards: int):
    """Rows of (shard, hash, log_p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            a, b, p = (batch.column(c).to_numpy() for c in ("a", "b", "p"))
            h = np.empty(len(a), np.uint64)
            for lang in {*langs}:
                own = langs == lang
                h[own] = gram_hashes(lang, a[own], b[own])
            shard = ((h >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(h.view(np.int64)), pa.array(np.log(p).astype(np.float32))], ["shard", "hash", "log_p"])

    return run


def _shard(rows: pa.Table) -> pa.Table:
    """A sorted array of hashes and the array of their log probabilities."""
    h = rows.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return pa.table({"shard": rows.column("shard").slice(0, 1).cast(pa.int64()), "hashes": pa.array([h[order].tobytes()]), "log_ps": pa.array([rows.column("log_p").to_numpy()[order].tobytes()])})


def _ask(n_shards: int, copies: int):
    def run(block: pa.Table) -> pa.Table:
        lang, texts = _texts(block)
        number, full = block.column("block")[0].as_py(), [x for x in texts if x]
        h = np.empty(0, np.uint64)
        if full:
            a, b, _ = grams_of(full, where=False)
            h = np.sort(gram_hashes(lang, a, b))
        parts = hash_ranges(h, n_shards)
        return pa.table({"place": pa.array([p * copies + number % copies for p, _, _ in parts], pa.int64()), "block": pa.array([number] * len(parts), pa.int64()), "asked": pa.array([h[x:y].tobytes() for _, x, y in parts], pa.binary())})

    return run


def _answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
    blobs = asked.column("asked").to_pylist()
    if blobs:
        keys, values = np.frombuffer(shard.column("hashes")[0].as_py(), np.uint64), np.frombuffer(shard.column("log_ps")[0].as_py(), np.float32)
    found = []
    for blob in blobs:
        h = np.frombuffer(blob, np.uint64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        if (keys[at] != h).any():
            raise ValueError("an n-gram was not counted")
        found.append(values[at].tobytes())
    return pa.table({"block": asked.column("block").cast(pa.int64()), "place": asked.column("place").cast(pa.int64()), "log_ps": pa.array(found, pa.binary())})


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the counts of counts."""
    c = [int((n == k).sum()) for k in range(1, 5)]
    if not all(c):
        return 0.5, 0.75, 0.9
    y = c[0] / (c[0] + 2 * c[1])
    return tuple(min(max(k - (k + 1) * y * c[k] / c[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))


class KneserNey:
    """Modified Kneser-Ney over the n-grams of one language in memory: for tests, what probabilities() states as joins."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, symbols: int = SYMBOLS):
        """codes: distinct n-grams as base-SYMBOLS numbers, the last symbol lowest; counts: how often."""
        self.symbols = symbols  # how many the last back-off spreads over
        self.orders: list[tuple[np.ndarray, np.ndarray]] = []  # of each order: hashes, discounted share
        self.backoffs: list[tuple[np.ndarray, np.ndarray]] = []  # of each order's histories: hashes, weight
        grams, n = codes.astype(np.int64), counts.astype(np.float64)
        levels = []
        for order in range(ORDER, 0, -1):
            levels.append((order, grams, n))
            # Lower orders count the distinct symbols before an n-gram, not its occurrences.
            shorter = grams % SYMBOLS ** (order - 1)
            grams, n = np.unique(shorter, return_counts=True)
            n = n.astype(np.float64)
        for order, grams, n in reversed(levels):
            d = np.array([0.0, *_discounts(n)])
            cut = d[np.minimum(n, 3).astype(int)]
            history, where = np.unique(grams // SYMBOLS, return_inverse=True)
            total = np.bincount(where, n)
            left = np.bincount(where, cut)
            self._keep(self.orders, order, grams, (n - cut) / total[where])
            self._keep(self.backoffs, order, history, left / total)

    @staticmethod
    def _keep(to: list, order: int, grams: np.ndarray, values: np.ndarray) -> None:
        hashes = KneserNey.hashes(grams, order)
        by = np.argsort(hashes)
        to.append((hashes[by], values[by]))

    @staticmethod
    def hashes(grams: np.ndarray, order: int) -> np.ndarray:
        return mix(grams.astype(np.uint64) + np.uint64(order << 40))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, missing: float) -> np.ndarray:
        keys, values = table
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, values[at], missing)

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Natural log of P(last symbol | the others) of each full n-gram."""
        p = np.full(len(grams), 1.0 / self.symbols)
        for k, order in enumerate(range(1, ORDER + 1)):
            g = grams.astype(np.int64) % SYMBOLS**order
            share = self._find(self.orders[k], self.hashes(g, order), 0.0)
            rest = self._find(self.backoffs[k], self.hashes(g // SYMBOLS, order), 1.0)
            p = share + rest * p
        return np.log(p)


def probabilities(counts: DataFrame, small: bool = True) -> DataFrame:
    """(lang, a, b, p): P(last symbol | the others) of each counted n-gram of (lang, a, b, n), by language.

    a and b hold two symbols each. Lower orders count the distinct symbols before an n-gram.
    The lowest spreads over the symbols that the language has.
    """
    low = F.lit((1 << BITS) - 1).cast("long")
    none = F.lit(0).cast("long")
    suffixes = {4: (F.col("a").bitwiseAND(low), F.col("b")), 3: (none, F.col("b")), 2: (none, F.col("b").bitwiseAND(low))}
    levels = {ORDER: counts}
    for order in range(ORDER, 1, -1):
        a, b = suffixes[order]
        shorter = levels[order].select("lang", a.alias("a"), b.alias("b")).groupBy("lang", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        levels[order - 1] = stored(shorter, "suffixes")
    below = None
    for order in range(1, ORDER + 1):
        rows = levels[order]
        # Chen and Goodman's discounts: one row a language.
        c = [F.sum((F.col("n") == k).cast("long")).alias(f"c{k}") for k in range(1, 5)]
        of = rows.groupBy("lang").agg(*c, F.count(F.lit(1)).alias("kinds"))
        y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
        full = (F.col("c1") > 0) & (F.col("c2") > 0) & (F.col("c3") > 0) & (F.col("c4") > 0)
        for k, other in ((1, 0.5), (2, 0.75), (3, 0.9)):
            d = k - (k + 1) * y * F.col(f"c{k + 1}") / F.col(f"c{k}")
            of = of.withColumn(f"d{k}", F.when(full, F.least(F.greatest(d, F.lit(0.05)), F.lit(k - 0.05))).otherwise(F.lit(other)))
        of = of.select("lang", "d1", "d2", "d3", "kinds")
        of = F.broadcast(of) if small else of
        rows = rows.withColumn("h", F.shiftright("b", BITS))
        # Integers are summed, so that the order of rows doesn't show.
        parts = [F.sum(x.cast("long")).alias(f"n{k}") for k, x in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") > 2))]
        histories = rows.groupBy("lang", "a", "h").agg(F.sum("n").alias("total"), *parts)
        rows = rows.join(histories, ["lang", "a", "h"]).join(of, "lang")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        left = F.col("n1") * F.col("d1") + F.col("n2") * F.col("d2") + F.col("n3") * F.col("d3")
        rows = rows.withColumns({"share": (F.col("n") - cut) / F.col("total"), "rest": left / F.col("total")})
        if below is None:
            rows = rows.withColumn("q", 1 / F.col("kinds"))
        else:
            a, b = suffixes[order]
            rows = rows.withColumns({"sa": a, "sb": b}).join(below.select("lang", F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("p").alias("q")), ["lang", "sa", "sb"])
        below = stored(rows.select("lang", "a", "b", (F.col("share") + F.col("rest") * F.col("q")).alias("p")), "probabilities")
    return below


_KINDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURES = "doc_id long, lang string, " + ", ".join(f"{k} long" for k in _KINDS) + ", base_failed boolean, n_chars long, log_perplexity double"


def _measure(block: pa.Table, answers: pa.Table) -> pa.Table:
    """One row a document of a block, from the log probabilities of its n-grams."""
    lang, texts = _texts(block)
    rows = [base_counts(x) for x in texts]
    full = [k for k, x in enumerate(texts) if x]
    logs = np.full(len(texts), np.nan)
    if full:
        a, b, which = grams_of([texts[k] for k in full])
        # Shards are ranges of hashes: in their order, the answers are in the order of the hashes.
        got = answers.sort_by("place").column("log_ps").to_pylist()
        value = np.empty(len(a), np.float64)
        value[np.argsort(gram_hashes(lang, a, b))] = np.frombuffer(b"".join(got), np.float32)
        sizes = np.array([len(texts[k]) for k in full])
        logs[full] = -np.add.reduceat(value[which], np.cumsum(sizes) - sizes) / sizes
    cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
    failed = pa.array([base_failed(r[0], r[4]) for r in rows], pa.bool_())
    ids = pa.array(block.column("ids")[0].as_py(), pa.int64())
    return pa.Table.from_arrays([ids, pa.array([lang] * len(texts), pa.string()), *cols, failed, pa.array([len(x) for x in texts], pa.int64()), pa.array(logs, pa.float64(), mask=np.isnan(logs))], ["doc_id", "lang", *_KINDS, "base_failed", "n_chars", "log_perplexity"])


def bands(measured: DataFrame, small: bool = True) -> DataFrame:
    """(lang, center, spread): one row a language, from mergeable quantile sketches."""
    rows = measured.where("log_perplexity is not null and not base_failed")
    centers = rows.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("center"))
    strays = rows.join(F.broadcast(centers) if small else centers, "lang").withColumn("stray", F.abs(F.col("log_perplexity") - F.col("center")) * F.sqrt("n_chars"))
    return strays.groupBy("lang").agg(F.first("center").alias("center"), F.percentile_approx("stray", 0.5, 10_000).alias("spread"))


def judge(docs: DataFrame, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """The contract's columns, with lang, log_perplexity and the band."""
    docs = docs.select("doc_id", "text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    size, languages = docs.agg(F.sum(F.octet_length("text")), F.approx_count_distinct("lang")).first()
    small = languages <= BROADCAST_LANGUAGES
    counts = stored(docs.mapInArrow(_count, "lang string, a long, b long, k long").groupBy("lang", "a", "b").agg(F.sum("k").alias("n")), "gram-counts")
    n_shards, copies = -(-counts.count() // SHARD) or 1, -(-(size or 0) // (BLOCK * ASKERS)) or 1
    hashed = probabilities(counts, small).mapInArrow(_hashed(n_shards), "shard long, hash long, log_p float")
    model = stored(hashed.groupBy("shard").applyInArrow(_shard, "shard long, hashes binary, log_ps binary"), "model")
    # The blocks are shuffled once: asking and measuring share that exchange.
    blocks = docs.mapInArrow(_cut, "block long, lang string, ids array<long>, sizes array<long>, n_bytes long, texts binary")
    asked = blocks.groupBy("block").applyInArrow(_ask(n_shards, copies), "place long, block long, asked binary")
    copied = model.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select((F.col("shard") * copies + F.col("copy")).alias("place"), "hashes", "log_ps")
    answers = asked.groupBy("place").cogroup(copied.groupBy("place")).applyInArrow(_answer, "block long, place long, log_ps binary")
    measured = stored(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_measure, _MEASURES), "perplexities")
    found = bands(measured, small)
    out = measured.join(F.broadcast(found) if small else found, "lang", "left")
    half = F.lit(least) + width * F.col("spread") / F.sqrt(F.greatest(F.col("n_chars"), F.lit(1)))
    out = out.withColumns({"low": F.col("center") - half, "high": F.col("center") + half}).drop("center", "spread")
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    kept = F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept")
    return out.select("doc_id", *_KINDS, "base_failed", kept, "lang", "n_chars", "log_perplexity", "low", "high")
