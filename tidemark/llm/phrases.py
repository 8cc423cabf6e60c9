"""Phrase collocations of each language, over dictionary-encoded words.

Texts are cut into blocks, each with a dictionary of its own, and the blocks' word counts add up to
the corpus dictionary: words of at least ``min_count`` occurrences in their language, with dense
31-bit ids. Blocks get the ids of their words by a join (no dictionary is broadcast), other words
break pieces. Two ids are one 62-bit key, three are such a key and a third id. Each block sorts its
keys by 16-bit digits and counts runs; the runs are range-partitioned by key, sorted and counted
again, as streams. So a frequent phrase crosses the shuffle once a block.

A phrase of three words is only counted where both of its pairs are frequent, which a bit table of
fixed size tells (2**FILTER_BITS bits, the only thing that goes to all tasks). A bit that
another pair set costs time, not correctness: counts are of the exact keys. In corpora with more
frequent pairs than bits, the table holds less and less back, and results stay the same.

Scores are exact: a * a * 1000000 and l * r are decimals of 38 digits (counts up to 10**16).

Defined edge cases: null text is empty, null lang is ``und``; doc_id, repeated ids and other columns
do not matter, each row counts; a text longer than a block is cut at a break between pieces if it
has one; languages without phrases give no rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, mix, stored

BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
MIN_COUNT, WITHIN_PERCENT, TOP = 10, 50, 2000
BLOCK_BYTES = 32 << 20
ID_BITS = 31
FILTER_BITS = 26
_CHUNK_BITS = 15
#: Parts of a language whose best phrases are found apart.
PARTS = 64

_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(BREAKS)] = 2
_BREAK = re.compile(b"[" + re.escape(BREAKS) + b"]")


def encode(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, their counts, codes): a code is a word's place from 1 on, and 0 a break between pieces."""
    raw = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    kind = _KIND[raw]
    inside = np.concatenate([[False], kind == 0, [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    starts = starts[: len(ends)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[kind == 0].tobytes())).dictionary_encode()
    places = words.indices.to_numpy().astype(np.int64)
    piece = np.cumsum(kind == 2)[starts] if len(starts) else starts
    broken = np.concatenate([[False], piece[1:] != piece[:-1]]) if len(starts) else np.zeros(0, bool)
    codes = np.zeros(len(starts) + int(broken.sum()), np.int32)
    codes[np.arange(len(starts)) + np.cumsum(broken)] = places + 1
    return words.dictionary, np.bincount(places, minlength=len(words.dictionary)), codes


def _cut(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in parts of about limit bytes, cut at breaks between pieces."""
    while len(text) > limit:
        found = _BREAK.search(text, limit)
        if not found:
            break
        yield text[: found.start()]
        text = text[found.end() :]
    yield text


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def out(lang: str) -> pa.RecordBatch:
            nonlocal n
            words, counts, codes = encode(held.pop(lang))
            sizes.pop(lang)
            n += 1
            columns = [pa.array([task + n]), pa.array([lang]), pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([codes.tobytes()])]
            return pa.RecordBatch.from_arrays(columns, ["block", "lang", "words", "counts", "codes"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for part in _cut(text.encode(), limit):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                    if sum(sizes.values()) >= limit:
                        yield out(max(sizes, key=sizes.get))
        for lang in list(held):
            yield out(lang)

    return run


def blocks(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """(block, lang, words, counts, codes) of all texts, in the shared folder."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(rows.mapInArrow(_blocks(limit), "block long, lang string, words array<string>, counts array<long>, codes binary"), "phrase-blocks")


def dictionary(blocks: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, word, f, id) of the frequent words, in the shared folder; ids are dense, from 1."""
    rows = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    counts = rows.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f")).where(F.col("f") >= min_count)
    placed = stored(counts.withColumn("at", F.monotonically_increasing_id()), "phrase-words")
    part = F.shiftright("at", 33)
    # One row a partition: the ids of a partition begin after those of the partitions before it.
    begins = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    begins = begins.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    numbered = placed.join(begins, part == F.col("part")).select("lang", "word", "f", (F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("id"))
    found = stored(numbered.withColumn("id", F.when(F.col("id") < 1 << ID_BITS, F.col("id")).otherwise(F.raise_error(F.lit("too many frequent words for 31-bit ids")))), "phrase-dictionary")
    discard(placed)
    return found


def _renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, codes, places, ids in zip(*(batch.column(c).to_pylist() for c in ("block", "codes", "places", "ids")), strict=True):
            codes = np.frombuffer(codes, np.int32)
            table = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
            table[np.array(places or [], np.int64)] = np.array(ids or [], np.int64)
            known = table[codes]
            # Of neighbouring breaks one is enough.
            known = known[np.concatenate([[True], (known[1:] != 0) | (known[:-1] != 0)])] if len(known) else known
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([known.tobytes()])], ["block", "ids"])


def encoded(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """(block, ids): the blocks in ids of the dictionary, 0 where a piece ends or a word isn't in it."""
    asked = blocks.select("block", "lang", F.posexplode("words").alias("place", "word"))
    found = asked.join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct((F.col("place") + 1).alias("place"), "id")).alias("x"))
    rows = blocks.select("block", "codes").join(found.withColumnRenamed("block", "b"), F.col("block") == F.col("b"))
    rows = rows.select("block", "codes", F.col("x.place").alias("places"), F.col("x.id").alias("ids"))
    return stored(rows.mapInArrow(_renumber, "block long, ids binary"), "phrase-ids")


def radix_order(*columns: np.ndarray) -> np.ndarray:
    """The order that sorts by the columns, the first one first: stable passes over 16-bit digits from the last on.

    numpy sorts 16-bit numbers by radix; digits that are all equal need no pass.
    """
    order = None
    for column in reversed(columns):
        for shift in range(0, int(column.max(initial=0)).bit_length(), 16):
            digit = (column >> shift).astype(np.uint16)
            step = np.argsort(digit if order is None else digit[order], kind="stable")
            order = step if order is None else order[step]
    return np.arange(len(columns[0])) if order is None else order


def count_runs(k1: np.ndarray, k2: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys and the sums (or numbers) of their runs."""
    new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]).nonzero()[0] if len(k1) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(k1))) if weights is None else np.add.reduceat(weights, new) if len(new) else new
    return k1[new], k2[new], n


def _keys(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of ``size`` ids without a break; the second one is 0 for pairs."""
    ids = ids.astype(np.int64)
    near = [ids[k : len(ids) - size + 1 + k] for k in range(size)] if len(ids) >= size else [ids[:0]] * size
    whole = np.logical_and.reduce([x != 0 for x in near])
    first, second, *third = (x[whole] for x in near)
    return first << ID_BITS | second, third[0] if third else np.zeros(len(first), np.int64)


def _slots(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _batch(k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64())], ["k1", "k2", "n"])


def _block_counts(size: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bits is None else np.unpackbits(np.frombuffer(bits.value, np.uint8)).view(bool)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                k1, k2 = _keys(np.frombuffer(ids, np.int32), size)
                if table is not None:
                    good = table[_slots(k1)] & table[_slots((k1 & (1 << ID_BITS) - 1) << ID_BITS | k2)]
                    k1, k2 = k1[good], k2[good]
                order = radix_order(k1, k2)
                found = count_runs(k1[order], k2[order])
                for begin in range(0, len(found[0]), 1 << 16):
                    yield _batch(*(x[begin : begin + (1 << 16)] for x in found))

    return run


def _sum_runs(min_count: int):
    """Sorted rows to sums of their runs; a run may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            parts = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("k1", "k2", "n"), strict=True)]
            k1, k2, n = count_runs(*parts)
            held = k1[-1:], k2[-1:], n[-1:]
            often = n[:-1] >= min_count
            if often.any():
                yield _batch(k1[:-1][often], k2[:-1][often], n[:-1][often])
        if len(held[0]) and held[2][0] >= min_count:
            yield _batch(*held)

    return run


def counted(ids: DataFrame, size: int, min_count: int, bits=None) -> DataFrame:
    """(k1, k2, n) of the phrases of ``size`` words with at least min_count occurrences, in the shared folder."""
    runs = ids.mapInArrow(_block_counts(size, bits), "k1 long, k2 long, n long")
    dealt = runs.repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2")
    return stored(dealt.mapInArrow(_sum_runs(min_count), "k1 long, k2 long, n long"), f"phrases-{size}")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of the bit table that the keys of a task set."""
    table: dict[int, np.ndarray] = {}
    for batch in batches:
        slots = np.unique(_slots(batch.column("k1").to_numpy(zero_copy_only=False)))
        for chunk in np.unique(slots >> _CHUNK_BITS).tolist():
            bits = table.setdefault(chunk, np.zeros(1 << _CHUNK_BITS, bool))
            bits[slots[slots >> _CHUNK_BITS == chunk] & (1 << _CHUNK_BITS) - 1] = True
    if table:
        yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.int64()), pa.array([np.packbits(x).tobytes() for x in table.values()])], ["chunk", "bits"])


def _merge_chunks(table: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([bits.tobytes()])})


def pair_bits(pairs: DataFrame) -> bytes:
    """The bit table of the pairs' slots, 2**FILTER_BITS bits whatever their number."""
    chunks = pairs.select("k1").mapInArrow(_chunks, "chunk long, bits binary").groupBy("chunk").applyInArrow(_merge_chunks, "chunk long, bits binary")
    out = bytearray(1 << FILTER_BITS - 3)
    size = 1 << _CHUNK_BITS - 3
    for row in chunks.toLocalIterator():
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = row["bits"]
    return bytes(out)


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    big = lambda x: x.cast("decimal(38,0)")
    return F.call_function("div", big(a.cast("decimal(16,0)") * a.cast("decimal(16,0)")) * F.lit(1_000_000).cast("decimal(7,0)"), big(l.cast("decimal(19,0)") * r.cast("decimal(19,0)")))


def scored(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, k1, k2) of all candidates, each with its lowest-scoring cut."""
    mask = (1 << ID_BITS) - 1
    first, second = F.shiftright("k1", ID_BITS), F.col("k1").bitwiseAND(mask)
    word = lambda n: words.select(F.col("id").alias(f"i{n}"), F.col("lang").alias(f"lang{n}"), F.col("word").alias(f"w{n}"), F.col("f").alias(f"f{n}"))
    pair = lambda n: pairs.select(F.col("k1").alias(f"p{n}"), F.col("n").alias(f"g{n}"))
    twos = pairs.withColumn("i1", first).withColumn("i2", second).join(word(1), "i1").join(word(2), "i2")
    twos = twos.select(F.col("lang1").alias("lang"), F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("n"), F.col("f1"), F.col("f2")).alias("score"), "k1", "k2")
    threes = triples.withColumn("i1", first).withColumn("i2", second).withColumn("i3", F.col("k2")).withColumn("p1", F.col("k1")).withColumn("p2", F.shiftleft("i2", ID_BITS).bitwiseOR(F.col("k2")))
    threes = threes.join(pair(1), "p1").join(pair(2), "p2").join(word(1), "i1").join(word(2).drop("f2"), "i2").join(word(3), "i3")
    cut1 = F.struct(_score(F.col("n"), F.col("f1"), F.col("g2")).alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("g2").alias("r"))
    cut2 = F.struct(_score(F.col("n"), F.col("g1"), F.col("f3")).alias("score"), F.lit(2).alias("k"), F.col("g1").alias("l"), F.col("f3").alias("r"))
    threes = threes.withColumn("cut", F.least(cut1, cut2))
    threes = threes.select(F.col("lang1").alias("lang"), F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), "k1", "k2")
    return twos.unionByName(threes)


def top_phrases(docs: DataFrame, min_count: int = MIN_COUNT, within_percent: int = WITHIN_PERCENT, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two or three words."""
    parts = blocks(docs, block_bytes)
    words = dictionary(parts, min_count)
    totals = stored(parts.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")), "phrase-totals")
    ids = encoded(parts, words)
    discard(parts)
    pairs = counted(ids, 2, min_count)
    triples = counted(ids, 3, min_count, docs.sparkSession.sparkContext.broadcast(pair_bits(pairs)))
    discard(ids)
    mask = (1 << ID_BITS) - 1
    longer = triples.select(F.explode(F.array("k1", F.shiftleft(F.col("k1").bitwiseAND(mask), ID_BITS).bitwiseOR(F.col("k2")))).alias("inner"), "n")
    longer = longer.groupBy("inner").agg(F.max("n").alias("most"))
    found = scored(words, pairs, triples)
    kept = found.join(longer, (F.col("k1") == F.col("inner")) & (F.col("k2") == 0), "left").where(F.col("most").isNull() | (100 * F.col("most") < within_percent * F.col("a")))
    # First the best of each part of a language, so that its last sort has PARTS * top rows at most.
    order = (F.desc("score"), F.desc("a"), "phrase")
    ranked = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    best = ranked(ranked(kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "part"), "lang")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT lang, doc, i AS piece, unnest(regexp_extract_all(p, '[^\x20\x09]+')) AS word, generate_subscripts(regexp_extract_all(p, '[^\x20\x09]+'), 1) AS place
  FROM (SELECT lang, doc, unnest(x) AS p, generate_subscripts(x, 1) AS i
        FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
                     string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS x
              FROM documents))),
near AS (SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM pieces WINDOW o AS (PARTITION BY doc, piece ORDER BY place)),
n AS (SELECT lang, count(*) AS n FROM near GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM near GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM near WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM near WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, w1, w2, NULL AS w3, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, f FROM f1) y USING (lang, w2)
  UNION ALL SELECT lang, w1, w2, w3, f3.f, 1, x.f, y.f
  FROM f3 JOIN f1 x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, w2 AS w3, f FROM f2) y USING (lang, w2, w3)
  UNION ALL SELECT lang, w1, w2, w3, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x USING (lang, w1, w2) JOIN (SELECT lang, w1 AS w3, f FROM f1) y USING (lang, w3)),
scores AS (SELECT *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint AS score FROM cuts),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, k) = 1),
longer AS (
  SELECT lang, w1, w2, max(f) AS most
  FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY lang, w1, w2),
kept AS (
  SELECT b.lang, CASE WHEN w3 IS NULL THEN b.w1 || ' ' || b.w2 ELSE b.w1 || ' ' || b.w2 || ' ' || w3 END AS phrase, a, l, r, score
  FROM best b LEFT JOIN longer g ON b.lang = g.lang AND b.w1 = g.w1 AND b.w2 = g.w2 AND w3 IS NULL
  WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER o <= 2000
"""
