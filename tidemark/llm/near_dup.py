"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Signatures. A document's shingles (five words, lower case) are weighted by 1 + ln(count).
Each shingle is a Poisson process of arrivals whose rate is its weight; an arrival falls into
a random register, and every register keeps the shingle of its first arrival. Two registers
agree with the probability Jaccard similarity. Arrivals are generated in rounds, all shingles
of a batch at once, and a shingle stops as soon as its last arrival is later than everything
its document's registers still wait for, so few rounds are needed.

Candidates. Registers are cut into bands; documents with an equal band share a bucket. A text
with repeated shingles also has the bands of its signature with all weights 1 (that of a text
without repeats is the same with either weights), so any two texts have bands whose registers
agree with the Jaccard similarity that is verified, however often a line is repeated. Equal
texts are one vertex before that. Buckets of at most SMALL members give all their pairs;
larger ones give stars: every member with the bucket's *hub* (the member with most bucket
mates over all bands) and with its smallest id. What a star leaves open is settled in rounds:
from each large bucket the representatives of the components that are still apart are taken
again, until no new link is found. Rows stay linear in bucket members. What is then still
apart in a large bucket goes through an exact prefix join: its shingles are ordered rarest
first, two texts at the threshold share one of their first n - ceil(threshold * n) + 1
shingles, and the pairs of different components that do so are candidates. So every pair
that shares a band is either in one class or has been ruled out.

Verification. Every candidate pair is checked by the Jaccard similarity of its two whole
shingle sets; links are the pairs at or above the threshold, classes are their connected
components, found by label propagation with pointer jumping.

Vertices are the distinct texts (equal words in lower case), numbered in a written table;
doc_id is no row's identity. Rows with equal ids and different texts are linked or not by
their texts like any others.

Defined edge cases: a text with less than five words is one shingle; texts without words are
never linked, their class is their own id; equal texts are one class, whatever their length;
a row with a null doc_id is a member like any other, and a class of such rows only has a null
class_id; of rows with equal ids and equal texts firsts() keeps one, and of a class without
any id one row; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free_name, mix, slices, stored, texts_of, tidied

WORDS, THRESHOLD = 5, 0.8
#: A pair at the threshold agrees in no unit-weight band with probability (1 - 0.8**5) ** 24 = 0.00007.
BANDS, ROWS = 24, 5
SMALL = 16
#: Rounds of stars before the prefix join; any number gives the same classes.
ROUNDS = 4
#: Slots of the counts that order shingles by frequency: 8 MB, whatever the corpus; any number gives the same classes.
SLOTS = 1 << 20
_SLOT_SHIFT = np.uint64(44)
#: 64-bit words of the parity bitmap of a shingle set; any number gives the same classes.
PARITY_WORDS = 8
_HELD = 400_000
#: A character that str.split() doesn't split at, so a word, in the regular expressions of Java.
_WORD = "[^\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles_of(texts: list[str], table: _WordHashes, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Shingle hashes of all texts in a row, the text of each, and the number of words of each text."""
    if len(table) > _HELD:
        table.clear()
    words = [x.lower().split() for x in texts]
    sizes = [len(w) for w in words]
    h = np.array([table[x] for w in words for x in w], np.uint64)
    n = np.array(sizes, np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(texts)), count)
    first = np.arange(len(doc)) - (np.cumsum(count) - count)[doc] + starts[doc]
    out = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            inside = first + k < ends[doc]
            w = h[np.minimum(first + k, max(0, len(h) - 1))] if len(h) else out
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, w, np.uint64(k + 1)))
    return out, doc, sizes


def weighted(shingles: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their text, their counts."""
    if not len(shingles):
        return shingles, doc, np.empty(0, np.int64)
    order = np.lexsort((shingles, doc))
    s, d = shingles[order], doc[order]
    first = np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])).nonzero()[0]
    return s[first], d[first], np.diff(np.append(first, len(s)))


def prob_min_hash(shingles: np.ndarray, doc: np.ndarray, weights: np.ndarray, n_docs: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """uint32 signatures (n_docs, registers); texts without shingles hold the highest value.

    shingles are distinct within a text; doc does not fall.
    """
    best = np.full(n_docs * registers, np.iinfo(np.uint64).max, np.uint64)
    time = np.zeros(len(shingles))
    live = np.arange(len(shingles))
    name = (shingles >> np.uint64(32)).astype(np.uint64)
    step = 0
    while len(live):
        step += 1
        with np.errstate(over="ignore"):
            r = mix(shingles[live] + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
        # 40 bits are the waiting time, the others the register.
        u = ((r >> np.uint64(24)).astype(np.float64) + 0.5) / (1 << 40)
        time[live] -= np.log(u) / weights[live]
        register = ((r & np.uint64(0xFFFFFF)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64)
        # Positive floats order as their bits do: first the arrival, then the shingle.
        arrival = time[live].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | name[live]
        np.minimum.at(best, doc[live] * registers + register, arrival)
        # A text's registers wait for nothing later than the latest of their first arrivals.
        docs = np.unique(doc[live])
        waits = np.zeros(n_docs, np.float64)
        latest = best.reshape(n_docs, registers)[docs].max(1)
        stop = np.where(latest == np.iinfo(np.uint64).max, np.inf, (latest >> np.uint64(32)).astype(np.uint32).view(np.float32).astype(np.float64))
        waits[docs] = stop
        live = live[time[live] <= waits[doc[live]]]
    return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n_docs, registers)


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band."""
    keys = np.zeros((len(signature), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            keys = mix(keys * np.uint64(31) + signature[:, k::rows][:, :bands] + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x100000001B3))
    return keys


def _sign(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _WordHashes()
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in slices((len(x) for x in texts), 2 << 20):
                raw, doc, sizes = shingles_of(texts[a:b], table, width)
                s, d, n = weighted(raw, doc)
                keys = _band_keys(prob_min_hash(s, d, 1 + np.log(n), b - a, bands * rows), bands, rows)
                # Links are by the plain sets: texts with repeated shingles get the bands of unit weights too.
                again = np.unique(d[n > 1])
                held = np.isin(d, again)
                plain = _band_keys(prob_min_hash(s[held], np.searchsorted(again, d[held]), np.ones(held.sum()), len(again), bands * rows), bands, rows)
                owner = np.concatenate([np.arange(b - a), again])
                flat = np.concatenate([keys, plain])[np.argsort(owner, kind="stable")]
                ends = np.cumsum(np.bincount(owner, minlength=b - a) * bands)
                # The identity of the text as words: two hashes of its shingles in order.
                ks = [xxhash.xxh3_128_intdigest(" ".join(x.lower().split()).encode("utf-8", "surrogatepass")) for x in texts[a:b]]
                signed = lambda x: x - (1 << 64) * (x >> 63)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("row_key").slice(a, b - a), pa.array([signed(x >> 64) for x in ks], pa.int64()), pa.array([signed(x & (1 << 64) - 1) for x in ks], pa.int64()), pa.array(sizes, pa.int64()), lists],
                    ["doc_id", "row_key", "k1", "k2", "n_words", "bands"],
                )

    return run


#: Bits of the filter that spares documents without candidates: 2 MB at most, whatever the corpus.
FILTER_BITS = 1 << 24


def _filter_of(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter (two hashes) of the ids as 64-bit words, combined by Spark: bits // 64 rows at most come back.

    It is of a fixed size. As it fills up it passes more documents on; it never drops one.
    """
    at = ids.select(F.explode(F.array(*_places(bits))).alias("p"))
    word, bit = F.shiftright("p", 6), F.expr("shiftleft(1L, cast(p & 63 as int))")
    rows = at.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(np.uint64)


def _places(bits: int) -> list:
    return [F.pmod(F.xxhash64(F.lit(k), "doc_id", "row_key"), F.lit(bits)).cast("long").alias(f"p{k}") for k in range(2)]


def _sets(width: int, shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = _WordHashes(), shipped.value
        for batch in batches:
            inside = np.ones(len(batch), bool)
            for k in range(2):
                p = batch.column(f"p{k}").to_numpy(zero_copy_only=False).astype(np.uint64)
                inside &= (held[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
            batch = batch.filter(pa.array(inside))
            texts = texts_of(batch, "text")
            for a, b in slices((len(x) for x in texts), 2 << 20):
                raw, doc, _ = shingles_of(texts[a:b], table, width)
                s, d, _ = weighted(raw, doc)
                cuts = np.searchsorted(d, np.arange(b - a + 1))
                sets = [s[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("row_key").slice(a, b - a), pa.array(sets, pa.binary())], ["doc_id", "row_key", "shingles"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = sorted((len(x), len(y)))
                if small < threshold * large:
                    keep.append(False)
                    continue
                both = small + large - len(np.unique(np.concatenate([x, y])))
                keep.append(both >= threshold * (small + large - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for each node of the links (a, b).

    Label propagation with pointer jumping; every round is a written table, so that a lost
    executor costs one round. Hot labels are split by AQE's skew join.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("least"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "least").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = stored(new.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        discard(labels)
        labels = new.drop("moved")
        labels._tidemark_path = new._tidemark_path
        if not moved:
            discard(both)
            return labels


def _pairs_of(members: DataFrame, small: int) -> DataFrame:
    """Candidate pairs a < b of (bucket, id, mates): all of small buckets, stars of large ones."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max_by("id", F.struct("mates", -F.col("id"))).alias("hub")).where("n > 1")
    few = members.join(sizes.where(F.col("n") <= small).select("bucket"), "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    few = few.select(F.posexplode("ids").alias("i", "a"), "ids").select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))
    many = members.join(sizes.where(F.col("n") > small), "bucket").select("id", F.explode(F.array_distinct(F.array("least", "hub"))).alias("other")).where("id != other")
    return few.unionByName(many.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))).distinct()


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of the sets fall into each slot."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        # All sets of a batch at once: they lie in a row.
        s = np.frombuffer(b"".join([x.as_buffer() for x in batch.column("shingles")]), np.uint64)
        slot, n = np.unique((s >> _SLOT_SHIFT).astype(np.int64), return_counts=True)
        counts[slot] += n
    (slot,) = counts.nonzero()
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], ["slot", "n"])


def _frequencies(sets: DataFrame) -> np.ndarray:
    """Shingles by slot, summed by Spark: SLOTS rows at most come back, whatever the corpus."""
    rows = sets.mapInArrow(tidied(_slot_counts), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def _prefixes(threshold: float, words: int, shipped):
    """One row for each shingle of a set's prefix, with the set's size and parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shipped.value
        for batch in batches:
            of, n, at, shingle, maps = [], [], [], [], []
            for k, x in enumerate(batch.column("shingles")):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                f = frequency[(s >> _SLOT_SHIFT).astype(np.int64)]
                # One order for all sets: rare slots first.
                order = np.lexsort((s, f))[: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1]
                (where,) = (f[order] > 1).nonzero()
                parity = np.zeros(max(words, 1), np.uint64)
                np.bitwise_xor.at(parity, ((s >> np.uint64(6)) % np.uint64(max(words, 1))).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
                of.append(np.full(len(where), k))
                n.append(np.full(len(where), len(s)))
                at.append(where)
                shingle.append(s[order[where]])
                maps.append(parity[:words])
            if not of:
                continue
            of = np.concatenate(of)
            maps = np.array(maps).view(np.int64)[of]
            columns = [batch.column(c).take(pa.array(of)) for c in ("id", "label", "buckets")]
            columns += [pa.array(np.concatenate(x).astype(np.uint64).view(np.int64)) for x in (n, at, shingle)]
            columns += [pa.array(maps[:, k]) for k in range(words)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "buckets", "n", "at", "shingle", *(f"m{k}" for k in range(words))])

    return run


def _apart(large: DataFrame) -> DataFrame:
    """(id, label, buckets): members of buckets with several labels, and those buckets, from (bucket, id, label)."""
    mixed = large.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    # Twice as many buckets as bands, at most.
    return large.join(mixed.select("bucket"), "bucket", "left_semi").groupBy("id", "label").agg(F.collect_set("bucket").alias("buckets"))


def _prefix_pairs(apart: DataFrame, sets: DataFrame, threshold: float, words: int = PARITY_WORDS) -> DataFrame:
    """Pairs a < b of different labels with a common bucket that may reach the threshold.

    apart: (id, label, buckets). Prefix and positional filtering over the shingles, those of rare
    slots first (any order that all sets share gives the same pairs in the end): at the first shingle two sets share, they can share no more than what follows in
    the shorter rest. A shingle of one label gives no pair. Shared passages are frequent, so
    they stay out of prefixes. Parity bitmaps bound the overlap too: two sets differ in at
    least as many shingles as their bitmaps differ in bits. No bound rules out a pair at the
    threshold.
    """
    rows = stored(apart.join(sets, "id"), "apart-sets")
    shipped = rows.sparkSession.sparkContext.broadcast(_frequencies(rows.select("shingles")))
    maps = [f"m{k}" for k in range(words)]
    schema = "id long, label long, buckets array<long>, n long, at long, shingle long" + "".join(f", {m} long" for m in maps)
    prefix = stored(rows.mapInArrow(tidied(_prefixes(threshold, words, shipped)), schema), "prefixes")
    several = prefix.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("shingle")
    kept = prefix.join(several, "shingle", "left_semi")
    a = kept.select("shingle", F.col("id").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("buckets").alias("ba"), *[F.col(m).alias(f"a{m}") for m in maps])
    b = kept.select("shingle", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("buckets").alias("bb"), *[F.col(m).alias(f"b{m}") for m in maps])
    need = F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-6
    may = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need
    differ = sum((F.bit_count(F.col(f"a{m}").bitwiseXOR(F.col(f"b{m}"))) for m in maps), F.lit(0))
    may &= F.col("na") + F.col("nb") - differ >= 2 * need
    near = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & may & F.arrays_overlap("ba", "bb")
    return a.join(b, "shingle").where(near).select("a", "b").distinct()


def _row_key():
    """Identifies a row among those of equal ids: a hash of its raw text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _order():
    """Its least value is the row of smallest id; those without an id are last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")


def _signatures(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    keyed = docs.select("doc_id", "text", _row_key().alias("row_key"))
    return stored(keyed.mapInArrow(tidied(_sign(bands, rows, width)), "doc_id long, row_key long, k1 long, k2 long, n_words long, bands array<long>"), "signatures")


def _vertices(signed: DataFrame) -> DataFrame:
    """(id, k1, k2, doc_id, row_key, n_words): one row a distinct text, with its first row. The numbers are fixed as they are written."""
    first = signed.groupBy("k1", "k2").agg(F.min(_order()).alias("first"), F.max("n_words").alias("n_words"))
    return stored(first.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "first.doc_id", "first.row_key", "n_words"), "texts")


def _components_of(docs: DataFrame, texts: DataFrame, signed: DataFrame, threshold: float, width: int, small: int, rounds: int) -> DataFrame:
    """(node, label) of the texts that have links."""
    # One row a text. The semi join is on the first row too, so equal texts do not pile up on one key.
    one = texts.where("n_words > 0").select("k1", "k2", "row_key", F.col("doc_id").alias("of"), "id")
    one = signed.join(one, (signed.k1 == one.k1) & (signed.k2 == one.k2) & (signed.row_key == one.row_key) & signed.doc_id.eqNullSafe(one.of))
    exploded = one.select("id", F.explode("bands").alias("bucket")).distinct()
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = members = stored(exploded.join(shared, "bucket"), "buckets")
    mates = stored(members.groupBy("id").agg(F.sum("n").alias("mates")), "mates")
    members = members.join(mates, "id").select("bucket", "id", "mates", "n")
    # Texts stay where they are: only the shingle sets of rows with candidates are shuffled.
    with_mates = texts.join(mates.select("id"), "id", "left_semi").select("id", "doc_id", "row_key")
    shipped = docs.sparkSession.sparkContext.broadcast(_filter_of(with_mates))
    with_places = docs.select("doc_id", "text", _row_key().alias("row_key")).withColumns({f"p{k}": x for k, x in enumerate(_places(FILTER_BITS))})
    every = with_places.mapInArrow(tidied(_sets(width, shipped)), "doc_id long, row_key long, shingles binary")
    of = with_mates.withColumnRenamed("doc_id", "of").withColumnRenamed("row_key", "of_key")
    # Repeated rows give the same set again.
    sets = every.join(of, every.doc_id.eqNullSafe(of.of) & (every.row_key == of.of_key)).groupBy("id").agg(F.first("shingles").alias("shingles"))
    sets = stored(sets, "shingle-sets")
    done = [buckets, mates, sets]  # what nothing reads once the labels are written

    def kept(df: DataFrame, what: str) -> DataFrame:
        done.append(out := stored(df, what))
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
        with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
        return kept(with_b.select("a", "b", "set_a", "set_b").mapInArrow(tidied(_verify(threshold)), "a long, b long"), "verified")

    def labelled(labels: DataFrame) -> DataFrame:
        large = members.where(F.col("n") > small).join(labels.withColumnRenamed("node", "id"), "id", "left")
        return large.withColumn("label", F.coalesce("label", "id"))

    tried = kept(_pairs_of(members, small), "pairs")
    links = verified(tried)
    labels = components(links)
    for _ in range(rounds):
        # Of each large bucket, the member of each component that has most mates.
        apart = labelled(labels).groupBy("bucket", "label").agg(F.max_by("id", F.struct("mates", -F.col("id"))).alias("id"), F.max("mates").alias("mates"))
        pairs = _pairs_of(apart.select("bucket", "id", "mates"), small).join(tried, ["a", "b"], "left_anti")
        pairs = kept(pairs, "pairs")
        if not pairs.limit(1).count():
            break
        more = verified(pairs)
        tried, links = tried.unionByName(pairs), links.unionByName(more)
        if not more.limit(1).count():
            break
        done.append(labels)
        labels = components(links)
    rest = kept(_apart(labelled(labels)), "apart")
    if rest.limit(1).count():
        more = verified(kept(_prefix_pairs(rest, sets, threshold).join(tried, ["a", "b"], "left_anti"), "pairs"))
        if more.limit(1).count():
            done.append(labels)
            labels = components(links.unionByName(more))
    discard(*done)
    return labels


def _classified(docs: DataFrame, threshold: float, width: int, bands: int, rows: int, small: int, rounds: int) -> DataFrame:
    """(doc_id, row_key, n_words, label, class_id, first): each row with its class, and whether it is the row that stays."""
    docs = docs.select("doc_id", "text")
    signed = _signatures(docs, bands, rows, width)
    texts = _vertices(signed)
    labels = _components_of(docs, texts, signed, threshold, width, small, rounds)
    named = texts.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    first = named.groupBy("label").agg(F.min(_order()).alias("first"))
    named = named.join(first, "label").select("k1", "k2", F.col("n_words").alias("words"), "label", "first")
    out = signed.select("doc_id", "row_key", "n_words", "k1", "k2").join(named, ["k1", "k2"])
    empty = F.col("n_words") == 0
    class_id = F.when(empty, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    is_first = empty | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key")))
    return out.select("doc_id", "row_key", "n_words", class_id.alias("class_id"), is_first.alias("first"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WORDS, bands: int = BANDS, rows: int = ROWS, small: int = SMALL, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, class_id, is_first) for each row of docs: class_id is the smallest doc_id of its class."""
    out = _classified(docs, threshold, width, bands, rows, small, rounds)
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_first"))


def firsts(docs: DataFrame, threshold: float = THRESHOLD, width: int = WORDS, bands: int = BANDS, rows: int = ROWS, small: int = SMALL, rounds: int = ROUNDS) -> DataFrame:
    """docs with all their columns: of each class one row, that of its smallest doc_id.

    Rows without words are no copies of each other and stay.
    """
    found = _classified(docs, threshold, width, bands, rows, small, rounds)
    of = found.where("first and n_words > 0").groupBy(F.col("doc_id").alias("of"), F.col("row_key").alias("of_key"))
    key, words, times = (free_name(docs.columns, x) for x in ("row key", "has words", "times"))
    keep = stored(of.agg(F.count(F.lit(1)).alias(times)), "firsts").alias("keep")
    keyed = docs.withColumns({key: _row_key(), words: F.coalesce(F.col("text"), F.lit("")).rlike(_WORD)})
    same = F.col("doc_id").eqNullSafe(F.col("keep.of")) & (F.col(key) == F.col("keep.of_key"))
    once, again = (keyed.where(F.col(words)).join(keep, same).where(x) for x in (F.col(times) == 1, F.col(times) > 1))
    # Only repeated rows are shuffled to leave one of each.
    rows_of = [x.select(*keyed.columns) for x in (once, again)]
    return rows_of[0].unionByName(rows_of[1].dropDuplicates(["doc_id", key])).unionByName(keyed.where(~F.col(words))).select(*docs.columns)


def reference(rows: list[tuple], threshold: float = THRESHOLD, width: int = WORDS) -> list[int | None]:
    """Brute force for tests: the class id of each row (doc_id, text), over all pairs of texts."""
    words = [tuple((t or "").lower().split()) for _, t in rows]
    keys = [k for k in dict.fromkeys(words) if k]
    number = {k: i for i, k in enumerate(keys)}
    sets = [{k[i : i + width] for i in range(max(1, len(k) - width + 1))} for k in keys]
    parent = list(range(len(keys)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for (d, _), k in zip(rows, words, strict=True):
        if k and d is not None:
            least[root(number[k])] = min(least.get(root(number[k]), d), d)
    return [least.get(root(number[k])) if k else d for (d, _), k in zip(rows, words, strict=True)]
