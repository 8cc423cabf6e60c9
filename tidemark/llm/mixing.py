"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source is a queue of its documents in shuffled order (a hash of the id), ``repeats`` times
over. A document waits in it as pieces of at most ``piece`` words, as a link cuts long packets,
and a piece's virtual finish time is the words of its source up to its end, divided by the
source's target. Sorted by finish time, all sources reach their targets together (at time 1),
whatever their sizes. The sorted pieces are cut where their running total passes the budget, so
a source ends within about one piece of its target.

No source is one task: running totals are sums over slices of the hash, and within a slice. The
cut is found by ranges of virtual time: words are summed by range, the range that holds the
budget's end is divided again until it holds few pieces, and only these are sorted.

Targets share the budget by weight, but none is above ``repeats`` times its source; what is
above goes to the others by weight. Sources in falling need of repeats (limit by weight) are
limited one after another, which is where resharing ends.

Defined edge cases: a null text has no words; a null source is a source of its own, after all
others; rows with equal ids are documents of their own (equal in order, so of equal size they
are interchangeable), as are those without an id; an empty table gives no rows; a document
without words takes none; sources without words have target 0. There is one row a source in
one task (ranks and targets), so the number of sources must fit a task, not their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, REPEATS = (3.0, 1.0, 2.0), 1.5, 2
#: Words a piece; rows a slice of a source (and slices at least); ranges a division; pieces that are sorted at once.
PIECE, SLICE_ROWS, LEAST_SLICES, RANGES, SORTED = 64, 1 << 15, 256, 1024, 20_000


def sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, no_source, source, size, h): words and a 60-bit hash of the id; ``no_source`` tells a null source from an empty name."""
    spread = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15)
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    return docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        words.alias("size"),
        F.conv(spread, 16, 10).cast("long").alias("h"),
    )


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(no_source, source, ord, source_size, target) of one (no_source, source, source_size) row a source."""
    by_name, whole = Window.orderBy("no_source", "source"), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("ord", F.row_number().over(by_name))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("ord") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("w", w).withColumn("most", F.lit(repeats) * F.col("source_size"))
    before = Window.orderBy(F.col("most") / F.col("w"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(float(share))).alias("budget"),
        F.sum("w").over(whole).alias("all_w"),
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("most_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
    )
    held = (F.col("budget") - F.col("most_before")) * F.col("w") >= F.col("most") * (F.col("all_w") - F.col("w_before"))
    ranked = ranked.withColumn("held", held)
    left = F.col("budget") - F.sum(F.when(F.col("held"), F.col("most")).otherwise(0)).over(whole)
    free = F.sum(F.when(F.col("held"), 0.0).otherwise(F.col("w"))).over(whole)
    target = F.when(F.col("held"), F.col("most").cast("double")).otherwise(F.try_divide(left, free) * F.col("w"))
    return ranked.select("no_source", "source", "ord", "source_size", target.alias("target"))


def queues(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "mix", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(doc_id, size, ord, source_size, target, ahead): ``ahead`` is the words before the document in its source's queue. Written to the shared folder."""
    rows = stored(sizes(docs, seed), "mix-sizes")
    bits = max(LEAST_SLICES, rows.count() // slice_rows).bit_length() - 1
    key = ["no_source", "source", "slice"]
    rows = rows.withColumn("slice", F.shiftright("h", 60 - bits))
    slices = rows.groupBy(*key).agg(F.sum("size").alias("slice_size"))
    aims = targets(slices.groupBy("no_source", "source").agg(F.sum("slice_size").alias("source_size")), weights, share, repeats)
    earlier = Window.partitionBy("no_source", "source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("slice_ahead", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0))).join(aims, ["no_source", "source"])
    within = Window.partitionBy(*key).orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(slices.drop("slice_size"), key)
    return stored(placed.select("doc_id", "size", "ord", "source_size", "target", (F.col("slice_ahead") + F.col("inside")).alias("ahead")), "mix-queues")


def _pieces(piece: int, repeats: int) -> Column:
    """The pieces of a queue row, all repeats: structs (copy, at, words, finish); ``at`` is the words of the source up to the piece's end."""
    count = F.ceil(F.col("size") / piece).cast("int")

    def one(i: Column) -> Column:
        copy = F.floor(i / count)
        begin = (i % count) * piece
        words = F.least(F.lit(piece), F.col("size") - begin).cast("long")
        at = F.col("ahead") + copy * F.col("source_size") + begin + words
        return F.struct(copy.cast("int").alias("copy"), at.alias("at"), words.alias("words"), (at / F.col("target")).alias("finish"))

    return F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0), count * repeats - 1), one)).otherwise(F.array().cast("array<struct<copy:int,at:bigint,words:bigint,finish:double>>"))


def cut(queue: DataFrame, budget: float, piece: int = PIECE, repeats: int = REPEATS, ranges: int = RANGES, most: int = SORTED) -> tuple[float, int, int] | None:
    """(finish, ord, at) of the last piece within the budget, in the order of these three; None if there is none.

    What comes to the driver is a row for each range of one division, or the one last piece.
    """
    pieces = queue.select("ord", F.explode(_pieces(piece, repeats)).alias("x")).select("ord", "x.at", "x.words", "x.finish")
    low, high, ahead = 0.0, 4.0, 0
    inside = pieces
    while True:
        width = (high - low) / ranges
        place = F.least(F.floor((F.col("finish") - low) / width), F.lit(ranges)).cast("int")
        found = inside.groupBy(place.alias("range")).agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n")).orderBy("range").collect()
        for r in found:
            if ahead + r["words"] > budget:
                break
            ahead += r["words"]
        else:  # the budget takes all of these pieces
            inside = inside.where(place == (found[-1]["range"] if found else 0))
            ahead -= found[-1]["words"] if found else 0
            break
        inside = inside.where(place == r["range"])
        narrower = (low + width * r["range"], low + width * (r["range"] + 1))
        # The last range has no end, and a range that can't be divided holds equal times.
        if r["n"] <= most or r["range"] == ranges or not low < narrower[1] or narrower[1] - narrower[0] <= 1e-12:
            break
        low, high = narrower
    order = Window.orderBy("finish", "ord", "at")
    last = inside.withColumn("total", F.sum("words").over(order) + ahead).where(F.col("total") <= budget).agg(F.max(F.struct("finish", "ord", "at")).alias("x")).first()["x"]
    if last is not None:
        return tuple(last)
    if not ahead:
        return None
    # The range's first piece is too long: the cut is at the end of what comes before.
    return tuple(pieces.where(F.col("finish") < low + width * r["range"]).agg(F.max(F.struct("finish", "ord", "at")).alias("x")).first()["x"])


def _before(x: Column, end: tuple[float, int, int]) -> Column:
    finish, ord_, at = end
    same = x["finish"] == F.lit(finish)
    return (x["finish"] < F.lit(finish)) | (same & (F.col("ord") < ord_)) | (same & (F.col("ord") == ord_) & (x["at"] <= at))


def _end(queue: DataFrame, share: float, piece: int, repeats: int) -> tuple[float, int, int] | None:
    total = queue.agg(F.sum("size")).first()[0] or 0
    return cut(queue, share * total, piece, repeats)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, piece: int = PIECE, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words of each document that the mix takes, with repeats."""
    queue = queues(docs, weights, share, repeats, seed)
    end = _end(queue, share, piece, repeats)
    none = F.lit(0).cast("long")
    taken = none if end is None else F.aggregate(F.filter(_pieces(piece, repeats), lambda x: _before(x, end)), none, lambda acc, x: acc + x["words"])
    return queue.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def schedule(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, piece: int = PIECE, seed: str = "mix") -> DataFrame:
    """The mix in its order, range-sorted by finish time: (doc_id, copy, words, finish), the words of a document that one pass over its source takes."""
    queue = queues(docs, weights, share, repeats, seed)
    end = _end(queue, share, piece, repeats)
    pieces = queue.select("doc_id", "ord", "ahead", F.explode(_pieces(piece, repeats)).alias("x"))
    pieces = pieces.where(F.lit(False) if end is None else _before(F.col("x"), end))
    copies = pieces.groupBy("ord", "ahead", "x.copy", "doc_id").agg(F.sum("x.words").alias("words"), F.max("x.finish").alias("finish"))
    return copies.repartitionByRange("finish", "ord", "ahead").sortWithinPartitions("finish", "ord", "ahead").select("doc_id", "copy", "words", "finish")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS ord
  FROM d GROUP BY source),
w AS (SELECT *, [3.0::double, 1.0::double, 2.0::double][((ord - 1) % 3 + 1)::int] AS w, 2 * source_size AS most FROM s),
b AS (
  SELECT *, sum(source_size) OVER () * 1.5::double AS budget, sum(w) OVER () AS all_w,
         coalesce(sum(most) OVER o, 0) AS most_before, coalesce(sum(w) OVER o, 0.0::double) AS w_before
  FROM w WINDOW o AS (ORDER BY most / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT *, (budget - most_before) * w >= most * (all_w - w_before) AS held FROM b),
t AS (
  SELECT source, source_size, ord, budget, CASE WHEN held THEN most::double ELSE
    (budget - sum(CASE WHEN held THEN most ELSE 0 END) OVER ()) / sum(CASE WHEN held THEN 0.0::double ELSE w END) OVER () * w END AS target
  FROM held),
q AS (
  SELECT d.doc_id, d.size, d.h, t.ord, t.source_size, t.target, t.budget, row_number() OVER () AS row_id,
         coalesce(sum(d.size) OVER (PARTITION BY t.ord ORDER BY h, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, unnest(range(2 * ((size + 63) // 64))) AS i, (size + 63) // 64 AS k FROM q),
e AS (
  SELECT row_id, ord, budget, target, least(64, size - (i % k) * 64) AS words,
         ahead + (i // k) * source_size + (i % k) * 64 + least(64, size - (i % k) * 64) AS upto
  FROM p),
r AS (SELECT row_id, words, sum(words) OVER (ORDER BY upto / target, ord, upto) <= budget AS taken FROM e),
x AS (SELECT row_id, sum(words) FILTER (taken)::bigint AS taken FROM r GROUP BY row_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(x.taken, 0)::bigint AS taken
FROM q LEFT JOIN x USING (row_id)
"""
