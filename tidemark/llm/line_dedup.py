"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case.
Its 128-bit hash goes into *runs*: tables in the shared folder, bucketed and sorted by hash,
holding (h1, h2, keeper, n). Batches are taken in falling order of doc_id. Each batch is
reduced to one row a hash and merge-anti-joined with the runs: what is left is new, and its
largest doc_id is the keeper in the whole corpus, as every later batch has smaller ids. A hash
that a run holds already adds its count only. So each hash has a keeper in one run, and no
later step compares keepers. When a level holds ``fanout`` runs, they are merged into one run
of the next level. Runs and batches are bucketed alike, so these joins shuffle nothing.

Defined edge cases: null or empty text is one empty line; a null doc_id counts as a
document smaller than all others; a repeated row (equal doc_id) is a document of its own,
and if it holds the keeper's id both copies keep the line; an empty table gives no rows;
rows without an id or with equal ids get the drops of their own text only.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free_name, shared_dir, stored, texts_of, tidied, with_text

_STRIP = " \t\n\x0b\x0c\r"
_TWO = struct.Struct(">qq")


def line_key(line: str) -> bytes:
    """The line without ASCII white space at its ends, A-Z in lower case, as UTF-8.

    bytes.lower() changes A-Z only.
    """
    return line.strip(_STRIP).encode("utf-8", "surrogatepass").lower()


def key_hash(key: bytes) -> tuple[int, int]:
    """128 bits as two signed 64-bit integers."""
    return _TWO.unpack(xxhash.xxh3_128_digest(key))


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, h1, h2 = [], [], [], []
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), texts_of(batch, "text"), strict=True):
                for a, b in {key_hash(line_key(x)) for x in text.split("\n") if len(x) >= min_chars and len(x.strip(_STRIP)) >= min_chars}:
                    ids.append(doc)
                    keys.append(key)
                    h1.append(a)
                    h2.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], ["h1", "h2", "doc_id", "row_key"])

    return run


class LineRuns:
    """The levels of runs; add() takes the batches in falling order of doc_id."""

    def __init__(self, fanout: int = 4):
        self.fanout, self.levels, self.buckets = fanout, [[]], 0

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _sorted_run(self, rows: DataFrame, what: str = "run") -> DataFrame:
        """rows as a table bucketed and sorted by hash; its files are in the shared folder."""
        spark = rows.sparkSession
        name = f"tidemark_line_{what}_{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/tidemark/{name}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).option("compression", "zstd").saveAsTable(name)
        run = spark.table(name)
        run._tidemark_path, run._tidemark_table = path, name
        return run

    @staticmethod
    def drop(*runs: DataFrame) -> None:
        for run in runs:
            run.sparkSession.sql(f"DROP TABLE IF EXISTS {run._tidemark_table}")
        discard(*runs)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (h1, h2, doc_id) rows, one for each line hash of a document, as a run.

        There ``keeper`` is set for hashes that no earlier run holds and null for the others,
        which only raise the count.
        """
        # As many as the batch has partitions, so that it is written as it is dealt.
        self.buckets = self.buckets or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        batch = lines.groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        older = self.runs()
        if not older:
            run = self._sorted_run(batch)
        else:
            batch = self._sorted_run(batch, "batch")
            new, again = batch, []
            for held in older:
                held = held.where("keeper is not null").select("h1", "h2").hint("merge")
                new = new.join(held, ["h1", "h2"], "left_anti")
                again.append(batch.join(held, ["h1", "h2"], "left_semi").withColumn("keeper", F.lit(None).cast("long")))
            run = self._sorted_run(reduce(DataFrame.unionByName, again, new))
            self.drop(batch)
        self.levels[0].append(run)
        self._compact()

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                merged = self._sorted_run(self._merged(self.levels[k]))
                self.drop(*self.levels[k])
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One run of several, by merge joins. One of them has the keeper of a hash."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select("h1", "h2", F.col("keeper").alias("other"), F.col("n").alias("m"))
            both = a.join(b.hint("merge"), ["h1", "h2"], "full")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
            return both.select("h1", "h2", F.coalesce("other", "keeper").alias("keeper"), n.alias("n"))

        return reduce(two, runs)

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, keeper) of the hashes that at least min_docs documents hold; null if none of them has an id."""
        return self._merged(self.runs()).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")


def batches_by_id(lines: DataFrame, n_batches: int) -> list[DataFrame]:
    """Ranges of doc_id of about equal numbers of lines, largest first; null ids are in the last."""
    shares = [k / n_batches for k in range(1, n_batches)]
    found = lines.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares, 1000)).first() if shares else (None, None)
    cuts = sorted({*(found[1] or [])} - {found[0]})
    edges = [None, *cuts, None]
    out = []
    for a, b in reversed(list(zip(edges, edges[1:], strict=False))):
        if a is None:
            out.append(lines.where(f"doc_id < {b} or doc_id is null") if b is not None else lines)
        else:
            out.append(lines.where(f"doc_id >= {a}" + (f" and doc_id < {b}" if b is not None else "")))
    return out


def _row_key():
    """Identifies a text among those of equal ids."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, n_batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc_id, row_key, drop): for each document that loses lines, the hashes of the lines it loses."""
    keyed = docs.select("doc_id", _row_key().alias("row_key"), "text")
    lines = stored(keyed.mapInArrow(tidied(_hash_lines(min_chars)), "h1 long, h2 long, doc_id long, row_key long"), "line-hashes")
    runs = LineRuns(fanout)
    for part in batches_by_id(lines, n_batches):
        runs.add(part)
    repeated = stored(runs.repeated(min_docs), "repeated-lines")
    runs.drop(*runs.runs())
    # A line that a third of all documents hold makes one large join partition: AQE splits it.
    lost = lines.join(repeated, ["h1", "h2"]).where("doc_id < keeper or doc_id is null and keeper is not null")
    # At most the lines of one text.
    return lost.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))


def _kept(texts: list[str], drops: list) -> tuple[list[str], list[int], list[int]]:
    """Texts without their dropped lines, numbers of lines, numbers of dropped lines."""
    kept, n_lines, n_dropped = [], [], []
    for text, drop in zip(texts, drops, strict=True):
        lines = text.split("\n")
        n_lines.append(len(lines))
        if drop:
            gone = {(x["h1"], x["h2"]) for x in drop}
            lines = [x for x in lines if key_hash(line_key(x)) not in gone]
        n_dropped.append(n_lines[-1] - len(lines))
        kept.append("\n".join(lines) if drop else text)
    return kept, n_lines, n_dropped


def _with_drops(docs: DataFrame, drop: str, options: dict) -> DataFrame:
    """docs with a column of the hashes that each row loses."""
    doc, key = free_name(docs.columns, "dropped id"), free_name(docs.columns, "dropped key")
    drops = dropped_lines(docs, **options).select(F.col("doc_id").alias(doc), F.col("row_key").alias(key), F.col("drop").alias(drop))
    return docs.join(drops, F.col("doc_id").eqNullSafe(F.col(doc)) & (_row_key() == F.col(key)), "left").drop(doc, key)


def _counted(drop: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = _kept(texts_of(batch, "text"), batch.column(drop).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "kept", "n_lines", "n_dropped"])

    return run


def _rewrite(drop: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, _, _ = _kept(texts_of(batch, "text"), batch.column(drop).to_pylist())
            yield with_text(batch.drop_columns([drop]), kept)

    return run


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped) for each row of docs; options as for dropped_lines()."""
    return _with_drops(docs.select("doc_id", "text"), "drop", options).mapInArrow(tidied(_counted("drop")), "doc_id long, kept string, n_lines long, n_dropped long")


def rewritten(docs: DataFrame, **options) -> DataFrame:
    """docs with all their columns, their texts without the dropped lines."""
    drop = free_name(docs.columns, "drop")
    return _with_drops(docs, drop, options).mapInArrow(tidied(_rewrite(drop)), docs.schema)


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns of drop_repeated_lines()."""
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def reference(rows: list[tuple], min_chars: int = 20, min_docs: int = 3) -> list[tuple]:
    """Brute force for tests."""
    where: dict[bytes, list] = {}
    for doc, text in rows:
        for k in {line_key(x) for x in (text or "").split("\n")}:
            if len(k.decode()) >= min_chars:
                where.setdefault(k, []).append(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(d := where.get(line_key(x), ())) < min_docs or doc is not None and doc == max((y for y in d if y is not None), default=None) or all(y is None for y in d)]
        out.append((doc, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (SELECT k.r, k.doc_id, k.pos, k.line, g.key IS NOT NULL AND (k.doc_id < g.keeper OR k.doc_id IS NULL AND g.keeper IS NOT NULL) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
