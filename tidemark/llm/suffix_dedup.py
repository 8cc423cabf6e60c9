"""Removal of repeated 50-byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id.
The suffixes that can matter are sorted in buckets, and no task ever holds more than one:

1. *Anchors.* Every 50-byte window has an anchor: its substring of 16 bytes or more that has
   the least hash (the leftmost). Equal windows have equal anchors, so a window whose anchor's
   hash is in one document only repeats nowhere. Documents are dealt to blocks; a block sends
   the hashes of its anchors, and gets one bit for each: is it in another document? The larger
   the table, the longer the anchors: short ones would soon all repeat by chance.
2. *Segments.* Runs of windows with the same repeated anchor are cut out (a run of w windows
   is w + 49 bytes), made distinct within the block with their smallest doc_id, and sent to
   the suffix bucket of their anchor. Equal windows meet in one bucket.
3. *Buckets.* A bucket's distinct segments are one text. Suffixes at positions of a
   difference cover modulo 21 are ranked beforehand (by doubling, in steps that stay within
   the sample). Then the suffixes are sorted a range of first bytes at a time: by their first
   24 bytes, and longer ties by the ranks of the cover positions that two suffixes reach at
   the same distance.
   Neighbours that agree in 50 bytes are one class; its smallest doc_id goes back.
4. Blocks mark and remove the bytes of windows whose class has a smaller doc_id.

Hot anchors. The answers of step 1 also say which anchors occur in many runs. Their runs are
cut further, by the place of the anchor in the window: the windows of a part have more bytes in
common than the anchor, and the part goes to the bucket of these bytes. The more runs an anchor
has, the finer the parts; the finest are single windows, and a block sends each of those once.
So no bucket grows with the number of contexts that a frequent string has.

Step 1 never drops a repeated window (a hash collision only lets more through), and step 3
compares the bytes themselves, so the result is exact. A string in a third of all documents
is one segment a block and not one a document.

Defined edge cases: a null text is empty; a null doc_id counts as larger than all others;
rows with equal ids are one document, so they do not remove each other's bytes, and repeated
rows give repeated results; texts shorter than 50 bytes stay as they are; a text is in one
block whatever its length; an empty table gives no rows; remove_repeats() reads doc_id and
text only, rewritten() keeps columns of any name.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, hash_ranges, mix, slices, tidied, with_text

WINDOW, ANCHOR = 50, 16
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
#: Suffixes that are sorted at a time.
RANGE_SUFFIXES = 1 << 19
#: Bytes whose anchors are computed at a time.
_SLICE = 1 << 17
_LAST = np.iinfo(np.int64).max
#: Of anchors by how hot they are: in how many places of the window an anchor may stand within one part of a run.
PLACES = (WINDOW - ANCHOR + 1, 18, 9, 1)
#: From one level of hotness to the next, an anchor has so many times the runs.
HOTTER = 16
#: Bytes of text up to which anchors are of ANCHOR bytes; beyond, LONGER bytes are added for each GROWTH times as many, up to LONGEST.
SHORT_TOTAL, GROWTH, LONGER, LONGEST = 256 << 20, 16, 4, 32
#: Fixed: a perfect difference set, so every distance modulo 21 is that of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Bytes by which suffixes are sorted before the cover ranks are asked: at least PERIOD.
HEAD = 24


def words_at(text: np.ndarray, dtype: str = "<u8") -> np.ndarray:
    """The eight bytes from each position as a number; text must have eight bytes to spare."""
    return np.ndarray((len(text) - 8,), dtype, text.tobytes() if not text.flags.c_contiguous else text.data, 0, (1,))


def anchor_bytes(total: int) -> int:
    """The length of the anchors of a table with so many bytes of text."""
    size = ANCHOR
    while total > SHORT_TOTAL and size < LONGEST:
        size += LONGER
        total = -(-total // GROWTH)
    return size


def anchors(text: np.ndarray, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Anchor position of each window start of a text (bytes), and the hash of each position's anchor of ``size`` bytes."""
    count = len(text) - size + 1
    wide = words_at(np.concatenate([text, np.zeros(8, np.uint8)]))
    with np.errstate(over="ignore"):
        key = wide[:count] * np.uint64(0x9E3779B97F4A7C15)
        # The last word may overlap the one before.
        for at in [*range(8, size - 8, 8), size - 8]:
            if at > 8:
                key ^= key >> np.uint64(32)
                key *= np.uint64(0x9E3779B97F4A7C15)
            key ^= (wide[at : at + count] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    least = key ^ key >> np.uint64(29)
    least *= np.uint64(0xBF58476D1CE4E5B9)
    least &= np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(least), dtype=np.uint64)
    span = 1
    total = WINDOW - size + 1
    while 2 * span <= total:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < total:
        rest = total - span
        least = np.minimum(least[:-rest], least[rest:])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), key


class Block:
    """The texts of a block, in a fixed order, and their runs of windows by anchor."""

    def __init__(self, table: pa.Table, anchor: int = ANCHOR):
        self.anchor = anchor
        ids = table.column("doc_id").to_pylist()
        data = [x.encode("utf-8", "surrogatepass") if x else b"" for x in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (_LAST if ids[k] is None else ids[k], data[k]))
        self.table = table.take(order)
        self.ids = [ids[k] for k in order]
        self.data = [data[k] for k in order]
        self.rank = np.array([_LAST if x is None else x for x in self.ids], np.int64)
        self._runs: list[tuple] | None = None

    def runs(self) -> list[tuple]:
        """For each slice of documents: their numbers' range, offsets, text, and runs (document, first window, last window, anchor hash, anchor position)."""
        if self._runs is None:
            self._runs = list(self._find_runs())
        return self._runs

    def _find_runs(self):
        for a, b in slices((len(x) for x in self.data), _SLICE):
            sizes = np.array([len(x) for x in self.data[a:b]], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            text = np.frombuffer(b"".join(self.data[a:b]), np.uint8)
            if len(text) < WINDOW or sizes.max() < WINDOW:
                yield a, b, starts, text, None
                continue
            at, key = anchors(text, self.anchor)
            change = np.empty(len(at), bool)
            change[0] = True
            np.not_equal(at[1:], at[:-1], out=change[1:])
            # A document's windows begin with it and end WINDOW - 1 bytes before its end.
            edges = np.concatenate([starts[:-1], np.maximum(starts[1:] - WINDOW + 1, starts[:-1])])
            change[edges[edges < len(at)]] = True
            first = change.nonzero()[0]
            last = np.append(first[1:], len(at)) - 1
            doc = np.searchsorted(starts, first, side="right") - 1
            keep = first + WINDOW <= starts[doc + 1]
            doc, first, last = doc[keep], first[keep], last[keep]
            yield a, b, starts, text, (a + doc, first, last, mix(key[at[first]]), at[first])

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes of the block, sorted; whether two documents of the block hold each; the number of its runs."""
        found = [(runs[3], self.rank[runs[0]]) for *_, runs in self.runs() if runs]
        if not found:
            return np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.int64)
        h, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        first = np.append(True, h[1:] != h[:-1]).nonzero()[0]
        return h[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), np.diff(np.append(first, len(h)))

    def segments(self, repeated: np.ndarray, levels: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, list[tuple]]:
        """Distinct segments of the anchors in ``repeated`` (sorted hashes, with their levels of hotness): content,
        smallest document and bucket key of each, and by slice the documents, starts and numbers of the occurrences."""
        number: dict[bytes, int] = {}
        least: list[np.ndarray] = [np.empty(0, np.int64)]
        key: list[np.ndarray] = [np.empty(0, np.uint64)]
        places = []
        for a, b, starts, text, runs in self.runs():
            if not runs or not len(repeated):
                continue
            doc, first, last, h, at = runs
            spot = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
            hit = (repeated[spot] == h).nonzero()[0]
            doc, first, last, own = doc[hit], first[hit], last[hit], h[hit]
            level = levels[spot[hit]]
            joined = text.tobytes()
            if level.any():
                hot = level.nonzero()[0]
                parts = [(k, *part) for k, s, e, p, x in zip(hot.tolist(), first[hot].tolist(), last[hot].tolist(), at[hit[hot]].tolist(), level[hot].tolist(), strict=True) for part in parts_of(joined, s, e, p, PLACES[x], self.anchor)]
                of, *cut = zip(*parts, strict=True)
                cold = (level == 0).nonzero()[0]
                of = np.concatenate([cold, np.array(of, np.int64)])
                order = np.argsort(of, kind="stable")
                doc = doc[of[order]]
                first, last, own = (np.concatenate([x[cold], np.array(y, x.dtype)])[order] for x, y in zip((first, last, own), cut, strict=True))
            known = len(number)
            numbers = np.array([number.setdefault(joined[s:e], len(number)) for s, e in zip(first.tolist(), (last + WINDOW).tolist(), strict=True)], np.int64)
            # Documents come in order: the first that holds a segment is the smallest.
            new = numbers > np.maximum.accumulate(np.append(known - 1, numbers))[:-1]
            least.append(self.rank[doc[new]])
            key.append(own[new])
            places.append((a, b, starts, text, doc, first, numbers))
        return list(number), np.concatenate(least), np.concatenate(key), places


def parts_of(text: bytes, first: int, last: int, anchor: int, places: int, size: int = ANCHOR):
    """(first window, last window, key) of the parts of a run: windows in which the anchor stands in neighbouring places.

    The key is a hash of the bytes that all possible windows of the part have in common.
    """
    while first <= last:
        part = (anchor - first) // places
        least, most = part * places, min(part * places + places, WINDOW - size + 1) - 1
        end = min(last, anchor - least)
        yield first, end, xxhash.xxh3_64_intdigest(text[anchor - least : anchor - most + WINDOW], seed=part)
        first = end + 1


def _ask(block_column: str, n_buckets: int, anchor: int = ANCHOR):
    def run(table: pa.Table) -> pa.Table:
        block = table.column(block_column)[0].as_py()
        h, several, runs = Block(table, anchor).hashes()
        values = (h.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | several.astype(np.uint32)
        # The number of runs, as a power of two.
        powers = np.ceil(np.log2(runs)).astype(np.uint8)
        parts = hash_ranges(h, n_buckets)
        blobs = {k: pa.array([x[a:b].tobytes() for _, a, b in parts], pa.binary()) for k, x in (("hashes", values), ("powers", powers))}
        return pa.table({"bucket": pa.array([p for p, _, _ in parts], pa.int64()), "block": pa.array([block] * len(parts), pa.int64())} | blobs)

    return run


def _answer(hot_runs: int):
    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("hashes").to_pylist()
        values = np.frombuffer(b"".join(blobs), np.uint32)
        h = values >> np.uint32(1)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        repeated = (values & np.uint32(1)).astype(bool)
        # A hash that two documents of one block hold is repeated in every block that holds it.
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        runs = np.ldexp(1.0, np.frombuffer(b"".join(table.column("powers").to_pylist()), np.uint8).astype(np.int64))
        first = np.append(True, ~same).nonzero()[0] if len(h) else np.empty(0, np.int64)
        total = np.add.reduceat(runs[order], first) if len(h) else runs
        # Equal for equal hashes, whatever block asks.
        level = np.empty(len(h), np.uint8)
        level[order] = np.repeat(np.searchsorted([hot_runs * HOTTER**k for k in range(len(PLACES) - 1)], total, side="left"), np.diff(np.append(first, len(h))))
        cuts = np.cumsum([0] + [len(x) // 4 for x in blobs])
        out: dict[str, list] = {"bits": [], "hot": [], "levels": []}
        for a, b in zip(cuts, cuts[1:], strict=False):
            hot = level[a:b].nonzero()[0]
            for k, v in zip(out, (np.packbits(repeated[a:b]), hot.astype(np.uint32), level[a:b][hot]), strict=True):
                out[k].append(v.tobytes())
        return pa.table({"block": table.column("block").cast(pa.int64()), "bucket": table.column("bucket").cast(pa.int64())} | {k: pa.array(v, pa.binary()) for k, v in out.items()})

    return run


def _repeated(block: Block, answers: pa.Table, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's repeated anchor hashes, sorted, and their levels of hotness."""
    h, _, _ = block.hashes()
    columns = ("bits", "hot", "levels")
    found = dict(zip(answers.column("bucket").to_pylist(), zip(*(answers.column(c).to_pylist() for c in columns), strict=True), strict=True))
    keep, level = np.zeros(len(h), bool), np.zeros(len(h), np.uint8)
    for p, a, b in hash_ranges(h, n_buckets):
        if p in found:
            bits, hot, levels = found[p]
            keep[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
            level[a + np.frombuffer(hot, np.uint32).astype(np.int64)] = np.frombuffer(levels, np.uint8)
    return h[keep], level[keep]


def _send(block_column: str, n_asked: int, n_buckets: int, anchor: int = ANCHOR):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in ("suffix_bucket", "block", "sizes", "docs", "bytes", "numbers")}
        if len(table) and len(answers):
            block = Block(table, anchor)
            content, least, key, _ = block.segments(*_repeated(block, answers, n_asked))
            if content:
                h = mix(key)
                order = np.argsort(h)
                sizes = np.array([len(x) for x in content], np.uint32)
                for bucket, a, b in hash_ranges(h[order], n_buckets):
                    own = order[a:b]
                    for k, v in zip(rows, (bucket, table.column(block_column)[0].as_py(), sizes[own].tobytes(), least[own].tobytes(), b"".join([content[k] for k in own.tolist()]), own.astype(np.uint32).tobytes()), strict=True):
                        rows[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)})

    return run


_FIRST = [next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)]


@cache
def cover_distance(r: int, s: int) -> int:
    """The least distance at which suffixes of residues r and s both reach a cover position."""
    return next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER)


def sample_ranks(text: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at cover positions, all different; other positions hold 0.

    Doubling: the names of 21 bytes at p and p + 21 give the names of 42, then 84 and so on
    until all differ. A step is a multiple of the period, so only cover positions are ever
    named. A suffix that ends is less than its continuations.
    """
    n = len(text)
    wide = words_at(np.concatenate([text, np.zeros(PERIOD + 8, np.uint8)]), ">u8")
    where = np.concatenate([np.arange(c, n, PERIOD) for c in COVER])
    names = np.zeros(n, np.uint32)
    # A group's name is the rank of its first member, so that a group may be split without the others.
    values = wide[where].astype(np.uint64)
    order = np.argsort(values)
    values, tied = values[order], where[order]
    new = np.append(True, values[1:] != values[:-1])[: len(values)].nonzero()[0]
    names[tied] = np.repeat(new + 1, np.diff(np.append(new, len(values))))
    tied = tied[_tied(names[tied])]
    for at in range(8, PERIOD, 4):
        piece = wide[tied + at].astype(np.uint64) >> np.uint64(64 - 8 * min(4, PERIOD - at))
        tied = _split(names, tied, piece)
    span = PERIOD
    while len(tied) and span <= n:  # zeros at the very end stay tied
        later = tied + span
        tied = _split(names, tied, np.where(later < n, names[np.minimum(later, n - 1)], 0))
        span *= 2
    return names


def _split(names: np.ndarray, where: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Split the groups of the positions ``where`` by 32-bit numbers; returns the positions that are still tied."""
    key = names[where].astype(np.uint64) << np.uint64(32) | by.astype(np.uint64)
    order = np.argsort(key)
    where, key = where[order], key[order]
    old, place = key >> np.uint64(32), np.arange(len(key))
    change = key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(np.append(True, change)[: len(key)], place, 0))
    begin = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1])[: len(key)], place, 0))
    names[where] = old.astype(np.int64) + first - begin
    return where[_tied(first)]


def sorted_suffixes(text: np.ndarray, starts: np.ndarray, limit: int = RANGE_SUFFIXES):
    """Yield the suffix starts in order, a range of first eight bytes (about ``limit`` suffixes) at a time."""
    ranks = sample_ranks(text)
    wide = words_at(np.concatenate([text, np.zeros(HEAD + 8, np.uint8)]), ">u8")
    heads = wide[starts].astype(np.uint64)
    n_ranges = -(-len(starts) // limit)
    if n_ranges > 1:
        sample = np.sort(heads[:: max(1, len(heads) // 4096)])
        splitters = np.unique(sample[[len(sample) * k // n_ranges for k in range(1, n_ranges)]])
        of = np.searchsorted(splitters, heads, side="right")
        for k in range(len(splitters) + 1):
            own = (of == k).nonzero()[0]
            if len(own):
                yield _sorted_range(wide, ranks, starts[own], heads[own])
    elif len(starts):
        yield _sorted_range(wide, ranks, starts, heads)


def _tied(group: np.ndarray) -> np.ndarray:
    """Places whose group (numbers that do not fall) has another member."""
    same = group[1:] == group[:-1]
    return (np.append(same, False) | np.append(False, same)).nonzero()[0]


def _sorted_range(wide: np.ndarray, ranks: np.ndarray, starts: np.ndarray, heads: np.ndarray) -> np.ndarray:
    order = np.argsort(heads)
    starts, heads = starts[order], heads[order]
    group = np.cumsum(np.append(True, heads[1:] != heads[:-1]))
    # The next four bytes, of what is still tied; groups are split, not renumbered in order.
    for at in range(8, HEAD, 4):
        tied = _tied(group)
        if not len(tied):
            return starts
        g, s = group[tied], starts[tied]
        key = wide[s + at].astype(np.uint64) >> np.uint64(32)
        by = np.argsort(g.astype(np.uint64) << np.uint64(32) | key)
        g, s, key = g[by], s[by], key[by]
        starts[tied] = s
        split = np.zeros(len(group), bool)
        split[tied] = np.append(False, (g[1:] == g[:-1]) & (key[1:] != key[:-1]))
        group = group + np.cumsum(split)
    tied = _tied(group)
    if not len(tied):
        return starts
    group = group - 1
    new = np.append(True, group[1:] != group[:-1])
    begins_of = np.zeros(int(group[-1]) + 1, np.int64)
    begins_of[group[new]] = new.nonzero()[0]
    # Ties: the suffixes of one residue have one order; a suffix's place in its group is the
    # sum of its places in the lists of all residues.
    pos, g = starts[tied], group[tied].astype(np.uint64) << np.uint64(32)
    padded = np.concatenate([ranks, np.zeros(PERIOD, np.uint32)])
    residue = pos % PERIOD
    lists = []
    for r in range(PERIOD):
        own = (residue == r).nonzero()[0]
        lists.append(own[np.argsort(g[own] | padded[pos[own] + _FIRST[r]])])
    place = np.zeros(len(tied), np.int64)
    for r, own in enumerate(lists):
        if not len(own):
            continue
        for s, other in enumerate(lists):
            if not len(other):
                continue
            if r == s:
                place[own] += np.arange(len(own)) - np.searchsorted(g[own], g[own], side="left")
                continue
            d = cover_distance(r, s)
            keys = g[other] | padded[pos[other] + d]
            place[own] += np.searchsorted(keys, g[own] | padded[pos[own] + d], side="right" if s < r else "left") - np.searchsorted(g[other], g[own], side="left")
    out = starts.copy()
    out[begins_of[group[tied]] + place] = pos
    return out


def least_documents(text: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each suffix start (rising): the smallest document among the suffixes with the same first 50 bytes.

    docs holds the document of each start.
    """
    out = np.empty(len(starts), np.int64)
    # Seven overlapping words cover the 50 bytes.
    offsets = (0, 8, 16, 24, 32, 40, WINDOW - 8)
    wide = words_at(np.concatenate([text, np.zeros(8, np.uint8)]))
    place = np.empty(len(text), np.int32)
    place[starts] = np.arange(len(starts), dtype=np.int32)
    for order in sorted_suffixes(text, starts):
        # Neighbours that agree so far; most pairs leave at the first words.
        pairs = np.arange(len(order) - 1)
        for o in offsets:
            w = order[pairs] + o, order[pairs + 1] + o
            pairs = pairs[wide[w[0]] == wide[w[1]]]
        new = np.ones(len(order), bool)
        new[pairs + 1] = False
        first = new.nonzero()[0]
        where = place[order]
        least = np.minimum.reduceat(docs[where], first)
        out[where] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out


def _sort_bucket(table: pa.Table) -> pa.Table:
    columns = {c: table.column(c).to_pylist() for c in ("block", "sizes", "docs", "bytes", "numbers")}
    sizes = np.frombuffer(b"".join(columns["sizes"]), np.uint32).astype(np.int64)
    docs = np.frombuffer(b"".join(columns["docs"]), np.int64)
    # Equal segments of several blocks are one segment, with their smallest document.
    joined, cuts = b"".join(columns["bytes"]), np.cumsum(np.append(0, sizes)).tolist()
    distinct: dict[bytes, int] = {}
    which = np.array([distinct.setdefault(joined[a:b], len(distinct)) for a, b in zip(cuts, cuts[1:], strict=False)], np.int64)
    first = np.unique(which, return_index=True)[1]
    smallest = np.full(len(distinct), _LAST)
    np.minimum.at(smallest, which, docs)
    sizes, docs, joined = sizes[first], smallest, np.frombuffer(b"".join(distinct), np.uint8)
    # Each segment is followed by its number, so that no repeat is longer than a segment.
    number = np.arange(len(sizes))
    text = np.empty(len(joined) + 4 * len(sizes), np.uint8)
    text[np.arange(len(joined)) + 4 * np.repeat(number, sizes)] = joined
    ends = np.cumsum(sizes + 4)
    text[(ends[:, None] + np.arange(-4, 0)).ravel()] = number.astype("<u4").view(np.uint8)
    windows = sizes - WINDOW + 1
    firsts = np.cumsum(windows) - windows
    segment = np.repeat(number, windows)
    starts = np.arange(len(segment)) - firsts[segment] + (ends - sizes - 4)[segment]
    least = least_documents(text, starts, docs[segment])
    # Run lengths: most segments have one smallest document throughout.
    new = np.append(True, (least[1:] != least[:-1]) | (segment[1:] != segment[:-1]))
    run = new.nonzero()[0]
    lengths = np.diff(np.append(run, len(least))).astype(np.uint32)
    counts = np.bincount(segment[run], minlength=len(sizes))
    # Back to the segments as they came: the runs of each one's distinct segment.
    own = counts[which]
    ends = np.cumsum(own)
    take = np.arange(ends[-1]) - np.repeat(ends - own - (np.cumsum(counts) - counts)[which], own)
    lengths, values, counts = lengths[take], least[run][take], own.astype(np.uint32)
    out: dict[str, list] = {"block": [], "numbers": [], "counts": [], "lengths": [], "least": []}
    a = x = 0
    for block, numbers in zip(columns["block"], columns["numbers"], strict=True):
        b = a + len(numbers) // 4
        y = x + int(counts[a:b].sum())
        for k, v in zip(out, (block, numbers, counts[a:b].tobytes(), lengths[x:y].tobytes(), values[x:y].tobytes()), strict=True):
            out[k].append(v)
        a, x = b, y
    return pa.table({k: pa.array(v, pa.int64() if k == "block" else pa.binary()) for k, v in out.items()})


def _remove(block_column: str, n_asked: int, rewrite: bool, anchor: int = ANCHOR):
    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        block = Block(table, anchor)
        n = len(block.ids)
        is_answer = pc.is_valid(back.column("bits"))
        found = back.filter(pc.invert(is_answer))
        removed, spans, kept = [0] * n, [0] * n, list(block.data)
        if n and len(found):
            repeated, levels = _repeated(block, back.filter(is_answer), n_asked)
            numbers, counts, lengths, least = (np.frombuffer(b"".join(found.column(c).to_pylist()), t) for c, t in (("numbers", np.uint32), ("counts", np.uint32), ("lengths", np.uint32), ("least", np.int64)))
            content, _, _, places = block.segments(repeated, levels)
            if len(numbers) != len(content):
                raise ValueError(f"{len(content)} segments were sent and {len(numbers)} came back")
            # Of each segment: the place and number of its runs of windows with one smallest document.
            counts = counts.astype(np.int64)
            begin, n_runs = np.empty(len(content), np.int64), np.empty(len(content), np.int64)
            begin[numbers], n_runs[numbers] = np.cumsum(counts) - counts, counts
            lengths = lengths.astype(np.int64)
            before = np.cumsum(lengths) - lengths
            for a, b, starts, text, doc, first, number in places:
                many = n_runs[number]
                run = np.arange(many.sum()) + np.repeat(begin[number] - (np.cumsum(many) - many), many)
                start = before[run] + np.repeat(first - before[begin[number]], many)
                lower = least[run] < np.repeat(block.rank[doc], many)
                ups = start[lower]
                if not len(ups):
                    continue
                downs = ups + lengths[run[lower]] + WINDOW - 1
                change = np.bincount(ups, minlength=len(text) + 1) - np.bincount(downs, minlength=len(text) + 1)
                gone = np.cumsum(change[:-1]) > 0
                for d in range(a, b):
                    own = gone[starts[d - a] : starts[d - a + 1]]
                    count = int(np.count_nonzero(own))
                    if count:
                        removed[d] = count
                        spans[d] = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1]))
                        kept[d] = text[starts[d - a] : starts[d - a + 1]][~own].tobytes()
        if rewrite:
            # A cut may fall inside a character: what is left of it goes too.
            return with_text(block.table.drop_columns([block_column]), [x.decode("utf-8", "ignore") for x in kept])
        return pa.table(
            {
                "doc_id": pa.array(block.ids, pa.int64()),
                "n_bytes": pa.array([len(x) for x in block.data], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            }
        )

    return run


class _Blocks:
    """Documents dealt to blocks. The numbers of blocks and buckets follow from the table's bytes."""

    def __init__(self, docs: DataFrame, block_bytes: int, bucket_bytes: int, hot_runs: int | None, anchor: int | None):
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.anchor = anchor or anchor_bytes(total)
        self.n_blocks, self.n_buckets = (max(1, -(-total // x)) for x in (block_bytes, bucket_bytes))
        #: A bucket may hold some anchors of so many runs.
        self.hot_runs = hot_runs or max(1, bucket_bytes // 8 // (2 * WINDOW))
        self.column = free_name(docs.columns, "block")
        # The text counts too: rows without an id, or with equal ids, are not all in one block.
        self.text = docs.withColumn(self.column, F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.n_blocks)))

    def removed(self, rewrite: bool, schema) -> DataFrame:
        """The texts are shuffled once: the three steps over blocks share that exchange."""
        text, block, n = self.text, self.column, self.n_blocks
        asked = text.groupBy(block).applyInArrow(tidied(_ask(block, n, self.anchor)), "bucket long, block long, hashes binary, powers binary")
        answers = asked.groupBy("bucket").applyInArrow(tidied(_answer(self.hot_runs)), "block long, bucket long, bits binary, hot binary, levels binary")
        send = _send(block, n, self.n_buckets, self.anchor)
        segments = text.groupBy(block).cogroup(answers.groupBy("block")).applyInArrow(tidied(send), "suffix_bucket long, block long, sizes binary, docs binary, bytes binary, numbers binary")
        found = segments.groupBy("suffix_bucket").applyInArrow(tidied(_sort_bucket), "block long, numbers binary, counts binary, lengths binary, least binary")
        back = found.unionByName(answers, allowMissingColumns=True)
        return text.groupBy(block).cogroup(back.groupBy("block")).applyInArrow(tidied(_remove(block, n, rewrite, self.anchor)), schema)


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_runs: int | None = None, anchor: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs."""
    blocks = _Blocks(docs.select("doc_id", "text"), block_bytes, bucket_bytes, hot_runs, anchor)
    return blocks.removed(False, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def rewritten(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_runs: int | None = None, anchor: int | None = None) -> DataFrame:
    """docs with all their columns, their texts without the removed bytes."""
    return _Blocks(docs, block_bytes, bucket_bytes, hot_runs, anchor).removed(True, docs.schema)


def reference(rows: list[tuple]) -> list[tuple]:
    """Brute force for tests: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    data = [(d, (t or "").encode("utf-8", "surrogatepass")) for d, t in rows]
    key = lambda d: _LAST if d is None else d
    least: dict[bytes, int] = {}
    for d, x in data:
        for i in range(len(x) - WINDOW + 1):
            w = x[i : i + WINDOW]
            least[w] = min(least.get(w, _LAST), key(d))
    out = []
    for d, x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - WINDOW + 1):
            if least[x[i : i + WINDOW]] < key(d):
                gone[i : i + WINDOW] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
