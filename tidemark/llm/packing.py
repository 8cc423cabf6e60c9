"""Packing token pieces into sequences: first-fit decreasing over a tournament tree.

Pieces of documents are dealt to randomised groups by a hash of the piece and of its place in
the input, so that neither a long document nor rows without an id or with equal ids pile up in
one group. The number of groups follows from the number of rows and bytes (a document has one
piece more than full ones, and those are at most its bytes over the sequence length), so a
group is bounded. Every group is packed on its own. Only (doc_id, start, length, checksum)
rows are shuffled, never texts or ids: checksums are taken where the text is tokenized.

A document longer than a sequence is cut at multiples of the sequence length; whole pieces
fill a sequence each. The rest goes first-fit decreasing: the tree's leaves are the free
places of the bins, an inner node is the larger of its children, and the first bin that
holds a piece is found by one descent.

Defined edge cases: a null or empty text is the single end id; a null doc_id stays null;
documents with equal ids are packed each on its own, repeated rows too; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe import byte_alphabet
from tidemark.llm.common import RARE_SPACES, SPACES, slices, texts_of, tidied, tokenizer_file

SEQUENCE = 2048
END_ID = 1
#: Mean number of documents in a group, and at most so many full sequences on the mean.
GROUP_DOCS = 4096
#: Fixed: the regular expression that byte-level tokenizers split chunks by; what it has for runs of white space is left out.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\n"""
#: Chunks that a worker remembers the ids of, in two generations.
CHUNKS_HELD = 240_000
#: Code points of text that are encoded at once.
SLICE = 1 << 20


class TournamentTree:
    """Free places of bins, for first fit. Bins are opened as they are needed."""

    def __init__(self, capacity: int, leaves: int = 64):
        self.capacity, self.leaves, self.used = capacity, leaves, 0
        self.tree = [capacity] * (2 * leaves)

    def _grow(self) -> None:
        free = self.tree[self.leaves :] + [self.capacity] * self.leaves
        self.leaves *= 2
        self.tree = [0] * self.leaves + free
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset there) of the first bin with room for size."""
        tree = self.tree
        if tree[1] < size:
            self._grow()
            tree = self.tree
        i = 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        offset = self.capacity - tree[i]
        tree[i] -= size
        found = i - self.leaves
        self.used = max(self.used, found + 1)
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return found, offset


def first_fit_decreasing(sizes: list[int], capacity: int = SEQUENCE) -> list[tuple[int, int]]:
    """(bin, offset) of each size; ties keep the given order."""
    tree, out = TournamentTree(capacity), [(0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        out[k] = tree.place(sizes[k])
    return out


class ChunkEncoder:
    """Byte-level BPE ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer's own regular expression never joins across the chunks ``" ?\\S+"`` and runs
    of white space, so a text's ids are its chunks' ids in a row.

    Where single blanks and line ends part the words, texts are split at the blanks, after one
    is put before each line end: then a chunk stands for itself behind a blank, or without one
    if it begins with a line end. Other white space is cut out before; the last character of
    such a run, if it is a blank, belongs to the word behind it. The distinct chunks of many
    texts are looked up, new ones are encoded in one call with a line end between them (which
    is a token of its own there), and texts are gathered from them as arrays.

    Chunks are remembered in two generations: when the younger one is full it becomes the
    older one, and chunks that are met again move on without being encoded again.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        # Runs of white space but " ", "\n", "\n\n" and "\n " before a word.
        self.irregular = re.compile(rf"(?!\n?[ \n][^{SPACES}])[{SPACES}]+").finditer
        self.rare = re.compile(f"[{RARE_SPACES}]").search
        self.ranked = self._by_ranks(path)
        self.newline = np.array(self._ids("\n"), "<u4")
        self.most, self.known, self.older = CHUNKS_HELD, {}, {}

    @staticmethod
    def _by_ranks(path: str) -> tiktoken.Encoding | None:
        """The same merges by rank, several times faster, where ids rise with the merges; None where they don't."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        order = [vocab.get(a + b, -1) for a, b in merges]
        if model.get("end_of_word_suffix") or any(y <= x for x, y in zip(order, order[1:], strict=False)) or len(order) + 256 != len(vocab):
            return None
        back = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes([back[c] for c in token]): i for token, i in vocab.items()}
        return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _array(self, text: str) -> np.ndarray:
        if self.ranked is None:
            return np.array(self._ids(text), "<u4")
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        out = {x: self._bytes(x or " ") for x in new if x in ("", "\n")}
        joined = [x for x in new if x not in out]
        if joined:
            ids = self._array("\n".join([x[1:] if x[0] == "\n" else " " + x for x in joined]))
            ends = np.append((ids == self.newline[0]).nonzero()[0], len(ids)) * 4
            starts = np.append(0, ends[:-1] + 4)
            data, head = ids.tobytes(), self.newline.tobytes()
            for x, a, b in zip(joined, starts.tolist(), ends.tolist(), strict=True):
                out[x] = head + data[a:b] if x[0] == "\n" else data[a:b]
        return out

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        new = [x for x in chunks if x not in self.known]
        if 2 * (len(self.known) + len(new)) > self.most:
            self.older, self.known, new = self.known, {}, chunks
        known, older = self.known, self.older
        known.update((x, older[x]) for x in new if x in older)
        known.update(self._learn([x for x in new if x not in older]))
        out = [*map(known.__getitem__, chunks)]
        if 2 * len(known) > self.most:
            self.known = {}
        return out

    def _regular(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        # A line end is put before each text, so that its first chunk does not stand for one behind a blank.
        parts = pc.split_pattern(pa.array(["\n" + x.replace("\n", " \n") for x in texts], pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        known = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        data = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        of = coded.indices.to_numpy()
        counts = sizes[of]
        ends = np.cumsum(counts)
        places = np.repeat((np.cumsum(sizes) - sizes)[of] - (ends - counts), counts)
        places += np.arange(len(places))
        ids = data[places].tobytes()
        cuts = (4 * np.append(0, ends)[parts.offsets.to_numpy()]).tolist()
        return [ids[a + self.newline.nbytes : b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _is_regular(self, text: str) -> bool:
        found = "  " in text or " \n" in text or "\n\n\n" in text or "\n\n " in text or text.endswith(("\n\n", "\n "))
        return not found and not self.rare(text)

    def _cut(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text, and whether the library is to encode them as they are."""
        if self.special.search(text):
            yield text, True
            return
        at = 0
        for m in () if self._is_regular(text) else self.irregular(text):
            yield text[at : m.start()], False
            run, at = m[0], m.end()
            if at == len(text):
                yield run, True
            else:
                yield run[:-1], True
                if run[-1] == " ":
                    at -= 1
                else:
                    yield run[-1], True
        yield text[at:], False

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [[*self._cut(x)] for x in texts]
        regular = iter(self._regular([x for parts in cut for x, alone in parts if not alone]))
        runs = {x: self._bytes(x) for x in {x for parts in cut for x, alone in parts if alone}}
        return [b"".join([runs[x] if alone else next(regular) for x, alone in parts]) for parts in cut]


_LOADED: dict[str, ChunkEncoder] = {}


def _pieces(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = ChunkEncoder(tokenizer_file(path))
        encoder = _LOADED[path]
        end = end_id.to_bytes(4, "little")
        number = 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = texts_of(batch, "text")
            rows: tuple[list, ...] = [], [], [], [], [], []
            for a, b in slices((len(x) for x in texts), SLICE):
                for doc, data in zip(ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    data += end
                    for at in range(0, len(data), 4 * length):
                        piece = data[at : at + 4 * length]
                        for column, v in zip(rows, (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4, number), strict=True):
                            column.append(v)
                        number += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"])

    return run


def pieces(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, place): every document's ids, cut at multiples of length.

    place is the number of the piece in its partition of the input.
    """
    return docs.select("doc_id", "text").mapInArrow(tidied(_pieces(path, length, end_id)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long")


def _pack(length: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        sizes = group.column("length").to_pylist()
        number = group.column("group")[0].as_py()
        placed = first_fit_decreasing(sizes, length)
        return pa.table(
            {c: group.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            | {"sequence_id": pa.array([(number << 32) + k for k, _ in placed], pa.int64()), "offset": pa.array([x for _, x in placed], pa.int64())}
        )

    return run


def pack(rows: DataFrame, groups: int, length: int = SEQUENCE, seed: int = 20) -> DataFrame:
    """pieces() with sequence_id (unique over all groups) and offset."""
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "place"), F.lit(groups))).drop("place")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInArrow(tidied(_pack(length)), schema)


def pack_documents(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """The contract's columns. A token has a byte at least, so the bytes bound the number of full pieces."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-n // group_docs) + (size or 0) // (length * group_docs))
    return pack(pieces(docs, path, length, end_id), groups, length)
