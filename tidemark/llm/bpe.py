"""BPE encoding and decoding by forced-boundary splitting.

Two adjacent bytes that occur side by side inside no vocabulary token can never be joined by
a merge. Every such pair is a *forced boundary*: the pieces on both sides are encoded on
their own and concatenated, with the same ids as the whole. Pre-tokens (what the tokenizer's
own regular expression yields) are cut at forced boundaries, and the distinct fragments of
many new words are encoded in one call. A bounded table remembers the ids of whole words.

A word end is part of the vocabulary here ("</w>"), so the last fragment of a pre-token is
merged with the word-end suffix and the others without it.

Defined edge cases: a null or empty text has no ids and decodes to the empty text; the
strings of special tokens in a text become their ids, as in the library; repeated rows give
repeated results; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from tidemark.llm.common import SPACES, slices, texts_of, tokenizer_file

#: Entries that a table may hold; bounds the memory of a Python worker.
WORDS_HELD = 400_000
#: Words whose digests a Python process holds, in two generations.
DIGESTS_HELD = 1_200_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


@cache
def class_ranges(name: str) -> str:
    """The code points that the tokenizers library counts as \\p{L}, \\p{N} or \\s, as ranges of a regular expression.

    The library is asked, to take all others out: other modules follow other versions of Unicode.
    """
    every = np.arange(0x110000, dtype="<u4")
    every = every[(every < 0xD800) | (every >= 0xE000)].tobytes().decode("utf-32-le")
    left = normalizers.Replace(Regex(name.replace("\\", "[^\\", 1) + "]+"), "").normalize_str(every)
    points = np.frombuffer(left.encode("utf-32-le"), "<u4").astype(np.int64)
    # Surrogates are no code points of a text, so they part no range.
    place = np.where(points < 0xE000, points, points - 0x800)
    runs = np.split(points, (np.diff(place) > 1).nonzero()[0] + 1)
    return "".join(f"{re.escape(chr(x[0]))}-{re.escape(chr(x[-1]))}" for x in runs if len(x))


def compiled(pattern: str) -> re.Pattern:
    """A pattern of the library with its classes written out; brackets are not nested there."""
    out, inside = [], False
    for part in re.split(r"(\\p\{L\}|\\p\{N\}|\\s|[\[\]])", pattern):
        if part in (r"\p{L}", r"\p{N}", r"\s"):
            part = class_ranges(part) if inside else f"[{class_ranges(part)}]"
        elif part in ("[", "]"):
            inside = part == "["
        out.append(part)
    return re.compile("".join(out))


class ForcedBoundaryBPE:
    """Encoder and decoder of a tokenizers JSON file with a byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.alphabet = byte_alphabet()
        self.inner = models.BPE(vocab=vocab, merges=merges)
        self.final = models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=self.suffix) if self.suffix else self.inner
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.digits = {i: str(i) for i in self.token}
        self.joined = self._joined_pairs(vocab)
        self.translation = {b: c for b, c in enumerate(self.alphabet) if b not in (10, 32)}
        self.pretoken = compiled(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = compiled(r"[\p{L}]+").fullmatch
        self.normaliser = Tokenizer.from_file(path).normalizer
        self.is_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self._chunks = re.compile(f"[^{SPACES}]+").findall
        self._odd = re.compile("[\x1c-\x1f]").search
        # The tables that map a whole text of fragments, one blank apart, to ids in one call.
        self.encoders = [Tokenizer(m) for m in (self.inner, self.final)]
        for e in self.encoders:
            e.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._words: dict[str, tuple[int, ...]] = {}

    def _joined_pairs(self, vocab: dict[str, int]) -> np.ndarray:
        """[a, b] is True if byte b follows byte a inside some token."""
        back = {c: b for b, c in enumerate(self.alphabet)}
        joined = np.zeros((256, 256), bool)
        for token in vocab:
            if self.suffix and token.endswith(self.suffix) and token != self.suffix:
                token = token[: -len(self.suffix)]
            codes = [back[c] for c in token]
            joined[codes[:-1], codes[1:]] = True
        return joined

    def fragments(self, pretokens: list[str]) -> list[list[str]]:
        """Each pre-token in the byte alphabet, cut at its forced boundaries.

        All pre-tokens are looked at as one array of byte pairs; a blank parts them, and a
        line end is put at each boundary.
        """
        data = np.frombuffer(" ".join(pretokens).encode("utf-8", "surrogatepass"), np.uint8)
        a, b = data[:-1], data[1:]
        cuts = (~self.joined[a, b] & (a != 32) & (b != 32)).nonzero()[0] + 1
        text = np.insert(data, cuts, 10).tobytes().decode("latin-1").translate(self.translation)
        return [x.split("\n") if "\n" in x else [x] for x in text.split(" ")]

    def _ids(self, parts: list[str], last: bool) -> list[tuple[int, ...]]:
        """Ids of many fragments, encoded in one call: tokens carry their fragment's number."""
        if not parts:
            return []
        made = self.encoders[last].encode(" ".join(parts), add_special_tokens=False)
        ids, words = made.ids, np.array(made.word_ids)
        cuts = np.searchsorted(words, np.arange(len(parts) + 1)).tolist()
        return [tuple(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Ids of runs of non-space characters (normalised)."""
        if not chunks:
            return []
        counts: list[int] = []
        pretokens: list[str] = []
        for chunk in chunks:
            if self.letters(chunk):
                pretokens.append(chunk)
                counts.append(1)
            else:
                found = self.pretoken.findall(chunk)
                pretokens += found
                counts.append(len(found))
        cut = self.fragments(pretokens)
        ends = self._ids([x[-1] for x in cut], True)
        heads = iter(self._ids([y for x in cut for y in x[:-1]], False))
        whole = [end if len(x) == 1 else tuple([i for _ in x[:-1] for i in next(heads)]) + end for x, end in zip(cut, ends, strict=True)]
        out, at = [], 0
        for n in counts:
            out.append(whole[at] if n == 1 else tuple([i for ids in whole[at : at + n] for i in ids]))
            at += n
        return out

    def words(self, chunks: list[str]) -> dict[str, tuple[int, ...]]:
        """The table of words, with all of these chunks in it."""
        new = [c for c in {*chunks} if c not in self._words]
        if len(self._words) + len(new) > WORDS_HELD:
            self._words.clear()
            new = [*{*chunks}]
        self._words.update(zip(new, self.learn(new), strict=True))
        return self._words

    def chunks(self, text: str) -> list[str]:
        """Runs of non-space characters. str.split() also splits at four control characters that are no spaces here."""
        return self._chunks(text) if self._odd(text) else text.split()

    def normalise(self, text: str) -> str:
        """The library's normaliser (NFC, lower case); ASCII needs lower case only, as spaces just separate."""
        return text.lower() if text.isascii() else self.normaliser.normalize_str(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.is_special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        chunks = self.chunks(self.normalise(text))
        table = self.words(chunks)
        return [i for chunk in chunks for i in table[chunk]]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode() without a decoder: the tokens joined by spaces."""
        return " ".join([self.token[i] for i in ids if i in self.token])


class _Digests:
    """Per word the texts that the digests need, so that a document is two joins.

    The words of two generations are held: when the younger one is full it becomes the older one, and words
    that are met again move on without being learned again.
    """

    def __init__(self, bpe: ForcedBoundaryBPE, most: int = DIGESTS_HELD):
        self.bpe, self.most, self.ids, self.decoded, self.older = bpe, most, {}, {}, ({}, {})

    def __call__(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids joined by spaces, decoded text."""
        bpe = self.bpe
        split = [None if bpe.is_special.search(x) else bpe.chunks(bpe.normalise(x)) for x in texts]
        needed = set().union(*(x for x in split if x))
        new = needed.difference(self.ids)
        if 2 * (len(self.ids) + len(new)) > self.most:
            self.older, self.ids, self.decoded = (self.ids, self.decoded), {}, {}
            new = needed
        old_ids, old_decoded = self.older
        for chunk in new.intersection(old_ids):
            self.ids[chunk], self.decoded[chunk] = old_ids[chunk], old_decoded[chunk]
        new = [*new.difference(old_ids)]
        token, digits = bpe.token, bpe.digits
        for chunk, ids in zip(new, bpe.learn(new), strict=True):
            self.ids[chunk] = " ".join([digits[i] for i in ids])
            self.decoded[chunk] = " ".join([token[i] for i in ids])
        known, decoded, out = self.ids, self.decoded, []
        for text, chunks in zip(texts, split, strict=True):
            if chunks is None:
                ids = bpe.encode(text)
                out.append((len(ids), " ".join(map(str, ids)), bpe.decode(ids)))
            else:
                line = " ".join(map(known.__getitem__, chunks))
                out.append((line.count(" ") + 1 if line else 0, line, " ".join(map(decoded.__getitem__, chunks))))
        return out


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def loaded(path: str) -> ForcedBoundaryBPE:
    """The encoder of a file, once in each Python process."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBPE(tokenizer_file(path))
    return _LOADED[path]


_DIGESTS: dict[str, _Digests] = {}


def digests_of(path: str) -> _Digests:
    """The words of a file's encoder, once in each Python process, so that tasks learn from those before."""
    if path not in _DIGESTS:
        _DIGESTS[path] = _Digests(loaded(path))
    return _DIGESTS[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = pa.array([bpe.encode(x) for x in texts_of(batch, "text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids)."""
    return docs.select("doc_id", "text").mapInArrow(_encode(path), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = pa.array([None if x is None else bpe.decode(x) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = digests_of(path)
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            n, ids, texts = [], [], []
            whole = texts_of(batch, "text")
            for a, b in slices((len(x) for x in whole), 1 << 20):
                for k, line, decoded in digests(whole[a:b]):
                    n.append(k)
                    ids.append(sha(line))
                    texts.append(sha(decoded))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns: encode, decode, digest, all in one pass over the texts."""
    return docs.select("doc_id", "text").mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
