"""The corpus operators against brute force, exact round trips and held-out accuracy, with edge cases."""

import gc
import hashlib
import inspect
import math
import os
import random
import re
import unicodedata
import weakref
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tidemark.llm import bpe, html_text, langid, line_dedup, near_dup, packing, quality, suffix_dedup, telephony, warc
from tidemark.llm.common import tidied

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string, bucket string, hits long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(40)]
    shared = words(rng, 30)
    texts += [texts[3], texts[3], texts[3], words(rng, 20) + "\n" + shared, shared + "\n" + words(rng, 25), "X " + shared]
    near = texts[7].split() if len(texts[7].split()) > 60 else words(rng, 100).split()
    texts += [" ".join(near), " ".join(near[:50] + ["changed"] + near[51:]), "a" * 500, "a" * 300, "é" * 80 + "ß", None, "", "   ", "\n\n", "x"]
    texts += ["a repeated line of this table\nother " + str(k) for k in range(4)] + ["  A REPEATED line of this table\t"]
    return [(k, t) for k, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3])]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "b", "c", 1) for d, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ordered(found):
    return sorted((tuple(r) for r in found), key=lambda x: tuple(map(str, x)))


def test_suffix_dedup_is_exact(docs, rows, empty):
    got = suffix_dedup.remove_repeats(docs, block_bytes=2000, bucket_bytes=500).collect()
    assert ordered(got) == ordered(suffix_dedup.reference(rows))
    assert suffix_dedup.remove_repeats(empty).count() == 0
    out = suffix_dedup.rewritten(docs, block_bytes=3000)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert out.where("n_chars != length(text)").count() == 0


@pytest.mark.parametrize("hot_runs", [1, 20, 100_000])
def test_suffix_dedup_of_a_frequent_string(spark, hot_runs):
    """A string of 16 to 60 bytes in many contexts: hot anchors are cut finer, with the same results."""
    rng = random.Random(8)
    frequent = ["sixteen bytes it", "one string of forty bytes that is common", "a longer string of sixty bytes that a third of the texts hold"]
    texts = [words(rng, 3) + frequent[k % 3] + words(rng, 4) + frequent[k % 2] + words(rng, 3) for k in range(300)]
    texts += [texts[k][: 20 + k] for k in range(0, 60, 3)] + [texts[4] + texts[5], None, ""]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[7]), (None, texts[7]), (2, texts[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, block_bytes=3000, bucket_bytes=2000, hot_runs=hot_runs).collect()
    assert ordered(got) == ordered(suffix_dedup.reference(rows))


def test_suffix_buckets_of_a_frequent_string_stay_small():
    """10**5 contexts of one 16-byte string: no bucket key has more than a few of them."""
    rng = np.random.default_rng(5)
    anchor = b"sixteen bytes it"
    keys = Counter()
    for _ in range(100_000):
        text = rng.bytes(34) + anchor + rng.bytes(34)
        for first, last, key in suffix_dedup.parts_of(text, 0, 34, 34, suffix_dedup.PLACES[1]):
            keys[key] += last - first + 1
    assert len(keys) == 200_000 and keys.most_common(1)[0][1] == 18
    whole = b"x" * 9 + anchor + b"y" * 40
    for places in suffix_dedup.PLACES:
        parts = list(suffix_dedup.parts_of(whole, 0, 9, 9, places))
        assert [s for a, b, _ in parts for s in range(a, b + 1)] == list(range(10))


def test_suffix_anchors_grow_with_the_table():
    """Text of few syllables: at the length for small tables a third of the anchors repeat by chance, at that for 10 GB hardly any."""
    rng = np.random.default_rng(6)
    text = np.array([b"ab", b"cd", b"ef", b"gh", b"ij"])[rng.integers(0, 5, 500_000)].tobytes().decode()
    table = pa.table({"doc_id": list(range(1000)), "text": [text[k : k + 1000] for k in range(0, 10**6, 1000)]})
    shares = []
    for total in (10 << 20, 10 << 30):
        h, several, runs = suffix_dedup.Block(table, suffix_dedup.anchor_bytes(total)).hashes()
        shares.append(runs[several].sum() / runs.sum())
    assert shares[0] > 0.25 and shares[1] < 0.01
    sizes = [suffix_dedup.anchor_bytes(1 << k) for k in range(60)]
    assert sizes[0] == suffix_dedup.ANCHOR and sizes == sorted(sizes) and sizes[-1] == suffix_dedup.LONGEST


@pytest.mark.parametrize("anchor", [20, 24, 32])
def test_suffix_dedup_is_exact_with_longer_anchors(spark, docs, rows, anchor):
    got = suffix_dedup.remove_repeats(docs, block_bytes=2000, bucket_bytes=500, hot_runs=anchor - 19, anchor=anchor).collect()
    assert ordered(got) == ordered(suffix_dedup.reference(rows))


def test_suffix_order():
    rng = np.random.default_rng(0)
    assert all(any((r + d) % 21 in suffix_dedup.COVER and (s + d) % 21 in suffix_dedup.COVER for d in range(21)) for r in range(21) for s in range(21))
    for letters, n in ((1, 200), (2, 1500), (26, 400)):
        base = rng.integers(97, 97 + letters, n).astype(np.uint8)
        text = np.concatenate([base, base[: n // 2], base[n // 3 :]])
        starts = np.arange(len(text) - 50)
        got = np.concatenate(list(suffix_dedup.sorted_suffixes(text, starts, limit=300)))
        data = text.tobytes()
        assert got.tolist() == sorted(starts.tolist(), key=lambda i: data[i:])


def test_line_dedup_is_exact(docs, rows, empty):
    for n_batches, fanout in ((4, 2), (1, 4), (3, 9)):
        got = line_dedup.digest(line_dedup.drop_repeated_lines(docs, n_batches=n_batches, fanout=fanout)).collect()
        assert ordered(got) == ordered(line_dedup.reference(rows))
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    out = line_dedup.rewritten(docs)
    assert out.columns == docs.columns and out.where("n_chars != length(text)").count() == 0


def test_line_runs_levels(spark):
    runs = line_dedup.LineRuns(fanout=2)
    for ids in ((9, 8), (7, 6), (5, 4), (3,)):
        runs.add(spark.createDataFrame([(1, 1, d) for d in ids] + [(2, d, d) for d in ids], "h1 long, h2 long, doc_id long"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert [tuple(r) for r in runs.repeated(3).collect()] == [(1, 1, 9)]


def test_line_keepers_come_from_the_anti_join(spark, monkeypatch):
    """No later step compares keepers: without the anti-join smaller ids would be among them."""
    batches = [spark.createDataFrame([(1, 1, d)], "h1 long, h2 long, doc_id long") for d in (9, 7, 5)]
    join = type(batches[0]).join
    for anti in (True, False):
        if not anti:
            monkeypatch.setattr(type(batches[0]), "join", lambda self, other, on=None, how=None: self if how == "left_anti" else join(self, other, on, how))
        runs = line_dedup.LineRuns(fanout=4)
        for batch in batches:
            runs.add(batch)
        assert ({r.keeper for r in runs.repeated(1).collect()} == {9}) == anti


def test_line_joins_shuffle_nothing(spark):
    """Runs are bucketed alike: merging two needs no exchange."""
    runs = line_dedup.LineRuns(fanout=9)
    for ids in ((9, 8), (7, 6)):
        runs.add(spark.createDataFrame([(1, d, d) for d in ids], "h1 long, h2 long, doc_id long"))
    plan = runs.repeated(1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_line_dedup_of_clashing_columns_and_outlying_ids(spark):
    line = "a line of more than twenty characters"
    rows = [(k, f"{line}\n{k}") for k in range(6)] + [(10**15, line), (None, f"x\n{line}"), (None, f"other {line}\n{line}"), (3, "own"), (3, line * 3000)]
    df = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], "doc_id long, text string, drop string, `dropped id` int, `Dropped Key` int")
    out = line_dedup.rewritten(df)
    assert out.columns == df.columns
    want = line_dedup.reference(rows)
    assert ordered((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()) == ordered((w[0], w[3]) for w in want)
    assert ordered(line_dedup.digest(line_dedup.drop_repeated_lines(df)).collect()) == ordered(want)


def test_near_duplicates_match_all_pairs(docs, rows, empty):
    got = near_dup.classes(docs).collect()
    want = near_dup.reference(rows)
    assert ordered((r.doc_id, r.class_id) for r in got) == ordered((d, c) for (d, _), c in zip(rows, want, strict=True))
    assert near_dup.classes(empty).count() == 0
    kept = near_dup.firsts(docs)
    assert kept.columns == docs.columns
    wordless = [d for d, t in rows if not (t or "").split()]
    assert ordered((r.doc_id,) for r in kept.collect()) == ordered((d,) for d in [*{c for (d, t), c in zip(rows, want, strict=True) if (t or "").split()}, *wordless])


def test_near_duplicates_with_equal_ids(spark):
    """doc_id is no row's identity: different texts of one id are linked by their texts only."""
    rng = random.Random(2)
    x, y, z = (words(rng, 40) for _ in range(3))
    rows = [(1, x), (1, y), (2, y), (3, x), (4, z), (4, z), (None, z), (None, words(rng, 30)), (None, None), (7, ""), (7, "")]
    df = spark.createDataFrame([(*r, k, "a") for k, r in enumerate(rows)], "doc_id long, text string, `row key` int, times string")
    got = ordered((r.doc_id, r.class_id) for r in near_dup.classes(df).collect())
    assert got == ordered(zip([d for d, _ in rows], near_dup.reference(rows), strict=True))
    kept = [(r.doc_id, r.text) for r in near_dup.firsts(df).collect()]
    assert ordered(kept) == ordered([(1, x), (1, y), (4, z), rows[7], rows[8], (7, ""), (7, "")])


def test_near_duplicate_star(spark):
    """Copies that are near the original but not near each other are one class."""
    rng = random.Random(1)
    base = words(rng, 200).split()
    texts = []
    for k in range(60):
        copy = base.copy()
        for at in rng.sample(range(200), 3):
            copy[at] = f"w{k}x{at}"
        texts.append(" ".join(copy))
    texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(df, small=4).collect()}
    assert got == dict(enumerate(near_dup.reference(list(enumerate(texts)))))


@pytest.mark.parametrize("rounds", [0, 4])
def test_near_duplicate_links_away_from_hubs(spark, rounds):
    """Groups that are apart from each other but share buckets; some links are far from every star's centre."""
    rng = random.Random(7)
    common = words(rng, 150).split()
    texts = []
    for _ in range(12):
        one = common + words(rng, 40).split()
        for _ in range(4):
            copy = one.copy()
            copy[rng.randrange(150, 190)] = words(rng, 1) + "q"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(near_dup.reference(list(enumerate(texts)))))
    assert len({*want.values()}) == 12
    got = {r.doc_id: r.class_id for r in near_dup.classes(df, small=2, rounds=rounds).collect()}
    assert got == want


def test_near_duplicates_with_repeated_lines(spark):
    """Links are by plain sets, so a line repeated many times must not hide a pair from the bands."""
    rng = random.Random(11)
    texts = []
    for k in range(120):
        base, line = words(rng, 64), words(rng, 10)
        texts += [base + (" " + line if k % 2 else ""), base + (" " + line) * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(near_dup.reference(list(enumerate(texts)))))
    assert len({*want.values()}) == 120
    assert {r.doc_id: r.class_id for r in near_dup.classes(df).collect()} == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    s = near_dup.prob_min_hash(np.concatenate([a, b]), np.repeat([0, 1], 400), np.ones(800), 2, 600)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.08


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation(), tokenizer.no_padding()
    odd = ["a <|endoftext|> b", "it's  DON'T \n\n a\t\tb \x1c c\x85d    e\n", "日本 🙂 ½²x_y　z", "\n", "x\n \ny "]
    encoder = packing.ChunkEncoder(path)
    for text, got in zip(odd, encoder.encode(odd), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    found = packing.pack_documents(docs, path, length=64, group_docs=16).collect()
    sequences, want = {}, []
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 64):
            piece = ids[at : at + 64]
            want.append((d, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)))
    assert ordered(tuple(r)[:5] for r in found) == ordered(want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("ranked", [True, False])
def test_chunks_part_texts_as_the_library_does(ranked, monkeypatch):
    """Runs of white space of all kinds at the start, inside and at the end, with few chunks held."""
    monkeypatch.setattr(packing, "CHUNKS_HELD", 40)
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = packing.ChunkEncoder(path), Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    if not ranked:
        encoder.ranked = None
    rng = random.Random(8)
    signs = [" ", " ", "\n", "\n", "\t", "\r", "\x1c", "\x85", "\u3000", "a", "the", "é", "日", "1", ".", "'s", "<|endoftext|>"]
    texts = ["", *("".join(rng.choices(signs[: rng.choice([4, 9, 16, 17])] + ["of"], k=rng.randint(1, 9))) for _ in range(4000))]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(part)] == want


def test_chunks_met_again_are_not_encoded_again(monkeypatch):
    """Words of every batch stay known while rare ones come and go, within the bound."""
    monkeypatch.setattr(packing, "CHUNKS_HELD", 400)
    encoder = packing.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    learned, learn = Counter(), encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new: learned.update(x.strip() for x in new) or learn(new))
    often = [f"word{chr(97 + i)}" for i in range(20)]
    for i in range(30):
        encoder.encode([" ".join(["x", *often, *(f"rare{i}q{k}" for k in range(60))])])
        assert len(encoder.known) + len(getattr(encoder, "older", ())) <= 400
    assert {learned[x] for x in often} == {1}


def test_packing_deals_equal_rows_and_long_texts_out(spark):
    """Neither rows without an id nor one long document land in one group."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(None, "one text")] * 900 + [(5, "ab cd " * 20000)], "doc_id long, text string")
    rows = packing.pack_documents(df, path, length=64, group_docs=32).collect()
    groups = Counter(r.sequence_id >> 32 for r in rows)
    assert sum(r.length for r in rows if r.doc_id == 5) == rows[[r.doc_id for r in rows].index(5)].doc_tokens
    assert max(groups.values()) < 6 * len(rows) / len(groups) and len(groups) > 20


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(3)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    bins: list[int] = []
    want = [None] * 500
    for k in sorted(range(500), key=lambda k: -sizes[k]):
        b = next((i for i, used in enumerate(bins) if used + sizes[k] <= 100), len(bins))
        if b == len(bins):
            bins.append(0)
        want[k] = (b, bins[b])
        bins[b] += sizes[k]
    assert packing.first_fit_decreasing(sizes, 100) == want


def test_bpe_equals_the_library(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation(), tokenizer.no_padding()
    own = bpe.loaded(path)
    odd = ["it's DON'T a<|endoftext|>b 12ΑΣ  ΣΑΣ é é ﬁ İ日本語 🙂🙂 ½²x_y　z q\x1cw\x85v'sa 'LL ", "<|endoftext|><|startoftext|>", "a\x00b� ́x", "zqxjkvbwpqz QQQ"]
    for text in [*odd, *[t or "" for _, t in rows]]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)
    want = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert ordered(bpe.round_trip(docs, path).collect()) == ordered(want)
    encoded = bpe.encode(docs, path)
    assert bpe.decode(encoded, path).where("text is null").count() == 0
    assert bpe.round_trip(empty, path).count() == 0


def test_tokens_of_every_code_point():
    """The libraries that the encoders use follow several versions of Unicode."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 97 == 0)]
    own, library = bpe.loaded(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    texts = [f"a{c}b {c}1{c} {c}e\u0301" for c in every]
    assert [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if own.encode(t) != e.ids] == []
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = packing.ChunkEncoder(path), Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    assert [t for t, got, e in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True) if np.frombuffer(got, "<u4").tolist() != e.ids] == []


def test_forced_boundaries_are_in_no_token():
    own = bpe.loaded(public_tokenizers.path("word_bpe_49k.json"))
    (parts,) = own.fragments(["日本é"])
    assert "".join(parts) == "".join(own.alphabet[b] for b in "日本é".encode())
    assert not own.joined[ord(" "), ord("a")]


def plain_pcm(tag, data):
    """Samples of 8-bit codes or ADPCM blocks, one at a time."""
    if tag != telephony.IMA:
        table = telephony.mulaw_table() if tag == telephony.MULAW else telephony.alaw_table()
        return [int(table[x]) for x in data]
    steps, change, out = telephony.step_sizes().tolist(), telephony.INDEX_CHANGE.tolist(), []
    for at in range(0, len(data), 576):
        block = data[at : at + 576]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out.append(value)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                s = steps[index]
                d = (s >> 3) + (s >> 2) * (code & 1) + (s >> 1) * (code >> 1 & 1) + s * (code >> 2 & 1)
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                index = max(0, min(88, index + change[code]))
                out.append(value)
    return out


def test_telephony_round_trip(spark, docs, rows, empty):
    stored = telephony.decode_media(telephony.encode_media(docs.unionByName(docs.limit(3)))).cache()
    halved = {r.doc_id: r.pcm for r in telephony.decode_media(stored, 4000).collect()}
    seen, want = set(), []
    for d, t in [*rows, *[(r.doc_id, r.text) for r in docs.limit(3).collect()]]:
        data = (t or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        tag = telephony.format_of(padded)
        seen.add(tag)
        media = telephony.wav(tag, padded, align=576 if tag == telephony.IMA else 1)
        assert telephony.parse_wav(media)[3] == padded
        full = plain_pcm(tag, padded)
        half = b"".join(((a + b) // 2).to_bytes(2, "little", signed=True) for a, b in zip(full[::2], full[1::2], strict=False))
        assert half in halved.values()
        pcm = b"".join(int(x).to_bytes(2, "little", signed=True) for x in full)
        (feature,) = telephony._features([pcm])
        want.append((d, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), len(media), hashlib.sha256(media).hexdigest(), {7: "mulaw ", 6: "alaw ", 17: "adpcm "}[tag] + feature))
    assert seen == {6, 7, 17}
    assert ordered(telephony.media_features(stored).collect()) == ordered(want)
    assert telephony.decode_media(stored, 16000).where("pcm is null or n_samples < 1152").count() == 0
    bad = spark.createDataFrame([(1, b"x", "a"), (2, None, "b")], "doc_id long, media binary, pcm string")
    assert [(r.pcm, r.n_samples) for r in telephony.decode_media(bad).collect()] == [(None, None)] * 2
    assert telephony.media_features(telephony.decode_media(telephony.encode_media(empty))).count() == 0


def test_media_are_encoded_and_decoded_by_one_worker(spark, docs, empty, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from tidemark.llm import queries

    all_docs = docs.unionByName(docs.limit(3))
    for to in (8000, 4000):
        apart = telephony.decode_media(telephony.encode_media(all_docs), to)
        assert ordered(telephony.encode_decoded(all_docs, to).select(*apart.columns).collect()) == ordered(apart.collect())
    assert telephony.encode_decoded(empty).count() == 0
    found = []
    made = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **b: found.append(f.__qualname__) or made(self, f, *a, **b))
    all_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op6_telephony(spark, str(tmp_path)).count() == all_docs.count()
    # One for what is stored, one for what is read back; both give back their memory.
    assert [x.split(".")[0] for x in found] == ["tidied"] * 2


def test_each_telephony_format_has_a_third_of_the_texts(spark):
    df = spark.createDataFrame([(k, f"text {k} " * (1 + k % 90)) for k in range(1500)], "doc_id long, text string")
    found = Counter(r.feature.split()[0] for r in telephony.media_features(telephony.decode_media(telephony.encode_media(df))).collect())
    assert set(found) == {"mulaw", "alaw", "adpcm"} and min(found.values()) > 420


def test_resampling():
    x = np.array([1, 3, -5, 8, 9], np.int16)
    assert telephony.resample(x, 8000, 4000).tolist() == [2, 1]
    assert telephony.resample(x, 8000, 16000)[:5].tolist() == [1, 2, 3, -1, -5]
    assert telephony.resample(x, 8000, 8000).tolist() == x.tolist()
    assert telephony.resample(x[:1], 8000, 4000).tolist() == [1]


def test_adpcm_and_g711_tables():
    assert telephony.mulaw_table()[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    rng = np.random.default_rng(4)
    blocks = rng.integers(0, 256, (7, 36)).astype(np.uint8)
    steps, change = telephony.step_sizes(), telephony.INDEX_CHANGE
    for block, got in zip(blocks, telephony.adpcm_blocks(blocks), strict=True):
        value, index = int(np.int16(block[0] | block[1].astype(np.int32) << 8)), min(int(block[2]), 88)
        out = [value]
        for byte in block[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                s = int(steps[index])
                d = (s >> 3) + (s >> 2) * (code & 1) + (s >> 1) * (code >> 1 & 1) + s * (code >> 2 & 1)
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                index = max(0, min(88, index + int(change[code])))
                out.append(value)
        assert got.tolist() == out
    assert telephony.parse_wav(b"nothing") is None


PAGES = "page_id long, url string, html string, first string"


def test_warc_round_trip(spark):
    rows = [(3, "http://a/b c\n", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "u", None), (5, "u", ""), (7, "u", "é" * 5000), (7, "u", "é" * 5000), (None, "n", "<p>x</p>"), (None, "n", "alone")]
    pages = spark.createDataFrame([(*r, "f") for r in rows], PAGES)
    got = ordered(warc.digest(warc.round_trip(pages, archive_bytes=300)).collect())
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        f = first.get(h or "")
        want.append((p, len(data), warc.base32_sha1(data), "response" if p == f else "revisit", None if p == f else f))
    assert got == ordered(want)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_salvage():
    records = [warc.record(k, f"http://x/{k}", bytes([65 + k]) * 300) for k in range(6)]
    members = [warc.member(x) for x in records]
    for parts in (members, records):
        data = bytearray(b"".join(parts))
        assert len(warc.salvage(bytes(data)).records) == 6
        start = len(parts[0]) + len(parts[1])
        data[start + 40 : start + 60] = b"\0" * 20
        found = warc.salvage(bytes(data))
        assert [h["x-page-id"] for _, h, _ in found.records] == ["0", "1", "3", "4", "5"]
        assert found.gaps[0][:2] == (start, len(parts[2]))
        cut = warc.salvage(bytes(data[: -len(parts[5]) // 2]))
        assert len(cut.records) == 4 and len(cut.gaps) == 2
    assert warc.salvage(b"junk" * 10).gaps[0][:2] == (0, 40)


def test_warc_salvage_inside_members():
    records = [warc.record(k, f"http://x/{k}", bytes([65 + k]) * 300) for k in range(5)]
    heads, _, _ = warc.parse_record(warc.record(9, "u", b"x", refers_to=3, revisit=True))
    assert {"warc-record-id", "warc-date", "warc-type", "content-length", "warc-refers-to"} <= {*heads}
    assert heads["warc-refers-to"] == warc.parse_record(warc.record(3, "v", b"x"))[0]["warc-record-id"]
    bad = bytearray(records[2])
    bad[-30] ^= 1
    one = warc.member(b"".join([*records[:2], bytes(bad), *records[3:]]))
    found = warc.salvage(one + warc.member(records[0]))
    assert [h["x-page-id"] for _, h, _ in found.records] == ["0", "1", "3", "4", "0"]
    assert [(a, n) for a, n, _ in found.gaps] == [(0, len(bad))]
    # Random blocks don't compress, so a cut member still has its first records.
    rng = np.random.default_rng(0)
    large = [warc.record(k, "u", rng.bytes(90_000)) for k in range(3)]
    data = warc.member(b"".join(large))
    found = warc.salvage(data[: len(data) // 2])
    assert [h["x-page-id"] for _, h, _ in found.records] == ["0"] and found.gaps[0][0] == 0


def test_warc_lost_pages_are_an_error(spark):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>") for k in range(4)], "page_id long, url string, html string")
    archives = warc.write_archives(pages).coalesce(1).collect()
    for content in (archives[0].content[:-9], archives[0].content[: archives[0].content.rindex(b"\x1f\x8b\x08")]):
        damaged = spark.createDataFrame([(archives[0].path, archives[0].n_records, bytes(content))], "path string, n_records long, content binary")
        assert warc.read_archives(damaged).where("kind = 'gap'").count() == 1
        with pytest.raises(Exception, match="lost records"):
            warc.digest(warc.read_archives(damaged)).collect()


def test_html_extraction(spark):
    crf = html_text.trained()
    right = total = 0
    for page, labels in html_text.labelled_pages(80, seed=123):
        blocks = html_text.blocks_of(page)
        assert len(blocks) == len(labels)
        right += sum(a == b for a, b in zip(crf.viterbi(crf.scores(html_text.features_of(blocks))), labels, strict=True))
        total += len(labels)
    assert right / total > 0.98
    page = '<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; &eacute;</h1><p><b>One\n two<br>three.<p>Four</article><script>var a="</p>";</script><footer>&copy; x</footer>'
    assert html_text.main_text(page, crf) == "T & é\n\nOne two three.\n\nFour"
    df = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (None, "u", "", "t"), (3, "u", "<<p>>< <p", "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[1].n_chars == len(got[1].text) and got[2].text == "" and got[None].n_chars == 0
    assert html_text.extract(df.limit(0)).count() == 0


#: Hand-written pages in layouts that the generator of labelled pages doesn't have, and their main texts.
BY_HAND = [
    ("<article><p>One long paragraph of the article, with a comma and quite a few words in it.</p><div class=comments><p>First!</p><p>I don't agree with any of this, and here is a long reason why.</p></div><aside>Side</aside><p>Last</p></article>", ["One long paragraph of the article, with a comma and quite a few words in it.", "Last"]),
    ("<body class='has-sidebar ads'><div id=wrap><div class='top-menu'><a href=/>Home</a> <a href=/b>Blog</a></div><article class=post><header><h1>A title</h1></header><p>Formula <math><mi>x</mi></math> and more words, as it goes on.</p><div class='ad-slot'>Buy now and save, only today, with free delivery for all of you.</div><p>The end of it.</p></article><footer>© 2020 Someone</footer></div>", ["A title", "Formula x and more words, as it goes on.", "The end of it."]),
    ("<main><h1>News</h1><p>It was cold in the north of the country, and snow fell until the evening.</p><aside><h3>Related</h3><ul><li><a href=1>Other</a></li><li><a href=2>Another story</a></li></ul></aside><h2>South</h2><p>It was warm there.</p><ul><li>Ten degrees at noon</li><li>Eight at night</li></ul><form><label>Your mail</label><button>Send</button></form></main>", ["News", "It was cold in the north of the country, and snow fell until the evening.", "South", "It was warm there.", "Ten degrees at noon", "Eight at night"]),
    ("<nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav><div class=cookie-banner>We use cookies to make this page better for you. <button>Accept</button></div><div class=entry-content><p>The first one of two.<p>The second one, which says a little more than the first.</div><section id=comments><h3>2 replies</h3><div class=comment><p>Nice article, thank you very much for writing it.</p></div></section>", ["The first one of two.", "The second one, which says a little more than the first."]),
    ("<article><h1>Privacy, cookies and you</h1><p>This long text is about what a cookie is, who has copyright, and what to subscribe to, as an article may well be; it is one and has no other part than this.</p><nav><a href=#a>Up</a></nav><figure><img src=a><figcaption>A cookie on a plate</figcaption></figure></article>", ["Privacy, cookies and you", "This long text is about what a cookie is, who has copyright, and what to subscribe to, as an article may well be; it is one and has no other part than this.", "A cookie on a plate"]),
]


@pytest.mark.parametrize("page, want", BY_HAND)
def test_html_pages_by_hand(page, want):
    assert html_text.main_text(page, html_text.trained()).split("\n\n") == want


def test_html_of_long_and_repeated_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph {k} of a very long page, with words &amp; more.</p>" for k in range(40_000)) + "</article>"
    df = spark.createDataFrame([(None, "u", long), (3, "v", long), (3, "v", long)], "page_id long, url string, html string")
    for r in html_text.extract(df).collect():
        assert r.text.count("\n\n") == 39_999 and r.n_chars == len(r.text) and "39999 of a very long page, with words & more." in r.text


def test_html_raw_ends_after_letters_that_grow_in_lower_case():
    page = "<p>" + "İ" * 40 + "</p><script>var a;</SCRIPT><p>one two</p><style>b</style><p>three</p>"
    assert [b.text for b in html_text.blocks_of(page)] == ["İ" * 40, "one two", "three"]
    assert [b.text for b in html_text.blocks_of("<script>'</ſcript>'</script>x")] == ["x"]


def test_crf_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    crf = html_text.LinearChainCRF(np.zeros((1, 2)), rng.normal(size=(2, 2)))
    s = rng.normal(size=(8, 2))
    score = lambda y: sum(s[i, y[i]] for i in range(8)) + sum(crf.move[y[i], y[i + 1]] for i in range(7))
    paths = [[k >> i & 1 for i in range(8)] for k in range(256)]
    assert score(crf.viterbi(s)) == pytest.approx(max(map(score, paths)))


def backoff_reference(rows, learn, orders=(4, 3, 2, 1)):
    """(language, score) of each text by the definition: known words, else the longest known n-grams."""
    letters = lambda t: "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (t or "").lower()).split()
    languages = sorted({lang for _, lang in learn})
    counts = {n: {x: Counter() for x in languages} for n in (0, *orders)}
    for text, lang in learn:
        for w in letters(text):
            counts[0][lang][w] += 1
            for n in orders:
                counts[n][lang].update(f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n))
    kinds = {n: set().union(*c.values()) for n, c in counts.items()}
    log = {n: {u: [math.log((c[x][u] + 0.5) / (sum(c[x].values()) + 0.5 * len(kinds[n]))) for x in languages] for u in kinds[n]} for n, c in counts.items()}
    floor = min(x for table in log.values() for u in table.values() for x in u) - 1
    out = []
    for text in rows:
        words = letters(text)
        total = [0.0] * len(languages)
        for w in words:
            score = log[0].get(w)
            if score is None:
                score, places, at, marked = [0.0] * len(languages), 0, 0, f"^{w}$"
                while at < len(marked):
                    n = next((n for n in orders if at + n <= len(marked) and marked[at : at + n] in log[n]), None)
                    score = [s + (log[n][marked[at : at + n]][k] - 0.5 * orders.index(n) if n else floor) for k, s in enumerate(score)]
                    at += max(1, n - 1) if n else 1
                    places += 1
                score = [s / places for s in score]
            total = [a + b for a, b in zip(total, score, strict=True)]
        best = total.index(max(total))
        out.append((languages[best], 1 / sum(math.exp((t - total[best]) / math.sqrt(len(words))) for t in total)) if words else ("und", 0.0))
    return out


def test_language_id_is_the_definition(spark):
    rng = random.Random(12)
    vocabulary = {"aa": [words(rng, 1) for _ in range(30)], "bb": ["ç" + words(rng, 1) for _ in range(30)], "cc": ["не" + words(rng, 1) for _ in range(30)]}
    rows = [(k, " ".join(rng.choice(vocabulary[lang] + ["same", "½", "x²y"]) for _ in range(25)), lang) for k, lang in enumerate(sorted(vocabulary) * 20)]
    rows += [(100, "½² ①", "aa"), (101, None, "aa"), (102, "9 _ !", None), (103, "same", None), (None, rows[0][1], "bb"), (1, rows[1][1], "bb"), (104, "qqq ççç ъъъ", "cc"), (105, rows[2][1] * 4000, None)]
    df = spark.createDataFrame([(*r, "p", 0.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    learn = [(t, lang) for d, t, lang in rows if t is not None and lang and d is not None and not held(d)]
    want = ordered((d, held(d), lang, round(p, 4)) for (d, _, _), (lang, p) in zip(rows, backoff_reference([t for _, t, _ in rows], learn), strict=True))
    assert ordered((r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in langid.identify(df).collect()) == want
    assert {r[2] for r in want if r[0] in (100, 101, 102)} == {"und"}
    stays = langid.identified(df, langid.fit(langid.training_rows(df)))
    assert stays.columns == df.columns and stays.count() == len(rows) - 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_language_id(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0
    assert got.where("score < 0 or score > 1").count() == 0
    assert {r.lang_pred for r in langid.identify(docs.where("text is null or trim(text) = ''")).collect()} == {"und"}
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark, docs, rows, empty):
    got = quality.judge(docs).collect()
    assert ordered(tuple(r)[:7] for r in got) == ordered((d, *base_reference(t)) for d, t in rows)
    assert not [r for r in got if r.kept and r.base_failed]
    assert quality.judge(empty).count() == 0


def base_reference(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if count[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len({*lines}), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_verdicts_are_the_definition(spark, monkeypatch):
    """kept, from a model in memory and exact medians; small shards and blocks, so that several are asked."""
    monkeypatch.setattr(quality, "SHARD", 500)
    rng = random.Random(21)
    rows = []
    for lang, letters in (("xx", "abcdefghi"), ("yy", "абвгдежз"), (None, "αβγδε")):
        vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(50)]
        good = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 150))) for _ in range(40)]
        bad = ["".join(rng.choice(letters + " ") for _ in range(900)), "zq# " * 90, " ".join(f"{k}|{k * k}" for k in range(80)), good[0] * 60]
        rows += [(len(rows) + k, t, lang) for k, t in enumerate([*good, *bad, "", None, good[1]])]
    rows += [(None, rows[0][1], "xx"), rows[3]]
    df = spark.createDataFrame([(*r, True, 1.5) for r in rows], "doc_id long, text string, lang string, kept boolean, low double")
    want = []
    for lang in ("xx", "yy", None):
        own = [(d, t or "") for d, t, x in rows if x == lang]
        symbol = lambda c: "0" if c.isdecimal() else c.lower()
        letters = sorted({symbol(c) for _, t in own for c in t})
        number = {c: k + 1 for k, c in enumerate(letters)}
        numbers = lambda t: [0, 0, 0] + [number[symbol(c)] for c in t]  # noqa: B023, E731
        codes_of = lambda t: [a * 48**3 + b * 48**2 + c * 48 + d for s in [numbers(t)] for a, b, c, d in zip(s, s[1:], s[2:], s[3:], strict=False)]  # noqa: B023, E731
        codes, counts = np.unique([g for _, t in own for g in codes_of(t)], return_counts=True)
        model = quality.KneserNey(codes, counts, len(letters))
        log_p = [-model.log_probability(np.array(codes_of(t))).mean() if t else None for _, t in own]
        sound = [k for k, (_, t) in enumerate(own) if t and not base_reference(t)[-1]]
        median = lambda x: sorted(x)[-(-len(x) // 2) - 1]
        center = median([log_p[k] for k in sound])
        spread = median([abs(log_p[k] - center) * len(own[k][1]) ** 0.5 for k in sound])
        for k, (d, t) in enumerate(own):
            want.append((d, k in sound and abs(log_p[k] - center) <= quality.LEAST + quality.WIDTH * spread / len(t) ** 0.5))
    got = quality.judge(df).collect()
    assert ordered((r.doc_id, r.kept) for r in got) == ordered(want)
    assert 100 < sum(k for _, k in want) < len(rows) - 9


def test_quality_counts_grow_with_the_corpus(spark):
    rng = random.Random(3)
    text = lambda: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))
    sizes = [spark.createDataFrame([(k, text(), "zh") for k in range(n)], "doc_id long, text string, lang string").mapInArrow(quality._count, "lang string, a long, b long, k long").select("a", "b").distinct().count() for n in (20, 80)]
    assert sizes[1] > 3.9 * sizes[0]


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    codes, counts = np.unique(rng.integers(0, 6, 4000) * 48**3 + rng.integers(0, 6, 4000) * 48**2 + rng.integers(0, 6, 4000) * 48 + rng.integers(0, 6, 4000), return_counts=True)
    model = quality.KneserNey(codes, counts)
    for history in (codes[0] // 48, codes[7] // 48, 40 * 48**2 + 3):
        p = np.exp(model.log_probability(history * 48 + np.arange(48)))
        assert p.sum() == pytest.approx(1, abs=1e-6) and (p > 0).all()


def test_quality_rejects_gibberish(spark):
    rng = random.Random(9)
    vocabulary = [words(rng, 1) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(60)]
    texts.append("".join(rng.choice("zqxwvkj0189#@ ") for _ in range(1500)) + " " + " ".join(f"{k}#z{k}" for k in range(60)))
    df = spark.createDataFrame([(k, t, "xx") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert not kept[60] and sum(kept.values()) >= 58


def test_quality_tells_letters_apart_in_every_script(spark):
    """Random letters in the good texts' own word lengths: only the letters differ."""
    rng = random.Random(4)
    rows = []
    for lang, letters in (("ru", "абвгдежзийклмнопрстуфхцчшщъыьэюя"), ("el", "αβγδεζηθικλμνξοπρστυφχψω"), ("hi", "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह")):
        vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60)]
        good = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(60)]
        bad = ["".join(rng.choice(letters) for _ in w) for w in good[0]]
        rows += [(len(rows) + k, " ".join(w), lang) for k, w in enumerate([*good, bad])]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for k in range(3):
        assert not got[61 * k + 60] and sum(got[61 * k + i] for i in range(60)) >= 58


def test_quality_has_a_model_for_every_language(spark):
    """A language's results don't depend on how many others there are, nor on the size of blocks."""
    rng = random.Random(6)
    rows = [(k, words(rng, 60), f"l{k % 40:02}") for k in range(160)]
    schema = "doc_id long, text string, lang string"
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, schema)).collect()}
    assert len({r.lang for r in got.values()}) == 40
    alone = [x for x in rows if x[2] == "l39"]
    for r in quality.judge(spark.createDataFrame(alone, schema)).collect():
        assert tuple(r) == pytest.approx(tuple(got[r.doc_id]))
    # The in-memory model over the same n-grams gives the same perplexities.
    letters = sorted({c for _, t, _ in alone for c in t})
    number = {c: k + 1 for k, c in enumerate(letters)}
    grams = lambda t: [sum(([0, 0, 0] + [number[c] for c in t])[i + j] * 48 ** (3 - j) for j in range(4)) for i in range(len(t))]
    codes, counts = np.unique([g for _, t, _ in alone for g in grams(t)], return_counts=True)
    model = quality.KneserNey(codes, counts, len(letters))
    for d, t, _ in alone:
        assert got[d].log_perplexity == pytest.approx(-model.log_probability(np.array(grams(t))).mean())


def test_grams_of_wide_alphabets():
    text = "".join(chr(0x20000 + k) for k in range(70000)) + "ab"
    a, b, which = quality.grams_of([text, "ab"])
    at = list(zip(a[which].tolist(), b[which].tolist(), strict=True))
    s = [quality.START] * 3 + [ord(c) for c in text]
    assert at[:70002] == [(s[i] << 21 | s[i + 1], s[i + 2] << 21 | s[i + 3]) for i in range(70002)] and len(at) == 70004


def resident_mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def test_workers_give_back_what_they_freed():
    kept = []

    def group(table):
        held = [np.ones(1 << 13, np.uint8) for _ in range(1 << 14)]
        kept.append(held[-1])  # what lies below it stays in the heap
        return table

    def stream(batches):
        for batch in batches:
            yield group(batch)

    table = pa.table({"x": [1]})
    group(table)
    before = resident_mb()
    assert tidied(group)(table) is table
    assert [*tidied(stream)([table, table])] == [table, table]
    assert tidied(lambda left, right: group(right))(None, table) is table
    assert resident_mb() < before + 40 - 60  # the first, untidied group's 128 MB have gone too
    # Spark tells a group's function from one with a key by its parameters.
    assert [len(inspect.signature(tidied(f)).parameters) for f in (group, stream, lambda left, right: left)] == [1, 1, 2]


def test_all_python_functions_of_the_pipeline_are_tidied(spark, tmp_path, docs, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.group import GroupedData
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    import corpus_pipeline

    found = []
    for kind, name in ((DataFrame, "mapInArrow"), (GroupedData, "applyInArrow"), (PandasCogroupedOps, "applyInArrow")):
        monkeypatch.setattr(kind, name, lambda self, f, *a, made=getattr(kind, name), **b: found.append(f.__qualname__) or made(self, f, *a, **b))
    docs.limit(20).write.parquet(str(tmp_path / "documents.parquet"))
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(found) > 10
    assert {x.split(".")[0] for x in found} == {"tidied"}


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = df.columns
    state = {r.doc_id: r.text for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        if name == "language_id":
            state = {d: t for d, t in state.items() if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            first = dict(zip(state, near_dup.reference(list(state.items())), strict=True))
            state = {d: t for d, t in state.items() if first[d] == d}
        elif name in ("line_dedup", "suffix_dedup"):
            reference = (line_dedup if name == "line_dedup" else suffix_dedup).reference(list(state.items()))
            got = {r.doc_id: r.text for r in df.collect()}
            for r in reference:
                if name == "line_dedup" or got[r[0]].encode() and "�" not in got[r[0]] and all(ord(c) < 128 for c in state[r[0]]):
                    assert hashlib.sha256(got[r[0]].encode()).hexdigest() == r[-1]
            state = got
        if name != "packing":
            assert df.columns == columns
            assert {r.doc_id: r.text for r in df.collect()} == state
    assert {r.doc_id for r in df.collect()} == {*state}
    assert ordered(corpus_pipeline.run(spark, str(tmp_path)).collect()) == ordered(df.collect())


def test_digests_keep_their_words_in_two_generations():
    """A full table forgets no word of the last generation, and results don't depend on what is held."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = bpe.loaded(path)
    texts = [f"common words {k} unheard{k}of again, <|endoftext|> naïve{k % 7}" if k % 5 == 0 else f"common words {k} other{k % 30}" for k in range(120)]
    learned = []
    plain = bpe._Digests(coder)
    small = bpe._Digests(coder, 40)
    learn, coder.learn = coder.learn, lambda chunks: learned.extend(chunks) or learn(chunks)
    try:
        got = [x for k in range(0, 120, 4) for x in small(texts[k : k + 4])]
    finally:
        coder.learn = learn
    assert got == plain(texts) and len(small.ids) <= 40
    # Met in every batch, so it moves on; texts with special tokens have a table of their own.
    assert learned.count("common") <= 2
    for text, (n, ids, decoded) in zip(texts, got, strict=True):
        want = coder.encode(text)
        assert n == len(want) and ids == " ".join(map(str, want)) and decoded == coder.decode(want)
    assert bpe.digests_of(path) is bpe.digests_of(path)


def test_class_ranges_are_the_library_s():
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        own = re.compile(f"[{bpe.class_ranges(name)}]+")
        sample = "".join(chr(c) for c in [*range(0x3000), 0xD7FB, 0xE000, 0xF900, 0xFEFF, 0xFF21, 0x10400, 0x1D7CE, 0x20000, 0x10FFFF])
        assert own.findall(sample) == [x[0] for x in pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(sample)]


def test_a_language_model_goes_with_its_broadcast():
    """Nothing of the process holds a model that Spark has let go, nor the scores of a task that has ended."""
    model = langid.WordFirstModel(["a", "b"], {("a", 0): {"ja": 2}, ("b", 0): {"no": 1}, ("a", 1): {"j": 1}, ("b", 1): {"n": 1}})
    shipped = SimpleNamespace(value=model)
    batch = pa.record_batch({"doc_id": pa.array([1], pa.int64()), "text": ["ja ja"]})
    assert [b.column("lang_pred").to_pylist() for b in langid._predict(shipped)(iter([batch]))] == [["a"]]
    assert sum(b.num_rows for b in langid._identified(shipped)(iter([batch]))) == 1
    assert not model._seen
    gone = weakref.ref(model)
    del model, shipped
    gc.collect()
    assert gone() is None


def test_features_follow_from_the_decoded_samples(spark):
    """op6: no other column stands in for what decode_media() makes."""
    docs = spark.createDataFrame([(k, f"text {k} " * 90) for k in range(12)], "doc_id long, text string")
    media = telephony.decode_media(telephony.encode_media(docs))
    changed = media.withColumn("pcm", F.expr("substring(pcm, 3)"))
    by = lambda df: {r["doc_id"]: r["feature"] for r in telephony.media_features(df).collect()}
    one, other = by(media), by(changed)
    assert all(one[k] != other[k] for k in range(12))
