"""BPE against the tokenizers library, suffix arrays and the lattice against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SPACE, ascii_lower
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gripelens.llm import bpe, lattice, queries, suffixes

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.read_spec(WORDS)))


ODD = [
    "", " ", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "ΑΣ ΣΑΣ İx ǅ",
    "x" * 5000, "ab" * 3000, "the" * 2000 + "é" * 900, "é ́a Å", "\x85 \xa0a　b\x1cc\x1f",
    "don't I'LL we're 'S", "日本語 123 ４", "ͅ\u0000a​b", "\U0001f926\U0001f3fd‍♂",
]


def test_encoder_equals_library(encoder, texts):
    library = Tokenizer.from_file(WORDS)
    for text in [*ODD, *[t for _, t in texts[:80]]]:
        want = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == want
        joined = bpe.joined_tokens(encoder.v, want)
        assert joined == library.decode(want, skip_special_tokens=False)


def test_stream_equals_whole(encoder):
    """Tokens sent out early are those of the whole word, for words of any length."""
    rnd = random.Random(4)
    v = encoder.v
    for alphabet in ("ab", "aeinst", "abcdefghijklmnopqrstuvwxyz"):
        word = "".join(rnd.choice(alphabet) for _ in range(6 * v.lookahead))
        symbols = [v.byte_ids[b] for b in word[:-1].encode()] + [v.last_ids[ord(word[-1])]]
        assert list(encoder.stream([v.bytes[b] for b in word.encode()])) == encoder._merged(symbols)


def test_blocks_do_not_change_tokens(encoder, monkeypatch):
    text = "some words, and more of them; " * 40
    want = encoder.encode(text)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    assert encoder.encode(text) == want


def test_decode_round_trip(spark):
    rows = [(1, "plain words only"), (2, "héllo 日本"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = bpe.decode_tokens(bpe.encode_tokens(docs, WORDS), WORDS)
    assert {r.doc_id: r.decoded for r in out.collect()} == dict(rows)


def test_bpe_query(spark, sf, texts, odd):
    library = Tokenizer.from_file(WORDS)

    def want(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        forms = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        return len(ids), *[hashlib.sha256(x.encode()).hexdigest() for x in forms]

    got = {r[0]: tuple(r[1:]) for r in queries.op3_bpe_streams(spark, sf).collect()}
    assert got == {d: want(t) for d, t in texts}
    rows = sorted(map(repr, (tuple(r) for r in bpe.encode_digests(odd, WORDS).collect())))
    assert rows == sorted(repr((r.doc_id, *want(r.text))) for r in odd.collect())
    assert bpe.encode_digests(odd.limit(0), WORDS).count() == 0


def repeats(rows, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        own = [raw[i : i + length] for i in range(len(raw) - length + 1)]
        for i, s in enumerate(own):
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for i, c in enumerate(gone) if c and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, c in zip(raw, gone) if not c)
        out[doc_id] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def removed(docs, **options):
    digest = F.coalesce(F.sha2("kept", 256), "text_key")
    found = suffixes.remove_repeats(docs, **options)
    return [tuple(r) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", digest).collect()]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 600])
def test_repeats_equal_brute_force(spark, shard_bytes):
    """Small shards make grams go to several shards that are merged."""
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abé ") for _ in range(400)) for _ in range(4)]
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    rows = [(0, "x" * 1000), (1, None), (2, ""), (3, "x" * 150), (4, "ab" * 400), (5, "é" * 300)]
    for i in range(6, 90):
        a, b, j, k = rnd.choice(base), rnd.choice(base), rnd.randint(0, 350), rnd.randint(0, 350)
        text = a[j : j + rnd.randint(0, 200)] + rnd.choice(["", "z"]) + b[k : k + rnd.randint(0, 250)]
        rows.append((i, text))
    rows += [(150, rows[70][1]), (151, base[0] + base[1]), (152, "q" * 60 + base[0][:99])]
    for i in range(200, 240):
        rows.append((i, noise(rnd.randint(80, 130)) + base[3][50 : 50 + rnd.choice([90, 99, 100, 101])] + noise(120)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r[0]: r[1:] for r in removed(docs, shard_bytes=shard_bytes)} == repeats(rows)


def test_repeats_of_odd_rows(odd):
    want = repeats([(r.doc_id, r.text) for r in odd.collect()])
    for doc_id, *rest in removed(odd):
        assert doc_id is None or tuple(rest) == want[doc_id]
    assert removed(odd.limit(0)) == []


def test_suffix_query(spark, sf, texts):
    got = {r[0]: tuple(r[1:]) for r in queries.op8_suffix_arrays(spark, sf).collect()}
    assert got == repeats(texts)


def test_suffix_order():
    rnd = np.random.default_rng(1)
    raw = rnd.integers(97, 99, 400).astype(np.uint8)
    left = 400 - np.arange(400)
    order, _ = suffixes.suffix_array(raw, left, 400)
    data = raw.tobytes()
    assert order.tolist() == sorted(range(400), key=lambda i: data[i:])
    shared = suffixes.common_prefixes(raw, left, np.array([0]), order, 400)
    for a, b in zip(order, order[1:]):
        n = shared[b]
        assert data[a : a + n] == data[b : b + n] and data[a + n : a + n + 1] != data[b + n : b + n + 1]


@pytest.mark.parametrize("length", [1, 7, 8, 12, 33, 100])
def test_equal_strings_equal_brute_force(length):
    """Zero bytes at the end of a text are bytes, not its end."""
    rnd = random.Random(length)
    for alphabet in (b"a", b"ab", b"a\0", b"abc\0"):
        base = bytes(rnd.choice(alphabet) for _ in range(300))
        parts = [base[j : j + rnd.randint(0, 200)] for j in (rnd.randint(0, 290) for _ in range(12))]
        places, at = collections.defaultdict(list), 0
        for part in parts:
            for i in range(len(part) - length + 1):
                places[part[i : i + length]].append(at + i)
            at += len(part)
        ends = np.cumsum([len(p) for p in parts])
        raw = np.frombuffer(b"".join(parts), np.uint8)
        left = np.repeat(ends, [len(p) for p in parts]) - np.arange(raw.size)
        found = collections.defaultdict(list)
        for place, group in zip(*suffixes.equal_strings(raw, left, length)):
            found[group].append(int(place))
        assert sorted(sorted(f) for f in found.values()) == sorted(p for p in places.values() if len(p) > 1)


TOY = ["▁", "a", "b", "ab", "▁a", "▁ab", "<0x61>", "<0xC3>", "<0xA9>", "c"]
TOY_P = np.log(np.array([0.1, 0.2, 0.1, 0.05, 0.2, 0.05, 0.1, 0.05, 0.05, 0.1]))


def marginal(word):
    text, p = "▁" + word, dict(zip(TOY, TOY_P))
    ways = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        ways[j] = sum(ways[i] * math.exp(p[text[i:j]]) for i in range(j) if text[i:j] in p)
        if text[j - 1] not in p:
            spelt = sum(p.get(f"<0x{b:02X}>", -1e30) for b in text[j - 1].encode())
            ways[j] += ways[j - 1] * math.exp(max(spelt, (TOY_P.min() - 10) * 4))
    return math.log(ways[-1])


def test_lattice_sums_all_segmentations():
    model = lattice.Lattice(TOY, TOY_P)
    words = ["a", "ab", "abab", "abcab", "é", "aéb", "z", "b" * 70]
    assert np.allclose(model.log_probability(words), [marginal(w) for w in words])


def test_expected_uses_are_the_derivative():
    found = lattice.Lattice(TOY, TOY_P).expected(["abab", "ba"])
    at = lattice.Lattice(TOY, TOY_P).log_probability(["abab", "ba"]).sum()
    for i in range(len(TOY)):
        moved = TOY_P.copy()
        moved[i] += 1e-6
        there = lattice.Lattice(TOY, moved).log_probability(["abab", "ba"]).sum()
        assert abs((there - at) / 1e-6 - found[i]) < 1e-4


def base_scores(rows):
    counts, tokens = collections.Counter(), []
    for doc_id, text in rows:
        own = SPACE.findall(ascii_lower(text)) + ["\0end"]
        out = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1
        tokens.append((doc_id, out, own))
        if not out:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    score = lambda w: math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1)))
    return [(d, o, len(w), sum(counts[x] > 0 for x in w), n, sum(map(score, w))) for d, o, w in tokens]


@pytest.mark.parametrize("frequent", [50, lattice.FREQUENT])
def test_scores(documents, texts, frequent):
    """Frequent words and joined words give the same sums."""
    got = {r.doc_id: r for r in lattice.score_texts(documents, PIECES, frequent=frequent).collect()}
    for doc_id, *want, base in base_scores(texts):
        r = got[doc_id]
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == want
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0


def test_held_out_texts_are_not_learned(documents):
    changed = documents.withColumn(
        "text", F.when(lattice.held_out(F.col("doc_id")), F.lit("zzz qqq")).otherwise(F.col("text"))
    )
    a, b = ({r.doc_id: r for r in lattice.score_texts(d, PIECES).collect()} for d in (documents, changed))
    for doc_id, r in a.items():
        if not r.held_out:
            assert abs(r.score - b[doc_id].score) < 1e-6 * abs(r.score)


def test_scores_of_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = lattice.score_texts(odd, PIECES).collect()
    want = base_scores(rows)
    key = lambda r: repr(tuple(r[:5]))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert lattice.score_texts(odd.limit(0), PIECES).count() == 0
