"""Prefix tries, token alignment and license scans against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import PLAIN, ascii_lower
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gripelens.llm import align, licenses, queries, trie

SPEC, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TURNS = "conv_id long, turn long, role string, text string"


# Conversations ------------------------------------------------------------


def grouped(rows):
    """Turns by conversation: null turn first, ties by role and text."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in out.items()}


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(node[:-1] for node in members if node)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in own if len(convs[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(not kids[n] for n in below)
        out.append((min(own), len(node), parent, len(own), kids[node], leaves, saved, digest))
    return sorted(out, key=repr)


def spark_trie(turns, lengths, height):
    nodes, ends = trie.prefix_trie(turns, lengths, height)
    found = nodes.join(trie.member_digests(ends), "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted([(*[r[n] for n in names[:-1]], r["ends_sha256"] or none) for r in found.collect()], key=repr)


def deep(seed, n, most):
    rnd = random.Random(seed)
    rows, trunk = [], [("user", f"é{rnd.randrange(3)}") for _ in range(most)]
    for c in range(-3, n):
        own = trunk[: rnd.randrange(most)] + [("bot", str(rnd.randrange(2))) for _ in range(rnd.randrange(4))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(own)]
    return rows


@pytest.mark.parametrize("height, most", [(2, 23), (3, 9), (8, 12)])
def test_trie_in_bands(spark, height, most):
    rows = deep(height, 14, most)
    turns = trie.ordered_turns(spark.createDataFrame(rows, TURNS))
    assert spark_trie(turns, None, height) == plain_trie(grouped(rows))


def test_odd_conversations(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"),
        (2, 5, "user", ""), (None, 0, "user", "lost"), (5, 1, "a", "b:c"), (5, 2, "a:1", "c"),
        (-6, 1, "user", "x" * 50_000), (6, 1, "", "ab"), (7, 1, "a", "b"),
    ]
    frame = spark.createDataFrame(rows, TURNS)
    for name in ("place", "part", "at", "key", "depth", "length"):
        frame = frame.withColumn(name, F.lit(None).cast("string"))
    convs = grouped(rows)
    turns = trie.ordered_turns(frame)
    assert spark_trie(turns, None, 8) == plain_trie(convs)
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        giver = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = convs.get(giver, [])[:h] + own[h:]
    assert any(not v for v in rebuilt.values())
    assert spark_trie(*trie.grafted(turns), 8) == plain_trie(rebuilt)


def test_no_conversations(spark):
    none = trie.ordered_turns(spark.createDataFrame([], TURNS))
    assert spark_trie(*trie.grafted(none), 8) == []


# Tokenizers ----------------------------------------------------------------


@pytest.fixture(scope="module")
def aligner():
    with open(SPEC, "rb") as f, open(MODEL, "rb") as g:
        return align.Aligner(f.read(), g.read())


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(SPEC)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def plain_alignment(aligner, libraries, text):
    """(n_a, n_b, n_groups, n_links, digest, pairs) by looking at all overlaps."""
    if not text:
        return 0, 0, 0, 0, "", {}
    a = libraries[0].encode(" " + text, add_special_tokens=False).ids
    b = libraries[1].encode(text)
    raw = [[side.bytes[i] for i in ids] for side, ids in ((aligner.a, a), (aligner.b, b))]
    if any(b"".join(r) != (" " + text).encode() for r in raw):
        return 0, 0, 0, 0, "", {}
    ends = [np.cumsum([len(x) for x in r]) for r in raw]
    starts = [np.concatenate([[0], e[:-1]]) for e in ends]
    pairs = Counter()
    for i, x in enumerate(a):
        first = np.searchsorted(ends[1], starts[0][i], "right")
        last = np.searchsorted(starts[1], ends[0][i], "left")
        pairs.update((x, y) for y in b[first:last])
    groups, low = [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        own = [[str(t) for t, e in zip(ids, e_) if low < e <= end] for ids, e_ in ((a, ends[0]), (b, ends[1]))]
        groups.append("|".join(map(",".join, own)))
        low = end
    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
    return len(a), len(b), len(groups), sum(pairs.values()), digest, dict(pairs)


ODD = [
    "", None, " ", "\n\n a  b", "a<|endoftext|>b <s> </s> <unk> <0x41>", "日本語 123 ４", "x" * 800, "ab" * 300,
    "▁a ▁", "é \x00 z", "\U0001f926\U0001f3fd", "a\r\nb\t\tc   ", "'s 'll don't I'LL", "ﬁ Å ①", "1 2 3 " * 90,
]


def shown(aligner, found):
    pairs, times = found.merged()
    width = aligner.b.size
    counted = {(int(p) // width, int(p) % width): int(n) for p, n in zip(pairs, times)}
    digest = found.digest.hexdigest() if found.digest else ""
    return found.n_a, found.n_b, found.n_groups, found.n_links, digest, counted


@pytest.mark.parametrize("part, chunk, cursor", [(1 << 16, 2 << 20, 128), (40, 300, 4), (7, 50, 2)])
def test_alignment_equals_libraries(aligner, libraries, texts, monkeypatch, part, chunk, cursor):
    for name, value in (("PART_CHARS", part), ("CHUNK_CHARS", chunk), ("CURSOR_TOKENS", cursor)):
        monkeypatch.setattr(align, name, value)
    rnd = random.Random(part)
    mixed = ["".join(rnd.choice(letters) for _ in range(400)) for letters in ("ab", " a", "aeinst hT'\n", "1é ")]
    some = [*ODD, *mixed, *[t for _, t in texts[:40]]]
    for text, found in zip(some, aligner.run(some)):
        assert shown(aligner, found) == plain_alignment(aligner, libraries, text)


def test_very_long_text_in_parts(aligner, monkeypatch):
    text = "some words and 12 more, or 3\n" * 20_000
    assert len(align.parts_of(text)) > 5 and " ".join(align.parts_of(text)) == text
    (cut,) = aligner.run([text])
    monkeypatch.setattr(align, "PART_CHARS", 1 << 30)
    (whole,) = aligner.run([text])
    assert shown(aligner, cut) == shown(aligner, whole)


@pytest.mark.parametrize("frequent", [0, 300])
def test_alignment_counts(spark, aligner, libraries, documents, texts, frequent):
    some = documents.filter("doc_id < 60 OR doc_id IS NULL")
    extra = spark.createDataFrame([(-i, t) for i, t in enumerate(ODD, 1)], "doc_id long, text string")
    frame = some.select("doc_id", "text").union(extra).coalesce(1)
    rows = {i: t for i, t in texts if i < 60} | {-i: t for i, t in enumerate(ODD, 1)}
    plain = {i: plain_alignment(aligner, libraries, t) for i, t in rows.items()}
    docs = Counter(p for *_, pairs in plain.values() for p in pairs)
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    got = align.alignment_counts(frame, SPEC, MODEL, frequent=frequent).collect()
    assert len(got) == len(rows)
    for r in got:
        *counts, digest, pairs = plain[r["doc_id"]]
        best = sum(n for p, n in pairs.items() if docs[p] == most[p[0]])
        total = sum(n * docs[p] for p, n in pairs.items())
        assert [r[n] for n in ("n_a", "n_b", "n_groups", "n_links")] == counts
        assert (r["n_best"], r["count_sum"], r["groups_sha256"]) == (best, total, digest)


def test_alignment_of_odd_rows(spark, odd):
    odd = odd.coalesce(1)
    got = align.alignment_counts(odd, SPEC, MODEL)
    assert got.count() == odd.count()
    zero = got.filter("doc_id IN (1, 2)").collect()
    assert [(r["n_a"], r["n_links"], r["groups_sha256"]) for r in zero] == [(0, 0, "")] * 2
    assert align.alignment_counts(odd.limit(0), SPEC, MODEL).count() == 0
    groups = align.aligned(odd.filter("doc_id = 7"), SPEC, MODEL, groups=True).first()
    assert hashlib.sha256(groups["groups"].encode()).hexdigest() == groups["groups_sha256"]


# Licenses ------------------------------------------------------------------


def plain_scan(text):
    words = PLAIN.findall(ascii_lower(text))
    at = [
        (i, label)
        for label, phrase in licenses.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    met = {}
    for start in range(0, max(len(words) - licenses.BLOCK, 0) + licenses.STRIDE, licenses.STRIDE):
        block = set(words[start : start + licenses.BLOCK])
        for label, template in licenses.TEMPLATES:
            wanted = set(licenses.words_of(template))
            share = len(block & wanted) / len(wanted)
            if share >= licenses.CONTAINED - 1e-9:
                met[start, label] = share
    return len(words), sorted(at), met


def noticed(seed):
    """Texts with notices, whole or with words lost, doubled or moved."""
    rnd = random.Random(seed)
    common = "the of and to in is a by for under license software public any free version".split()
    out = []
    for _, template in licenses.TEMPLATES:
        for lost in (0, 1, 2):
            words = template.split()
            for _ in range(lost):
                words.pop(rnd.randrange(len(words)))
            if lost:
                rnd.shuffle(words)
            before = [rnd.choice(common) for _ in range(rnd.randrange(90))]
            out.append(" ".join([*before, *words, *[rnd.choice(common) for _ in range(rnd.randrange(90))]]))
    return [*out, None, "", "MIT License mit LICENSE. cc-by cc by " * 40, "GNU General\nPublic license"]


def test_license_scan(spark):
    rows = list(enumerate(noticed(3)))
    frame = spark.createDataFrame([*rows, (None, "mit license"), (0, rows[0][1])], "doc_id long, text string")
    got = licenses.scanned(frame).collect()
    assert len(got) == len(rows) + 2
    texts, hits = dict(rows) | {None: "mit license"}, 0
    for r in got:
        n, at, met = plain_scan(texts[r["doc_id"]])
        assert r["n_words"] == n
        assert [(p["at"], p["label"]) for p in r["places"]] == at
        assert {(b["first_word"], b["label"]): pytest.approx(b["contained"]) for b in r["blocks"]} == met
        assert r["score"] == pytest.approx(1.0 if at else max(met.values(), default=0.0))
        hits += len(met)
    assert hits > 40


def test_license_scan_of_odd_rows(spark, odd):
    got = licenses.scanned(odd)
    assert got.count() == odd.count() and got.filter("score > 0").count() == 0
    assert licenses.scanned(odd.limit(0)).count() == 0
    assert licenses.scanned(odd, templates=()).count() == odd.count()
    with pytest.raises(ValueError):
        licenses.scanned(odd, templates=[("long", "word " * 40)])


def test_license_plan_has_no_python(spark, documents):
    plan = licenses.scanned(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_new_queries_are_registered():
    assert {"op11_conversation_trie", "op12_token_alignment", "op13_license_scan"} <= set(queries.QUERIES)
