"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list decides how far to the right of a token boundary the text can still
change it: a merge (u, v) can only be prevented from the right when a symbol on
the right edge of v is taken by an earlier merge with what follows, which in turn
depends on thefts further right by still earlier merges.  ``lookahead`` sums the
longest such chain.  A pre-token of more than 48 bytes is therefore encoded through
a buffer: tokens whose end lies at least that many characters before the buffer's
end are final and are sent out, the rest stays.  Shorter ones are merged whole, many
at once, and cached.  The text and its waiting chunks are held besides.

Text is read in blocks cut at blanks, where no token can cross.  The decoder
takes one token at a time and keeps at most the bytes of an unfinished character;
``decode_tokens`` uses it, ``encode_digests`` joins the token strings by blanks.

The vocabulary is a tokenizer file in the public JSON layout; it is read on the
driver and handed to the tasks (a few MB, independent of the data).
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gripelens.llm.words import KeyTable, sliced

CACHE_ENTRIES = 200_000
BLOCK_CHARS = 1 << 20
WAITING_CHUNKS = 500_000
_FAR = 1 << 40


#: What one chunk becomes: token count, ids and tokens, each joined by blanks.  A
#: plain tuple of plain values, which the garbage collector need not follow.
Piece = tuple[int, str, str]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others, in order, for the
    characters from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merges, ids and special tokens of a word-end BPE tokenizer file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.tokens |= {i: t for t, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): k for k, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        parts = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, parts))) if parts else None
        self.bytes = byte_alphabet()
        self.byte_ids = [self.ids[c] for c in self.bytes]
        self.last_ids = [self.ids[c + self.end] for c in self.bytes]
        self.lookahead = lookahead(self, pairs)


def lookahead(vocabulary: Vocabulary, pairs: list[tuple[str, str]]) -> int:
    """Characters to the right of a boundary that can still change it.

    ``reach[(u, v)]`` is how far right of the boundary between u and v the merge
    depends on the text: v itself, and, for every symbol s on the right edge of
    v, the earlier merges (s, x) that would take s before it is used.  Merges come
    in rank order, so the reach of all earlier ones is known.
    """
    end = vocabulary.end
    size = lambda t: len(t) - len(end) if end and t.endswith(end) else len(t)
    thefts: dict[str, list[int]] = {}  # left symbol -> best reach so far
    edge: dict[str, list[tuple[str, int]]] = {}  # token -> its right-edge symbols
    longest = 1
    for u, v in pairs:
        depends = size(v)
        for s in (v, *(x for x, _ in edge.get(v, ()))):
            depends = max(depends, size(v) + thefts.get(s, [0])[0])
        best = thefts.setdefault(u, [0])
        best[0] = max(best[0], depends)
        edge[u + v] = [(v, 0), *edge.get(v, ())]
        longest = max(longest, depends)
    return longest + 1  # one more: whether the word ends there


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left << 24) | right


class Encoder:
    """Streams text to tokens; keeps a bounded cache of blank-separated chunks.

    No pre-token crosses white space, so a chunk between blanks always gives the
    same tokens.  The chunks of a few megabytes of text that are not cached are
    merged together, one array step for the next merge of each of them.
    """

    def __init__(self, vocabulary: Vocabulary, cache_entries: int = CACHE_ENTRIES):
        self.v = vocabulary
        pairs = np.array(list(vocabulary.rank), np.int64).reshape(-1, 2)
        self.table = KeyTable(_pair(*pairs.T), np.array(list(vocabulary.rank.values())), _FAR)
        self.made = np.array(vocabulary.made, np.int64)
        self.cache: dict[str, Piece] = {}
        self.cache_entries = cache_entries
        self.id_text = {i: str(i) for i in vocabulary.tokens}

    def _merged(self, symbols: list[int]) -> list[int]:
        """Merge one list of symbols, lowest rank first, leftmost among equals."""
        rank, made = self.v.rank, self.v.made
        order = [rank.get(p, _FAR) for p in zip(symbols, symbols[1:])]
        while order:
            first = min(order)
            if first == _FAR:
                break
            i = order.index(first)
            symbols[i : i + 2] = [made[first]]
            del order[i]
            if i:
                order[i - 1] = rank.get((symbols[i - 1], symbols[i]), _FAR)
            if i < len(order):
                order[i] = rank.get((symbols[i], symbols[i + 1]), _FAR)
        return symbols

    def _merged_many(self, words: list[list[int]]) -> list[list[int]]:
        """``_merged`` of many short lists of about equal length."""
        sizes = np.array([len(w) for w in words])
        n, width = len(words), int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        symbols = np.zeros((n, width + 1), np.int64)
        symbols[:, :-1][inside] = np.fromiter((s for w in words for s in w), np.int64, int(sizes.sum()))
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        order = np.full((n, width), _FAR, np.int64)
        pairs = inside[:, 1:]
        order[:, :-1][pairs] = self.table.get(_pair(symbols[:, :-2][pairs], symbols[:, 1:-1][pairs]))
        alive, rows = inside.copy(), np.arange(n)
        while rows.size:
            at = order[rows].argmin(1)
            first = order[rows, at]
            going = first < _FAR
            rows, at, first = rows[going], at[going], first[going]
            gone = after[rows, at]
            new, right, left = self.made[first], after[rows, gone], before[rows, at]
            symbols[rows, at] = new
            after[rows, at], before[rows, right] = right, at
            alive[rows, gone] = False
            order[rows, gone] = order[rows, at] = _FAR
            has = right < sizes[rows]
            order[rows[has], at[has]] = self.table.get(_pair(new[has], symbols[rows[has], right[has]]))
            has = left >= 0
            order[rows[has], left[has]] = self.table.get(_pair(symbols[rows[has], left[has]], new[has]))
        flat, ends = symbols[:, :-1][alive].tolist(), np.cumsum(alive.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def stream(self, characters: Iterable[str]) -> Iterator[int]:
        """Token ids of one pre-token, given as byte-level characters.

        At most two lookaheads of characters are held.
        """
        v, ahead = self.v, self.v.lookahead
        buffer: list[str] = []
        source = iter(characters)
        following = next(source, None)
        while following is not None:
            while following is not None and len(buffer) < 2 * ahead + 64:
                symbol, following = following, next(source, None)
                buffer.append(symbol if following is not None else symbol + v.end)
            found = self._merged([v.ids[c] for c in buffer])
            if following is None:
                yield from found
                return
            at = 0
            for token in found:
                if at + len(v.tokens[token]) + ahead > len(buffer):
                    break
                at += len(v.tokens[token])
                yield token
            buffer = buffer[at:]

    def learn(self, chunks: set[str]) -> None:
        """Put these chunks into the cache, which is emptied first if it is full."""
        if len(self.cache) > self.cache_entries:
            self.cache.clear()
        cache, v = self.cache, self.v
        missing = [c for c in chunks if c not in cache]
        parts = {c: v.pattern.findall(c) for c in missing}
        words = sorted({w for found in parts.values() for w in found if w not in cache}, key=len)
        ids: dict[str, list[int]] = {}
        short: list[tuple[str, list[int]]] = []
        byte_id = v.byte_ids.__getitem__
        for word in words:
            raw = word.encode()
            if len(raw) > 48:
                ids[word] = list(self.stream([v.bytes[b] for b in raw]))
            else:
                short.append((word, [*map(byte_id, raw[:-1]), v.last_ids[raw[-1]]]))
        for i in range(0, len(short), 8192):
            block = short[i : i + 8192]
            ids |= zip([w for w, _ in block], self._merged_many([s for _, s in block]))
        shown, token = self.id_text.__getitem__, v.tokens.__getitem__
        for word, found in ids.items():
            cache[word] = (len(found), " ".join(map(shown, found)), " ".join(map(token, found)))
        known = cache.__getitem__
        for chunk, found in parts.items():
            if len(found) == 1 and found[0] == chunk:
                continue
            if not found:
                cache[chunk] = (0, "", "")
                continue
            counts, id_texts, token_texts = zip(*map(known, found))
            cache[chunk] = (sum(counts), " ".join(id_texts), " ".join(token_texts))

    def chunks(self, text: str) -> Iterator[list[str] | Piece]:
        """A text as lists of chunks, a block at a time, and its special tokens."""
        special, at = self.v.special_pattern, 0
        for match in special.finditer(text) if special else ():
            yield from self._blocks(text, at, match.start())
            token = self.v.special[match.group()]
            yield (1, str(token), match.group())
            at = match.end()
        yield from self._blocks(text, at, len(text))

    def _blocks(self, text: str, start: int, stop: int) -> Iterator[list[str]]:
        while start < stop:
            cut = stop
            if stop - start > BLOCK_CHARS:
                blank = text.rfind(" ", start, start + BLOCK_CHARS) + 1
                cut = blank if blank > start else _next_blank(text, start + BLOCK_CHARS, stop)
            block = text[start:cut]
            if not block.isascii():
                block = unicodedata.normalize("NFC", block).replace("Σ", "σ")
            block = block.lower()
            # str.split also cuts at these four, which are no white space here
            odd = any(c in block for c in "\x1c\x1d\x1e\x1f")
            yield self.v.pattern.findall(block) if odd else block.split()
            start = cut

    def encode_all(self, texts: Iterable[str], take: Callable[[int, list[Piece]], None]) -> None:
        """Call ``take(i, pieces)`` for each text, in order, a block at a time."""
        waiting: list[tuple[int, list[str] | Piece]] = []
        held = 0

        def flush() -> None:
            self.learn({c for _, b in waiting if not isinstance(b, tuple) for c in b})
            get = self.cache.__getitem__
            for i, block in waiting:
                take(i, [block] if isinstance(block, tuple) else [*map(get, block)])
            waiting.clear()

        for i, text in enumerate(texts):
            for block in self.chunks(text):
                waiting.append((i, block))
                held += 1 if isinstance(block, tuple) else len(block)
                if held > WAITING_CHUNKS:
                    flush()
                    held = 0
        flush()

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        self.encode_all([text], lambda _, found: ids.extend(int(i) for p in found for i in p[1].split()))
        return ids


def _next_blank(text: str, start: int, stop: int) -> int:
    at = text.find(" ", start, stop)
    return stop if at < 0 else at + 1


def joined_tokens(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """Tokens joined by blanks: what a tokenizer without a decoder returns."""
    return " ".join([vocabulary.tokens[i] for i in ids])


class Decoder:
    """Tokens to readable text, one at a time.

    A byte-level token may end inside a character; its bytes wait until the next
    token completes them.  A word end becomes a blank before the next word.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.byte = {c: b for b, c in enumerate(vocabulary.bytes)}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.blank = False

    def push(self, token: int) -> str:
        text, out = self.v.tokens[token], ""
        if self.blank:
            out, self.blank = self.state.decode(b"", True) + " ", False
            self.state.reset()
        if token in self.v.special.values():
            self.blank = True
            return out + text
        if self.v.end and text.endswith(self.v.end):
            text, self.blank = text[: -len(self.v.end)], True
        return out + self.state.decode(bytes(self.byte[c] for c in text))

    def close(self) -> str:
        return self.state.decode(b"", True)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


_ADDED = (
    ("n_tokens", T.LongType(), pa.int64()),
    ("ids_sha256", T.StringType(), pa.string()),
    ("decoded_sha256", T.StringType(), pa.string()),
)


def _digests(encoder: Encoder, texts: list[str]) -> list[tuple[int, str, str]]:
    """(tokens, digest of the ids, digest of the joined tokens) of each text."""
    counts = [0] * len(texts)
    ids = [hashlib.sha256() for _ in texts]
    tokens = [hashlib.sha256() for _ in texts]

    def take(i: int, found: list[Piece]) -> None:
        found = [p for p in found if p[0]]
        if found:
            gap = " " if counts[i] else ""
            own, id_texts, token_texts = zip(*found)
            counts[i] += sum(own)
            ids[i].update((gap + " ".join(id_texts)).encode())
            tokens[i].update((gap + " ".join(token_texts)).encode())

    encoder.encode_all(texts, take)
    return [(n, a.hexdigest(), b.hexdigest()) for n, a, b in zip(counts, ids, tokens)]


def encode_digests(docs: DataFrame, path: str, text: str = "text", keys=("doc_id",)) -> DataFrame:
    """``keys`` with n_tokens, ids_sha256 and decoded_sha256 of the whole text.

    A null text is an empty one: no tokens, the digests of an empty string.  Rows
    are independent, so repeated rows give repeated results and an empty table an
    empty one.  Other columns are not read and cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    keys = list(keys)
    source = docs.select(*keys, docs[text].alias("_text"))

    def run(batches):
        encoder = Encoder(Vocabulary(shared.value))
        gc.disable()  # the cache holds no cycles, but following it costs a fifth of the time
        try:
            for batch in sliced(batches, "_text"):
                rows = _digests(encoder, [t or "" for t in batch.column("_text").to_pylist()])
                made = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(_ADDED)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k) for k in keys] + made, names=keys + [n for n, _, _ in _ADDED]
                )
        finally:  # other queries run in the same process
            gc.enable()

    schema = T.StructType(
        [source.schema[k] for k in keys] + [T.StructField(n, t) for n, t, _ in _ADDED]
    )
    return source.mapInArrow(run, schema)


def encode_tokens(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the token ids; null texts give null ids."""
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches):
        encoder = Encoder(Vocabulary(shared.value))
        for batch in sliced(batches, text):
            texts = batch.column(text).to_pylist()
            ids = [None if t is None else encoder.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.int32()))],
                names=[*batch.schema.names, into],
            )

    schema = T.StructType([*docs.schema, T.StructField(into, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def decode_tokens(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the readable text of their token ids."""
    shared = rows.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches):
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            texts = []
            for tokens in batch.column(ids).to_pylist():
                state = Decoder(vocabulary)
                parts = None if tokens is None else [*map(state.push, tokens), state.close()]
                texts.append(None if parts is None else "".join(parts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())],
                names=[*batch.schema.names, into],
            )

    schema = T.StructType([*rows.schema, T.StructField(into, T.StringType())])
    return rows.mapInArrow(run, schema)
