"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The new words of a batch lie in one flat symbol array. A round finds the rank of every neighbouring pair by
binary search over the sorted pair keys, takes the lowest rank of each word and merges it everywhere in the
word, left to right; words without a known pair leave the array. A word of over LONG symbols, for which rounds
over the whole word would cost its square, is merged by a heap of ranks with the same result.

Cases: null and empty texts give no ids; texts are read whole whatever their length; the added tokens of the
vocabulary are found in a text as the tokenizers library finds them; every row gives one row, so repeated rows
repeat; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, claim, own_columns, ship, table, text_buffers

#: White space as Unicode has it; Python's own \s also takes the separators U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the published splitting pattern of this vocabulary.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Symbols in a word from which the heap takes over.
LONG = 1024
#: Words that a worker remembers; all are forgotten when there are more.
REMEMBERED = 300_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class ByteBPE:
    """One vocabulary file, with encode_batch(texts) and decode(ids)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], np.arange(len(pairs))[order], into
        self.never = len(pairs)
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.digits = [str(i) for i in range(self.size)]
        self.known: dict[str, tuple] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.never)

    def pair_ranks(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The rank of each symbol with the next of its word."""
        ranks = np.full(len(symbols), self.never, np.int64)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[np.cumsum(sizes) - 1] = self.never
        return ranks

    def merge_words(self, words: list[bytes]) -> list[tuple]:
        """The ids of each word."""
        out: list = [()] * len(words)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = tuple(self.merge_long(w))
        live = np.array([i for i, w in enumerate(words) if 0 < len(w) <= LONG], np.int64)
        if not len(live):
            return out
        flat = np.frombuffer(b"".join(words[i] for i in live), np.uint8)
        symbols, sizes = self.first[flat], np.array([len(words[i]) for i in live], np.int64)
        ranks = self.pair_ranks(symbols, sizes)
        while len(live):
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == self.never
            if done.any():
                for i, s, n in zip(live[done].tolist(), starts[done].tolist(), sizes[done].tolist()):
                    out[i] = tuple(symbols[s : s + n].tolist())
                keep = np.repeat(~done, sizes)
                live, sizes, symbols, ranks, lowest = live[~done], sizes[~done], symbols[keep], ranks[keep], lowest[~done]
                if not len(live):
                    break
            at = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            # In a run of overlapping pairs (as in "aaa") every second one merges, from the left.
            fresh = np.ones(len(at), bool)
            fresh[1:] = np.diff(at) > 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            word = np.repeat(np.arange(len(live)), sizes)[at]
            symbols[at] = self.into[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            # A merged pair whose second symbol ended its word ends it now: only then its rank stays "never".
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(sizes) - 1] = True
            last[at] |= last[at + 1]
            symbols, ranks, last = symbols[keep], ranks[keep], last[keep]
            sizes = sizes - np.bincount(word, minlength=len(live))
            now = at - np.arange(len(at))  # places of the merged symbols after the others went
            stale = np.concatenate((now, now[now > 0] - 1))
            inner = stale[~last[stale]]
            ranks[stale] = self.never
            ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        return out

    def merge_long(self, word: bytes) -> list[int]:
        symbols = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbols)
        after, before, rank = [*range(1, n), -1], [-1, *range(n - 1)], dict(zip(self.keys.tolist(), self.ranks.tolist()))
        heap = [(r, i) for i, r in enumerate(self.rank(np.array(symbols[:-1]), np.array(symbols[1:])).tolist()) if r < self.never]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j < 0 or rank.get(symbols[i] * self.size + symbols[j]) != r:
                continue
            symbols[i], symbols[j], after[i] = int(self.into[r]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (found := rank.get(symbols[a] * self.size + symbols[after[a]])) is not None:
                    heapq.heappush(heap, (found, a))
        return [s for s in symbols if s >= 0]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        parts: list[list] = []
        for text in texts:
            if self.cut is None or "<" not in text:
                parts.append(self.split.findall(text))
            else:  # every second piece is an added token
                parts.append([(self.added[p],) if i % 2 else w for i, p in enumerate(self.cut.split(text)) for w in ([p] if i % 2 else self.split.findall(p))])
        new = set(chain.from_iterable(parts)) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set(chain.from_iterable(parts))
        fixed = {w for w in new if isinstance(w, tuple)}
        words = list(new - fixed)
        self.known.update(zip(words, self.merge_words([w.encode() for w in words])))
        self.known.update((w, w) for w in fixed)
        return [list(chain.from_iterable(map(self.known.__getitem__, p))) for p in parts]

    def decode(self, ids) -> bytes:
        """UTF-8 of the text; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").encode()


_loaded: dict[str, ByteBPE] = {}


def vocabulary(path: str) -> ByteBPE:
    """A vocabulary, read once in a worker."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def text_chunks(batches, text: int = 1):
    """(rows of the batch, their texts as str) for about a megabyte of text at a time."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column(text))
        whole = raw.tobytes() if len(offsets) > 1 else b""
        for i, j in chunks(offsets):
            at = offsets[i : j + 1].tolist()
            yield batch.slice(i, j - i), [whole[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    ship(docs.sparkSession)
    path = path or default_path()

    def run(batches):
        claim("bpe", _loaded.clear)
        bpe = vocabulary(path)
        for rows, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(bpe.encode_batch(texts), pa.list_(pa.int32()))], ["id", "ids"])

    rows = own_columns(docs, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, text) from (id, ids); null ids give an empty text."""
    ship(encoded.sparkSession)
    path = path or default_path()

    def run(batches):
        claim("bpe", _loaded.clear)
        bpe = vocabulary(path)
        for b in batches:
            texts = [bpe.decode(x or ()).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = own_columns(encoded, id="id", ids="ids")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id, n_tokens, and the digests of the ids and of the decoded text."""
    ship(docs.sparkSession)
    path = path or default_path()

    def run(batches):
        claim("bpe", _loaded.clear)
        bpe = vocabulary(path)
        for rows, texts in text_chunks(batches):
            ids = bpe.encode_batch(texts)
            hashes = [hashlib.sha256(",".join(map(bpe.digits.__getitem__, x)).encode()).hexdigest() for x in ids]
            texts_back = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
            columns = [rows.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array(hashes, pa.string()), pa.array(texts_back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = own_columns(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
