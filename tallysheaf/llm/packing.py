"""Best-fit packing of token sequences under several capacities at once.

Documents become token ids with an end id; what is longer than a sequence is cut. Pieces go, by the hash of a
row number, to shards of about SHARD pieces, and each shard packs by vector best fit: pieces by falling length,
each into the bin that fits best among those with room in every dimension (tokens, documents, attention cost).
The score is the weighted norm of what the bin would have left, or the weighted dot product of need and room.
A shard leaves at most a few bins part-filled, so the number of sequences hardly depends on the shards.

Cases: null and empty texts give one piece that holds the end id; texts of any length are cut, never dropped;
a piece that breaks a capacity on its own gets a bin of its own; rows that repeat are packed each; an empty
table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SPACE
from .common import byte_chunks, claim, distinct, mix, own_columns, powers, ship, stage, table, text_buffers, _BASE, _INV, _TABLE

CAPACITY = 4096
#: Of tokens, documents and attention cost in the score. Where the last two capacities are loose they cannot open a
#: bin; they then choose among bins that are about as full.
WEIGHTS = (1.0, 1.0, 1.0)
#: Pieces that are packed together.
SHARD = 16_384
#: Words that a worker remembers, and those of them that it keeps when there are more: the ones used most.
REMEMBERED, KEPT = 250_000, 80_000
#: Text bytes whose words are looked up together.
STEP_BYTES = 3 << 18
#: Fixed value: the published splitting pattern of this vocabulary.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Texts with these go through the tokenizer whole: final sigma lower-cases by context, controls, added tokens.
ODD = regex.compile("[Σ\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f�]|<\\|")
#: Kinds of bytes: 0 white space, 1 letter (with the two bytes of a Latin-1 letter), 2 digit, 3 other marks.
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = 1
_KIND[48:58] = 2
#: Bytes that send a text to the pattern: controls, the apostrophe, all that is not ASCII but Latin-1 letters.
_HARD = np.ones(256, bool)
_HARD[[*range(9, 14), *range(32, 127), 0xC3]] = False
_HARD[0x27] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def split_plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which texts are plain, the byte ranges of the pattern's words in those, and the bytes in lower case."""
    n = len(data)
    kind, hard, lower = _KIND[data], _HARD[data], _LOW[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1 if n else np.zeros(0, np.int64)
    second = data[after]
    letter = (second != 0x97) & (second != 0xB7)
    kind[after], hard[after] = 1, ~letter
    lower[after[letter & (second <= 0x9E)]] += 32
    hard[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    plain = np.diff(np.concatenate(([0], np.cumsum(hard)))[offsets]) == 0
    begin = kind == 2
    begin[1:] |= kind[1:] != kind[:-1]
    begin[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n)[: len(start)]
    word = kind[start] != 0
    return plain, start[word], end[word], lower


class Numbers(dict):
    """Numbers words as they come; new holds those since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordTokens:
    """Ids of texts by the tokenizers library, which is asked once for each distinct word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = regex.compile(SPLIT)
        self.forget()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """One call for many words: the last token of each word has the word-end mark."""
        flat = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = (np.flatnonzero(self.ends[flat]) + 1).tolist()
        if len(ends) != len(words):  # a word without an end mark: ask word by word
            return [self.whole(w) for w in words]
        raw = flat.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def encode_buffers(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each text of a UTF-8 buffer."""
        if len(self.known) > REMEMBERED:
            self.forget_rare()
        n, whole = len(offsets) - 1, data.tobytes()
        plain, start, end, lower = split_plain(data, offsets)
        owner = np.repeat(np.arange(n), np.diff(np.searchsorted(start, offsets)))
        keep = plain[owner]
        start, end, owner = start[keep], end[keep], owner[keep]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[lower] * powers(_BASE, len(lower)))))
        word = (sums[end] - sums[start]) * powers(_INV, len(lower) + 1)[start]
        first, number = distinct(mix(word + (end - start).astype(np.uint64)))
        low = lower.tobytes()
        texts = [low[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist())]
        number = np.array(list(map(self.known.__getitem__, texts)), np.int64)[number] if texts else number
        # Texts with anything but Latin letters, digits and simple marks go through the pattern as strings.
        numbers, others, found = [number], [owner], {}
        for i in np.flatnonzero(~plain).tolist():
            text = whole[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
            words = None if ODD.search(text) else self.split.findall(unicodedata.normalize("NFC", text).lower())
            if words is None:
                found[i] = self.whole(text)
            else:
                numbers.append(np.array(list(map(self.known.__getitem__, words)), np.int64))
                others.append(np.full(len(words), i))
        if len(numbers) > 1:
            owner = np.concatenate(others)
            order = np.argsort(owner, kind="stable")
            owner, number = owner[order], np.concatenate(numbers)[order]
        if self.known.new:
            new, self.known.new = self.known.new, []
            for i in range(0, len(new), 4096):
                self.remember(self.ids_of_words(new[i : i + 4096]))
        self.uses[: self.words_stored] += np.bincount(number, minlength=self.words_stored)
        size = self.size[number]
        ends = np.cumsum(size)
        at = np.repeat(self.first[number] - (ends - size), size) + np.arange(int(size.sum()))
        raw = self.store[at].tobytes()
        bounds = np.concatenate(([0], ends))[np.searchsorted(owner, np.arange(n + 1))].tolist()
        return [found[i] if i in found else raw[4 * a : 4 * b] for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return self.encode_buffers(*text_buffers(pa.array(texts, pa.string())))

    def forget(self) -> None:
        self.known, self.words_stored, self.stored = Numbers(), 0, 0
        self.store, self.first, self.size, self.uses = np.zeros(1 << 19, "<u4"), *(np.zeros(1 << 17, np.int64) for _ in range(3))

    def forget_rare(self) -> None:
        """Keep the KEPT words that were used most."""
        n = self.words_stored
        keep = np.sort(np.argpartition(-self.uses[:n], min(KEPT, n - 1))[:KEPT])
        words = [w for w, k in zip(self.known, np.isin(np.arange(n), keep).tolist()) if k]  # in the order of their numbers
        ids = [self.store[a : a + k].tobytes() for a, k in zip(self.first[keep].tolist(), self.size[keep].tolist())]
        uses = self.uses[keep]
        self.forget()
        for w in words:
            self.known[w]  # numbers it
        self.known.new.clear()
        self.remember(ids)
        self.uses[: len(uses)] = uses >> 1  # so that what is not used any more goes in time

    def remember(self, ids: list[bytes]) -> None:
        flat, size = np.frombuffer(b"".join(ids), "<u4"), np.array(list(map(len, ids)), np.int64) >> 2
        while self.stored + len(flat) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        while self.words_stored + len(ids) > len(self.size):
            self.first, self.size, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.size, self.uses))
        here = slice(self.words_stored, self.words_stored + len(ids))
        self.size[here], self.first[here] = size, self.stored + np.cumsum(size) - size
        self.store[self.stored : self.stored + len(flat)] = flat
        self.stored, self.words_stored = self.stored + len(flat), here.stop


_loaded: dict[str, WordTokens] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text."""
    ship(docs.sparkSession)
    path = path or default_path()
    rows = own_columns(docs, id=id_col, text=text_col)
    schema = f"doc_id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        claim("packing", _loaded.clear)
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _loaded:
            _loaded[path] = WordTokens(path)
        end, step = int(end_id).to_bytes(4, "little"), 4 * capacity
        for some, raw, offsets in byte_chunks(batches, most=STEP_BYTES):
            at, number, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(_loaded[path].encode_buffers(raw, offsets)):
                ids += end
                for n, s in enumerate(range(0, len(ids), step)):
                    part = ids[s : s + step]
                    at.append(i), number.append(n), start.append(s // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            columns = [some.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def fit(lengths: np.ndarray, capacity: int, most_docs: int, most_cost: float, weights=WEIGHTS, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; lengths must fall."""
    n = len(lengths)
    caps = np.array([capacity, most_docs, most_cost], float)
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], 1) / caps
    weight = np.array(weights, float)
    least = need.min(0) if n else np.zeros(3)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    room, name, filled = np.empty((3, n)), np.empty(n, np.int64), np.empty(n, np.int64)
    opened = live = 0
    for i in range(n):
        a = need[i]
        r = room[:, :live]
        fits = (r[0] >= a[0] - 1e-12) & (r[1] >= a[1] - 1e-12) & (r[2] >= a[2] - 1e-12)
        which = np.flatnonzero(fits)
        if len(which):
            some = r[:, which]
            value = weight @ (some - a[:, None]) ** 2 if score == "norm" else -((weight * a) @ some)
            at = which[np.argmin(value)]
        else:
            at = live
            room[:, at], name[at], filled[at] = 1.0, opened, 0
            opened, live = opened + 1, live + 1
        bins[i], offsets[i] = name[at], filled[at]
        filled[at] += lengths[i]
        room[:, at] -= a
        if (room[:, at] < least - 1e-12).any():  # nothing fits any more: the last bin takes its place
            live -= 1
            room[:, at], name[at], filled[at] = room[:, live], name[live], filled[live]
    return bins, offsets


def pack(found: DataFrame, capacity: int = CAPACITY, most_docs: int | None = None, most_cost: float | None = None, weights=WEIGHTS, score: str = "norm") -> DataFrame:
    """Add sequence_id and offset to pieces. most_docs and most_cost (the sum of squared lengths) default to
    values that a full sequence cannot exceed."""
    ship(found.sparkSession)
    found = stage(found.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-found.count() // SHARD))
    most_docs, most_cost = most_docs or capacity, most_cost or float(capacity) ** 2
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "_row") + ", sequence_id long, offset long"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        bins, offsets = fit(pdf["length"].to_numpy(), capacity, most_docs, most_cost, weights, score)
        return pdf.assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets).drop(columns=["_row", "_shard"])

    shard = F.pmod(F.xxhash64("_row"), F.lit(shards))
    return found.withColumn("_shard", shard).groupBy("_shard").applyInPandas(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
