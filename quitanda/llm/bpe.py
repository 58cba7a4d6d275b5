"""BPE encoding with forced boundaries, and decoding.

Two bytes side by side that occur inside no token of the vocabulary can never be
merged, so every such pair marks a certain cut: a word falls into fragments that are
encoded on their own and concatenated.  Fragments are short and recur, so most come
from a bounded memory of earlier results.  Only the last fragment of a word carries
the vocabulary's end-of-word suffix.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from quitanda.llm.frames import given_back

#: Bytes that a worker's memory of chunks may take, and those of an entry beside its chunk and ids.
CACHED_BYTES, ENTRY_BYTES = 64 << 20, 180
#: Fragments of these lengths are merged side by side, longer ones one by one.
WIDTHS = (0, 6, 12, 24)
NONE = 1 << 40
ROWS_AT_ONCE = 256
#: Texts of these characters alone are stable under NFC and need no library call.
_OTHER = re.compile("[^\x00-\x1b\x20-\u02ff]")


def byte_alphabet() -> dict[int, str]:
    """Printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ForcedBPE:
    """Encoder and decoder of a tokenizers file: byte-level BPE, with or without end-of-word suffix."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.names = {i: t for t, i in (ids | self.special).items()}
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in alphabet.items()}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        #: Ids of single bytes inside a word and at its end.
        self.single = np.array([[ids[alphabet[b] + end] for b in range(256)] for end in ("", suffix)], np.int64)
        #: Whether two bytes stand side by side inside some token.
        self.inner = np.zeros((256, 256), bool)
        for token in ids:
            inside = [self.byte_of[c] for c in (token.removesuffix(suffix) if suffix else token)]
            self.inner[inside[:-1], inside[1:]] = True
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(ids[x], ids[y]): rank for rank, (x, y) in enumerate(pairs)}
        self.made = np.array([ids[x + y] for x, y in pairs], np.int64)
        keys = np.array([(ids[x] << 32) | ids[y] for x, y in pairs], np.int64)
        self.rank_of_key = np.argsort(keys)
        self.keys = keys[self.rank_of_key]
        self.memory: dict[str, bytes] = {}
        self.held = 0

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where nothing merges them."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], NONE)

    def merge_short(self, symbols: np.ndarray) -> np.ndarray:
        """Merge rows of ids (-1 behind their ends) side by side: in each row the lowest rank, then the leftmost."""
        ranks = np.full(symbols.shape, NONE, np.int64)
        both = symbols[:, 1:] >= 0
        ranks[:, :-1][both] = self.pair_ranks(symbols[:, :-1][both], symbols[:, 1:][both])
        places, live = np.arange(symbols.shape[1]), np.arange(len(symbols))
        while len(live):
            at = ranks[live].argmin(axis=1)
            best = ranks[live, at]
            live, at, best = live[best < NONE], at[best < NONE], best[best < NONE]
            if not len(live):
                break
            source = np.minimum(places + (places > at[:, None]), symbols.shape[1] - 1)
            rows = np.take_along_axis(symbols[live], source, 1)
            rows[:, -1] = -1
            rows[np.arange(len(live)), at] = self.made[best]
            symbols[live] = rows
            new = np.take_along_axis(ranks[live], source, 1)
            new[:, -1] = NONE
            for first in (at - 1, at):
                ok = (first >= 0) & (first + 1 < symbols.shape[1])
                row, col = np.flatnonzero(ok), first[ok]
                second = rows[row, col + 1]
                new[row, col] = np.where(second >= 0, self.pair_ranks(rows[row, col], np.maximum(second, 0)), NONE)
            ranks[live] = new
        return symbols

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one fragment, with a heap, so that time follows its length."""
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(pairwise(symbols)) if p in ranks]
        heapq.heapify(heap)
        parts: list[int | None] = list(symbols)
        while heap:
            rank, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.made[rank]), None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (pair := (parts[left], parts[right])) in ranks:
                    heapq.heappush(heap, (ranks[pair], left, pair))
        return [p for p in parts if p is not None]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has.

        All words are cut at forced boundaries, and fragments of like length merge together.
        """
        raw = np.frombuffer(b"".join(words), np.uint8)
        last = np.zeros(len(raw), bool)
        word_ends = np.cumsum([*map(len, words)])
        last[word_ends - 1] = True
        cut = last.copy()
        cut[:-1] |= ~self.inner[raw[:-1], raw[1:]]
        ends = np.flatnonzero(cut) + 1
        starts = np.append(0, ends[:-1])
        symbols = self.single[last.astype(int), raw]
        lengths = ends - starts
        # A fragment never has more ids than bytes: ids are first put where its bytes were.
        placed = np.full(len(raw), -1, np.int64)
        for low, high in pairwise(WIDTHS):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for some in np.array_split(rows, len(rows) // 10_000 + 1):
                if len(some):
                    place = np.arange(high)
                    inside = place < lengths[some, None]
                    at = np.minimum(starts[some, None] + place, len(raw) - 1)
                    block = self.merge_short(np.where(inside, symbols[at], -1))
                    placed[at[inside]] = block[inside]
        for i in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            ids = self.merge_long(symbols[starts[i] : ends[i]].tolist())
            placed[starts[i] : starts[i] + len(ids)] = ids
        counts = np.append(0, np.cumsum(placed >= 0))[np.append(0, word_ends)]
        return placed[placed >= 0].astype("<u4"), np.diff(counts)

    def encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of normalised texts without white space."""
        found = [[c] if c.isalpha() else self.pattern.findall(c) for c in chunks]
        words = [w.encode() for ws in found for w in ws]
        if not words:
            return dict.fromkeys(chunks, b"")
        ids, counts = self.encode_words(words)
        bounds = 4 * np.append(0, np.cumsum(counts))[np.append(0, np.cumsum([*map(len, found)]))]
        data, ends = ids.tobytes(), bounds.tolist()
        return {c: data[a:b] for c, a, b in zip(chunks, ends[:-1], ends[1:], strict=True)}

    def library_words(self, text: str) -> list[bytes]:
        """Words of a text whose normalisation is left to the library."""
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, shown)) for shown, _ in split]

    def parts_of(self, text: str, special: bool) -> list[int | str]:
        """A text as special tokens' ids and the texts between them."""
        if not special or "<|" not in text:
            return [text]
        return [self.special.get(part, part) for part in self.specials.split(text) if part]

    def encode_batch(self, texts: list[str | None], special: bool = True) -> list[bytes]:
        """Ids of texts, as 32-bit numbers; null counts as empty.  With `special`, special tokens in a text are found.

        Texts of characters that are stable under NFC only need lower case, and since
        no word crosses white space, their chunks between it are looked up or encoded together.
        """
        parts = [self.parts_of(text, special) if text else [] for text in texts]
        chunks = [[p.lower().split() if isinstance(p, str) and not _OTHER.search(p) else p for p in ps] for ps in parts]
        memory = self.memory
        new = {c for ps in chunks for p in ps if isinstance(p, list) for c in p if c not in memory}
        found = self.encode_chunks(list(new)) if new else {}
        get = memory.__getitem__
        if found and self.held < CACHED_BYTES:
            memory.update(found)
            self.held += sum(len(c) + len(i) for c, i in found.items()) + ENTRY_BYTES * len(found)
        elif found:
            get = lambda c: found[c] if c in found else memory[c]
        out = []
        for ps in chunks:
            ids: list[bytes] = []
            for p in ps:
                if isinstance(p, list):
                    ids.extend(map(get, p))
                elif isinstance(p, int):
                    ids.append(p.to_bytes(4, "little"))
                elif words := self.library_words(p):
                    ids.append(self.encode_words(words)[0].tobytes())
            out.append(b"".join(ids))
        return out

    def encode(self, text: str | None, special: bool = True) -> list[int]:
        return np.frombuffer(self.encode_batch([text], special)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """As the library does without a decoder: the tokens' names joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBPE:
    """The encoder of a file, read once in each worker."""
    return ForcedBPE(path)


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that results leave a worker as they are made."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def encoded_slices(
    batches: Iterator[pa.RecordBatch], path: str, special: bool = True
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches (doc_id, text) with the ids of their texts."""
    bpe = encoder(path)
    gc.disable()  # the memory makes no cycles, and looking for them costs a quarter of the time
    try:
        for batch in in_slices(batches):
            yield batch, bpe.encode_batch(batch.column(1).to_pylist(), special)
    finally:
        gc.enable()


def id_lists(ids: list[bytes]) -> pa.Array:
    """An Arrow list of 32-bit numbers for each text."""
    ends = np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def encode_texts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", special: bool = True) -> DataFrame:
    """`doc_id` and `ids` of every row; other columns are left out.

    A null or empty text has no ids, repeated rows and null ids stay, an empty table
    gives no rows.  `path` must name the tokenizer file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded_slices(batches, path, special):
            yield pa.RecordBatch.from_arrays([batch.column(0), id_lists(ids)], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(given_back(run), "doc_id long, ids array<int>")


def _decoded(lists: pa.Array, bpe: ForcedBPE) -> pa.Array:
    flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()]).tolist()
    return pa.array([bpe.decode(flat[a:b]) for a, b in pairwise(ends)], pa.string())


def encode_and_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `ids` and `decoded` of every row, as ``encode_texts`` and ``decode_ids`` give them, in one task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded_slices(batches, path):
            lists = id_lists(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, _decoded(lists, encoder(path))], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(given_back(run), "doc_id long, ids array<int>, decoded string")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `ids` and `decoded` of rows (doc_id, ids); null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch.column(1), bpe)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def default_tokenizer() -> str:
    """Path of the vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe_encode(spark, folder: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    path = default_tokenizer()
    return encode_and_decode(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
