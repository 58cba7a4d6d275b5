"""Alignment of two tokenizers' tokens, from ends that both share.

Both tokenizers encode whole texts.  Wherever a token of either marks a space and both have a token
begin, their ends before it are shared; such anchors, verified on byte offsets, cut a document
into windows of token ids, mostly one word each.  Windows recur, so a worker remembers what it found for
a pair of id tuples: the groups between shared ends inside, and the linked pairs of ids.  Windows
of a batch are told apart by hashes and compared id by id before one result serves several.

A pair's count is the number of documents that hold it linked.  Workers hand on documents in chunks,
and each chunk's pairs are counted in it first; totals, and the highest total of each left id,
come from plain aggregations and travel back to the chunks that hold the pair.  So no table of
pairs is ever held whole by a task or sent to all of them.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quitanda.llm.bpe import byte_alphabet
from quitanda.llm.frames import Scratch, durable
from quitanda.llm.words import STEP, mix

#: Windows a worker remembers, and the longest window, in tokens of both sides, that it does.
KEPT_WINDOWS, KEPT_TOKENS = 60_000, 64
#: Texts aligned together: at most so many rows and characters.
ROWS_AT_ONCE, CHARS_AT_ONCE = 256, 1 << 20
#: Linked pairs, one for each document, beyond which a chunk ends.
CHUNK_PAIRS = 2_000_000
SHIFT = 16
LABELS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


class Coders:
    """The two tokenizers, with the bytes of their tokens and which of these mark a space."""

    def __init__(self, left: str, ranks: str, right: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(left, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {c: b for b, c in byte_alphabet().items()}
        special = {t["content"] for t in spec["added_tokens"]}
        names = spec["model"]["vocab"]
        table = {i: name.encode() if name in special else bytes(byte_of[c] for c in name) for name, i in names.items()}
        self.left_bytes = [table.get(i, b"") for i in range(max(table) + 1)]
        with open(ranks, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        merge = {base64.b64decode(token): int(rank) for token, rank in pairs}
        # The ranks are a faster reader of the same vocabulary; the library itself stands in where it gives up.
        self.fast = tiktoken.Encoding("left", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge, special_tokens={})
        self.library = Tokenizer.from_file(left)
        self.library.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_file=right)
        self.right_bytes = [self._piece(i) for i in range(self.right.get_piece_size())]
        sizes = lambda found: np.array([len(b) for b in found], np.int64)
        spaced = lambda found: np.array([b[:1] == b" " for b in found])
        self.sizes = sizes(self.left_bytes), sizes(self.right_bytes)
        self.spaced = spaced(self.left_bytes), spaced(self.right_bytes)

    def _piece(self, i: int) -> bytes:
        name = self.right.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.right.is_byte(i) else name.replace("▁", " ").encode()

    def left_ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as error:  # a pattern that gives up on a text is no ordinary Python error
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
            return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides for each text; none where a side does not give back space and text."""
        right = self.right.encode([t or "" for t in texts], num_threads=1)
        found = []
        for text, b in zip(texts, right, strict=True):
            if not text:
                found.append(([], []))
                continue
            whole = f" {text}"
            a, data = self.left_ids(whole), whole.encode()
            right_ok = b"".join(map(self.right_bytes.__getitem__, b)) == data
            found.append((a, b) if right_ok and b"".join(map(self.left_bytes.__getitem__, a)) == data else ([], []))
        return found


@lru_cache(maxsize=1)
def coders(left: str, ranks: str, right: str) -> Coders:
    """The tokenizers of these files, read once in each worker."""
    return Coders(left, ranks, right)


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def inside(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of these lengths."""
    return np.arange(counts.sum()) - np.repeat(starts_of(counts), counts)


@dataclass
class Found:
    """What the ids of windows say: texts of their groups, group and link counts, and linked pairs with occurrences."""

    texts: list[bytes]
    groups: np.ndarray
    links: np.ndarray
    sizes: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


class Aligner:
    """Aligns the ids of texts, with a memory of windows."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray], spaced: tuple[np.ndarray, np.ndarray]) -> None:
        self.sizes, self.spaced = sizes, spaced
        self.memory: dict[tuple[bytes, bytes], tuple] = {}
        #: Each side's ids in decimal, followed by what stands after an inner and after the last token of a group.
        self.names = [
            np.array([f"{i}{mark}".encode() for mark in marks for i in range(len(n))], object) for n, marks in zip(sizes, (",|", ",;"), strict=True)
        ]

    def anchors(self, ids: tuple[np.ndarray, np.ndarray], starts: tuple[np.ndarray, np.ndarray], total: int, firsts: np.ndarray) -> list[np.ndarray]:
        """For each side the tokens that begin a window: a text's first, and those where both sides begin and one marks a space."""
        begun = [np.zeros(total + 1, bool) for _ in ids]
        spaced = np.zeros(total + 1, bool)
        for mark, side, at, marks in zip(begun, ids, starts, self.spaced, strict=True):
            mark[at] = True
            spaced[at[marks[side]]] = True
        both = begun[0] & begun[1] & spaced
        both[firsts] = True
        return [np.flatnonzero(both[at]) for at in starts]

    def distinct(self, ids: tuple[np.ndarray, np.ndarray], begins: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """First window of every distinct pair of id tuples, and the number among these of every window."""
        key = counts[0].astype(np.uint64) * STEP + counts[1].astype(np.uint64)
        for salt, (side, b, n) in enumerate(zip(ids, begins, counts, strict=True)):
            value = mix(side.astype(np.uint64) + (inside(n).astype(np.uint64) * np.uint64(2) + np.uint64(salt)) * STEP)
            key = mix(key + np.add.reduceat(value, b))
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        same = first[number]
        fits = (counts[0] == counts[0][same]) & (counts[1] == counts[1][same])
        for side, b, n in zip(ids, begins, counts, strict=True):
            at = np.minimum(np.repeat(b[same], n) + inside(n), len(side) - 1)
            fits &= np.add.reduceat(side[at] != side, b) == 0
        odd = np.flatnonzero(~fits)  # equal hashes of different ids: each stands for itself
        number[odd] = len(first) + np.arange(len(odd))
        return np.append(first, odd), number

    def windows(self, ids: tuple[np.ndarray, np.ndarray], begins: list[np.ndarray]) -> tuple[Found, np.ndarray]:
        """What distinct windows say, remembered or new, and the number among them of every window."""
        counts = [np.diff(np.append(b, len(i))) for b, i in zip(begins, ids, strict=True)]
        first, number = self.distinct(ids, begins, counts)
        spans = [(b[first], (b + n)[first]) for b, n in zip(begins, counts, strict=True)]
        short = counts[0][first] + counts[1][first] <= KEPT_TOKENS
        (a0, a1), (b0, b1) = ((x.tolist(), y.tolist()) for x, y in spans)
        keys = [(ids[0][w:x].tobytes(), ids[1][y:z].tobytes()) if ok else None for w, x, y, z, ok in zip(a0, a1, b0, b1, short.tolist(), strict=True)]
        known = [self.memory.get(k) if k else None for k in keys]
        new = np.array([k is None for k in known])
        made = self.compute(*(np.concatenate([side[x:y] for x, y in zip(lo[new], hi[new], strict=True)] or [side[:0]]) for side, (lo, hi) in zip(ids, spans, strict=True)),
                            *((hi - lo)[new] for lo, hi in spans))
        ends = np.cumsum(made.sizes)
        fresh = [k for k, n in zip(keys, new.tolist(), strict=True) if n]
        for i, k in enumerate(fresh):
            if len(self.memory) >= KEPT_WINDOWS:
                break
            if k:
                own = slice(ends[i] - made.sizes[i], ends[i])
                self.memory[k] = made.texts[i], int(made.groups[i]), int(made.links[i]), made.pairs[own].copy(), made.times[own].copy()
        old = [k for k in known if k is not None]
        join = lambda x, parts: np.concatenate([x, *parts]) if parts else x
        column = lambda x, k: join(x, [np.array([o[k] for o in old], np.int64)] if old else [])
        sizes = join(made.sizes, [np.array([len(o[3]) for o in old], np.int64)] if old else [])
        whole = Found([*made.texts, *(o[0] for o in old)], column(made.groups, 1), column(made.links, 2), sizes, join(made.pairs, [o[3] for o in old]), join(made.times, [o[4] for o in old]))
        # New windows come first, then remembered ones.
        place = np.where(new, np.cumsum(new) - 1, new.sum() + np.cumsum(~new) - 1)
        return whole, place[number]

    def compute(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Found:
        """Aligns windows given one after another, with the tokens each has on both sides."""
        none = np.zeros(0, np.int64)
        if not len(n_a):
            return Found([], none, none, none, none, none)
        ends = [np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])]
        marks = [np.zeros(int(ends[0][-1]) + 1, bool) for _ in ends]
        for mark, end in zip(marks, ends, strict=True):
            mark[end] = True
        both = marks[0] & marks[1]
        last = [both[end] for end in ends]
        group = [np.cumsum(x) - x for x in last]
        n_groups = int(last[0].sum())
        size = [np.bincount(g, minlength=n_groups) for g in group]
        of_window = np.repeat(np.arange(len(n_a)), n_a)[last[0]]
        # Tokens of both sides in the order of the text: a group's left ones, then its right ones.
        ordered = np.empty(len(a) + len(b), object)
        ordered[np.arange(len(a)) + starts_of(size[1])[group[0]]] = self.names[0][a + last[0] * len(self.sizes[0])]
        ordered[np.arange(len(b)) + np.cumsum(size[0])[group[1]]] = self.names[1][b + last[1] * len(self.sizes[1])]
        pieces, bounds = ordered.tolist(), np.append(0, np.cumsum(n_a + n_b)).tolist()
        texts = [b"".join(pieces[x:y])[:-1] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        products = size[0] * size[1]
        links = np.bincount(of_window, products, minlength=len(n_a)).astype(np.int64)
        # Every pair of a group; in long groups, ids that recur are taken once, with their number.
        plain = products <= KEPT_TOKENS * KEPT_TOKENS
        small = np.where(plain, products, 0)
        g = np.repeat(np.arange(n_groups), small)
        k = inside(small)
        first = [starts_of(n) for n in size]
        pairs = a[first[0][g] + k // size[1][g]].astype(np.int64) << SHIFT | b[first[1][g] + k % size[1][g]]
        times, window = np.ones(len(pairs), np.int64), of_window[g]
        for i in np.flatnonzero(~plain).tolist():
            (x, nx), (y, ny) = (np.unique(side[f[i] : f[i] + n[i]], return_counts=True) for side, f, n in zip((a, b), first, size, strict=True))
            pairs = np.append(pairs, (x.astype(np.int64)[:, None] << SHIFT | y).ravel())
            times = np.append(times, np.outer(nx, ny).ravel())
            window = np.append(window, np.full(len(x) * len(y), of_window[i]))
        order = np.argsort(window, kind="stable") if not plain.all() else slice(None)
        counts = np.bincount(window, minlength=len(n_a))
        return Found(texts, np.bincount(of_window, minlength=len(n_a)), links, counts, pairs[order], times[order])

    def align(self, encoded: list[tuple[list[int], list[int]]]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, pairs, times) of each text; `groups` in bytes, `pairs` in order."""
        results: list[tuple] = [(0, 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(encoded)
        some = [i for i, (a, _) in enumerate(encoded) if a]
        if not some:
            return results
        ids = tuple(np.fromiter(chain.from_iterable(encoded[i][side] for i in some), np.int32) for side in (0, 1))
        lengths = [s[i] for s, i in zip(self.sizes, ids, strict=True)]
        starts = tuple(starts_of(n) for n in lengths)
        tokens = [np.cumsum([0, *(len(encoded[i][side]) for i in some)]) for side in (0, 1)]
        begins = self.anchors(ids, starts, int(lengths[0].sum()), starts[0][tokens[0][:-1]])
        found, number = self.windows(ids, begins)
        bounds = np.append(np.searchsorted(begins[0], tokens[0][:-1]), len(begins[0]))
        groups, links = (np.add.reduceat(x[number], bounds[:-1]) for x in (found.groups, found.links))
        # Distinct windows of every text, then the pairs of these.
        total = len(found.texts)
        owner = np.repeat(np.arange(len(some)), np.diff(bounds))
        seen, often = np.unique(owner * total + number, return_counts=True)
        kind, sizes = seen % total, found.sizes[seen % total]
        at = np.repeat(starts_of(found.sizes)[kind], sizes) + inside(sizes)
        keys, place = np.unique(np.repeat(seen // total, sizes) << 33 | found.pairs[at], return_inverse=True)
        # Sums of whole numbers below 2**53, so exact as floats too.
        occurs = np.bincount(place, found.times[at] * np.repeat(often, sizes), minlength=len(keys)).astype(np.int64)
        cuts = np.searchsorted(keys, np.arange(len(some) + 1) << 33)
        listed = number.tolist()
        for k, i in enumerate(some):
            text = b";".join(map(found.texts.__getitem__, listed[bounds[k] : bounds[k + 1]]))
            own = slice(cuts[k], cuts[k + 1])
            results[i] = (len(encoded[i][0]), len(encoded[i][1]), int(groups[k]), int(links[k]), text, keys[own] & ((1 << 33) - 1), occurs[own])
        return results


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of few rows and characters at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            value = text.as_py()
            if ids and (len(ids) >= ROWS_AT_ONCE or size + len(value or "") > CHARS_AT_ONCE):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(value)
            size += len(value or "")
        if ids:
            yield ids, texts


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes of like rank side by side, which compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def aligned(docs: DataFrame, left: str, ranks: str, right: str) -> DataFrame:
    """(chunk, *LABELS, pairs, times) of rows (doc_id, text): pairs are packed differences of the ids x << 16 | y in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coders(left, ranks, right)
        aligner = Aligner(both.sizes, both.spaced)
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for ids, texts in _slices(batches):
            found = aligner.align(both.encode(texts))
            held += sum(len(r[5]) for r in found)
            columns = [
                pa.array([chunk] * len(ids), pa.int64()),
                pa.array(ids, pa.int64()),
                *(pa.array([r[k] for r in found], pa.int64()) for k in range(4)),
                pa.array([hashlib.sha256(r[4]).hexdigest() if r[0] else "" for r in found]),
                pa.array([_packed(np.diff(r[5], prepend=0)) for r in found], pa.binary()),
                pa.array([_packed(r[6]) for r in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", *LABELS, "pairs", "times"])
            if held > CHUNK_PAIRS:
                chunk, held = chunk + 1, 0

    kinds = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return docs.mapInArrow(run, kinds)


def chunk_pairs(rows: DataFrame) -> DataFrame:
    """(chunk, pair, n): documents of each chunk that hold a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for chunk, parts in held.items():
                pairs, n = np.unique(np.concatenate(parts), return_counts=True)
                columns = [np.full(len(pairs), chunk), pairs, n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["chunk", "pair", "n"])
            held.clear()

        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.cumsum(_unpacked(data))
                held.setdefault(chunk, []).append(part)
                size += len(part)
            if size > 2 * CHUNK_PAIRS:
                yield from flush()
                size = 0
        yield from flush()

    return rows.select("chunk", "pairs").mapInArrow(run, "chunk long, pair long, n long")


def weighed(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """The documents of one chunk with `n_best` and `count_sum`, from the totals of its pairs."""
    pairs = pairs.drop_duplicates("pair").sort_values("pair")
    known, total, best = pairs["pair"].to_numpy(), pairs["total"].to_numpy(), pairs["best"].to_numpy()
    sums, hits = [], []
    for data, times in zip(rows["pairs"], rows["times"], strict=True):
        at, weight = np.searchsorted(known, np.cumsum(_unpacked(data))), _unpacked(times)
        sums.append(int((total[at] * weight).sum()))
        hits.append(int(weight[best[at]].sum()))
    return rows[LABELS].assign(n_best=hits, count_sum=sums)


def align_tokenizers(docs: DataFrame, left: str, ranks: str, right: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row.

    `left` is a byte-level tokenizers file and `ranks` the same vocabulary as ranks, `right` a sentencepiece
    model; all must be readable on every executor.  A null or empty text, or one that a side does not
    give back, has no tokens: zeros, and an empty digest.  Every row counts as a document,
    repeated ones as often as they stand; null ids stay; other columns are left out; an empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = scratch.save(aligned(docs, left, ranks, right))
    counts = chunk_pairs(rows)
    totals = counts.groupBy("pair").agg(F.sum("n").alias("total"))
    totals = scratch.save(totals.withColumn("left", F.shiftright("pair", SHIFT)))
    best = totals.groupBy("left").agg(F.max("total").alias("most"))
    totals = totals.join(best, "left").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = counts.select("chunk", "pair").join(totals, "pair").select("chunk", "pair", "total", "best")
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    whole = rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(weighed, kinds)
    whole = durable(whole)
    scratch.clear()
    return whole


def op11_token_alignment(spark, folder: str) -> DataFrame:
    """Alignment of a byte-level and a piece vocabulary over every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    return align_tokenizers(docs, *files)
