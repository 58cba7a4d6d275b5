"""Spelling variants by composing a vocabulary acceptor with a one-edit transducer and itself.

Two words one edit apart share either the first half of the shorter one or its other half, so
every word is entered under both halves, for its own length and for the length below.  Words of
one such half are the paths from one initial state: the rest of each word, read away from the
shared half.  The rests of a partition are minimised into one acceptor, in which initial states
share all their right languages.  Composed with the transducer, a path runs on the
diagonal (both words in the same state) until its one edit, then both words need a common right
language; that is computed once for each pair of states.  An insertion is only taken where the
words first differ, so each pair is accepted on one path only.

An initial state with many words is split in two again by the halves of what is left, as often as
needed, so no task holds more than a bounded number of words at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quitanda.llm.frames import Scratch, durable, size_checked

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many occurrences of a word in a document loses a code point.
SLIPS = 31
MIN_LENGTH = 7
MIN_COUNT = 2
#: A form is at least this many times as frequent as its variant.
RATIO = 10
#: Words of one initial state beyond which it is split.
STATE_WORDS = 20_000
#: States that a task keeps for the initial states that follow.
KEPT_STATES = 200_000

_STEP = re.compile(r"([PS])(\d+),(\d+)")


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of enough code points and occurrences, with the planted slips of each document."""
    lower = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= MIN_LENGTH)
    draw, length = F.crc32(F.concat("_id", F.lit(":"), "run").cast("binary")), F.length("run")
    runs = runs.select("run", length.alias("length"), draw.alias("draw"))
    at = (F.col("draw") % F.col("length")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("length")))
    words = runs.select(F.when(F.col("draw") % SLIPS == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= MIN_COUNT)


def _halves(base: Column, rest: Column) -> Column:
    """The two entries of a rest whose shorter partner has `base` code points: which half is shared, and what is left."""
    head = F.floor(base / 2).cast("int")
    tail, length = (base - head).cast("int"), F.length(rest)
    step = lambda kind: F.concat(F.lit(kind), head.cast("string"), F.lit(","), tail.cast("string"))
    front = F.struct(step("P").alias("step"), F.substring(rest, F.lit(1), head).alias("half"), F.substring(rest, head + 1, length).alias("rest"), tail.alias("base"))
    back = F.struct(
        step("S").alias("step"),
        F.substring(rest, length - tail + 1, length).alias("half"),
        F.reverse(F.substring(rest, F.lit(1), length - tail)).alias("rest"),
        head.alias("base"),
    )
    return F.explode(F.array(front, back))


def initial_states(words: DataFrame, scratch: Scratch, state_words: int = STATE_WORDS) -> DataFrame:
    """(key, path, word, n, rest, base): every word under the halves it may share with a word one edit apart."""
    length = F.length("word")
    own = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("c")).filter(F.col("c") >= MIN_LENGTH)
    rows = own.select("word", "n", _halves(F.col("c"), F.col("word")).alias("e"))
    entry = lambda path, key: (
        F.concat(key, F.lit("|"), F.col("e.step"), F.lit("|"), F.col("e.half")).alias("key"),
        F.concat(path, F.col("e.step")).alias("path"),
        "word", "n", F.col("e.rest").alias("rest"), F.col("e.base").alias("base"),
    )
    rows = scratch.save(rows.select(*entry(F.lit(""), F.lit(""))))
    done = None
    while True:
        # A state whose shorter rests have one code point holds no more words than pairs of letters.
        large = durable(rows.filter("base > 1").groupBy("key").count().filter(F.col("count") > state_words).select("key"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(size_checked(large), "key", "left_anti")
        done = scratch.save(small if done is None else done.unionByName(small))
        rows = rows.join(size_checked(large), "key", "left_semi").select("key", "path", "word", "n", _halves(F.col("base"), F.col("rest")).alias("e"))
        rows = scratch.save(rows.select(*entry(F.col("path"), F.col("key"))))


class Acceptor:
    """Minimal acceptors of sorted sets of strings, one for each initial state, that share their states."""

    def __init__(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple[bool, tuple[tuple[str, int], ...]]] = []
        self.arcs: list[dict[str, int]] = []
        self.shared: dict[tuple[int, int], tuple[str, ...]] = {}
        self.edits: dict[int, list[tuple[str, str]]] = {}

    def state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        """The state with these right languages."""
        found = (final, tuple(arcs))
        if found not in self.ids:
            self.ids[found] = len(self.states)
            self.states.append(found)
            self.arcs.append(dict(arcs))
        return self.ids[found]

    def add(self, strings: list[str]) -> int:
        """Initial state of distinct strings in order, minimised as they come."""
        open_: list[list] = [[False, [], ""]]  # final, arcs, symbol that leads here
        before = ""

        def close(depth: int) -> None:
            while len(open_) - 1 > depth:
                final, arcs, symbol = open_.pop()
                open_[-1][1].append((symbol, self.state(final, arcs)))

        for text in strings:
            same, least = 0, min(len(before), len(text))
            while same < least and before[same] == text[same]:
                same += 1
            close(same)
            open_.extend([False, [], symbol] for symbol in text[same:])
            open_[-1][0] = True
            before = text
        close(0)
        return self.state(open_[0][0], open_[0][1])

    def common(self, x: int, y: int) -> tuple[str, ...]:
        """Strings that both states accept."""
        key = (x, y) if x < y else (y, x)
        if key not in self.shared:
            found, todo = [], [(*key, "")]
            while todo:
                a, b, text = todo.pop()
                if self.states[a][0] and self.states[b][0]:
                    found.append(text)
                other = self.arcs[b]
                todo.extend((t, other[c], text + c) for c, t in self.states[a][1] if c in other)
            self.shared[key] = tuple(found)
        return self.shared[key]

    def edits_at(self, state: int) -> list[tuple[str, str]]:
        """Pairs of right strings, the first no longer, whose one edit is their first code point."""
        if state not in self.edits:
            found = []
            final, arcs = self.states[state]
            for i, (a, x) in enumerate(arcs):
                for b, y in arcs[:i]:
                    found.extend((b + s, a + s) for s in self.common(x, y))
                # a is inserted: what follows it is read from this state, by another arc.
                if final and self.states[x][0]:
                    found.append(("", a))
                for c, y in arcs:
                    if c != a and c in self.arcs[x]:
                        found.extend((c + s, a + c + s) for s in self.common(self.arcs[x][c], y))
            self.edits[state] = found
        return self.edits[state]

    def pairs(self, state: int) -> Iterator[tuple[str, str]]:
        """Accepted pairs one edit apart, each once; the first is no longer than the second."""
        todo = [(state, "")]
        while todo:
            at, text = todo.pop()
            for x, y in self.edits_at(at):
                yield text + x, text + y
            todo.extend((t, text + c) for c, t in self.states[at][1])


def _met_before(steps: list[tuple[str, int, int]], x: str, y: str) -> bool:
    """Whether an earlier split put two words together under their first halves too."""
    for kind, head, tail in steps:
        if kind == "P":
            x, y = x[head:], y[head:]
        elif x[:head] == y[:head]:
            return True
        else:
            x, y = x[: len(x) - tail][::-1], y[: len(y) - tail][::-1]
    return False


def near_in_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best) from rows (key, path, word, n, rest, base) sorted by key and rest."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    acceptor, out = Acceptor(), []
    names = ["word", "n_near", "best_n", "best"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 4, kinds, strict=True)], names)
    for _, group in groupby(rows, key=lambda r: r[0]):
        first = next(group)
        second = next(group, None)
        if second is None:
            continue
        entries = {r[4]: r for r in (first, second, *group)}
        steps = [(k, int(h), int(t)) for k, h, t in _STEP.findall(first[1])]
        near: dict[str, list] = {}
        for x, y in acceptor.pairs(acceptor.add(sorted(entries))):
            u, v = entries[x], entries[y]
            # Two words of the longer length meet under that length.
            if len(x) > first[5] or _met_before(steps, u[2], v[2]):
                continue
            for w, o in ((u, v), (v, u)):
                found = near.setdefault(w[2], [0, 1, ""])
                found[0] += 1
                if (-o[3], o[2]) < (found[1], found[2]):
                    found[1], found[2] = -o[3], o[2]
        out.extend((word, k, -n, best) for word, (k, n, best) in near.items())
        if len(out) > 5000:
            yield batch()
            out.clear()
        if len(acceptor.states) > KEPT_STATES:
            acceptor = Acceptor()
    yield batch()


def near_words(words: DataFrame, scratch: Scratch, state_words: int = STATE_WORDS) -> DataFrame:
    """(word, n_near, best_n, best): number of near words, and the most frequent of them."""
    rows = initial_states(words, scratch, state_words)
    rows = rows.repartition("key").sortWithinPartitions("key", "rest").select("key", "path", "word", "n", "rest", "base")
    found = rows.mapInArrow(near_in_states, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def with_roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of rows (word, form): each word's last form, by doubling.

    A form is ten times as frequent as its variant, so a chain has fewer than twenty words.
    """
    roots = scratch.save(forms.select("word", F.col("form").alias("root")))
    while True:
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = scratch.save(roots.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", state_words: int = STATE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    Words are runs of [A-Za-z\\u00c0-\\u00ff] with A-Z in lower case; a null text has none, a null id
    counts as empty in the draw of slips.  Repeated rows count as often as they stand; other columns
    are left out.  Of near words equally frequent the smallest in code-point order is the form.  An empty table gives
    no rows.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.save(vocabulary(docs, doc_id, text))
    near = words.join(near_words(words, scratch, state_words), "word", "left")
    is_form = F.col("best_n") >= F.col("n") * RATIO
    found = scratch.save(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
        )
    )
    roots = with_roots(found.filter("form IS NOT NULL"), scratch)
    whole = found.join(roots, "word", "left")
    whole = durable(whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    scratch.clear()
    return whole


def op12_spelling_variants(spark, folder: str) -> DataFrame:
    """Every word of all documents with its near words, form and root."""
    return spelling_variants(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
