"""Alignment, spelling variants and MinHash groups against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quitanda.llm import alignment, entries, minhash_dedup, spelling
from quitanda.llm.bpe import byte_alphabet
from quitanda.llm.superminhash import EMPTY, signatures
from quitanda.llm.words import mix, shingle_sets
from tests.llm.conftest import DOCS, prose

FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


# Alignment


def tokens_of(text):
    """Ids and token bytes of both sides by the libraries alone."""
    left = Tokenizer.from_file(FILES[0])
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    byte_of = {c: b for b, c in byte_alphabet().items()}
    a = left.encode(" " + text, add_special_tokens=False).ids
    b = right.encode(text)
    a_bytes = [bytes(byte_of[c] for c in left.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, b, a_bytes, b_bytes


def groups_of(text):
    a, b, a_bytes, b_bytes = tokens_of(text) if text else ([], [], [], [])
    whole = f" {text}".encode()
    if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return [], [], []
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
    groups, i, j = [], 0, 0
    for end in sorted({*ends[0]} & {*ends[1]}):
        x, y = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return a, b, groups


def aligned_by_hand(docs):
    rows, counts = [], Counter()
    for doc, text in docs:
        a, b, groups = groups_of(text)
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        counts.update(links.keys())
        rows.append((doc, a, b, groups, links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for doc, a, b, groups, links in rows:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        hits = sum(n for p, n in links.items() if counts[p] == best[p[0]])
        sums = sum(n * counts[p] for p, n in links.items())
        yield (-1 if doc is None else doc, len(a), len(b), len(groups), links.total(), hits, sums, digest)


ODD_TEXTS = [
    (50, "tabs\tand\n\n  many   blanks \r\n x"),
    (51, "naïve 日本語 Ωmega ☃☃☃   nb▁space"),
    (52, "<s> </s> <|endoftext|> <unk> <0x41>"),
    (53, "\x00nul and ﻿mark"),
    (54, " " * 3000 + "a" * 3000),
    (55, " "),
]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chunk", [alignment.CHUNK_PAIRS, 500])
def test_alignment_equals_libraries(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK_PAIRS", chunk)
    odd = spark.createDataFrame([(i, t, "k", 1.0, 7) for i, t in ODD_TEXTS], docs.schema)
    found = alignment.align_tokenizers(docs.unionByName(odd), *FILES).select(*COLUMNS).na.fill(-1, ["doc_id"])
    assert sorted(map(tuple, found.collect())) == sorted(aligned_by_hand(DOCS + ODD_TEXTS))


def test_alignment_of_windows_with_equal_hashes(monkeypatch):
    both = alignment.coders(*FILES)
    texts = [prose(40), "odd words here " * 30, prose(70, 3)]
    plain = alignment.Aligner(both.sizes, both.spaced).align(both.encode(texts))
    monkeypatch.setattr(alignment, "mix", lambda x: x % np.uint64(7))
    clashing = alignment.Aligner(both.sizes, both.spaced).align(both.encode(texts))
    for x, y in zip(plain, clashing, strict=True):
        assert x[:5] == y[:5]
        assert np.array_equal(x[5], y[5]) and np.array_equal(x[6], y[6])


def test_alignment_in_long_groups():
    """A group too long for all pairs of occurrences: recurring ids are multiplied."""
    sizes, spaced = (np.array([2], np.int64), np.array([1, 2], np.int64)), (np.zeros(1, bool), np.zeros(2, bool))
    found = alignment.Aligner(sizes, spaced).align([([0] * 5000, [0, *[1] * 4999, 0]), ([], []), ([0, 0], [0, 0, 1])])
    assert [r[:4] for r in found] == [(5000, 5001, 1, 5000 * 5001), (0, 0, 0, 0), (2, 3, 2, 3)]
    assert found[0][5].tolist() == [0, 1] and found[0][6].tolist() == [10_000, 5000 * 4999]
    assert found[2][4] == b"0|0,0;0|1"


def test_alignment_of_nothing(no_docs):
    assert alignment.align_tokenizers(no_docs, *FILES).count() == 0


# Spelling variants


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def variants_by_hand(docs):
    counts = Counter()
    for doc, text in docs:
        for word in re.findall(spelling.RUN, (text or "").translate(LOWER)):
            draw = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if draw % 31 == 0:
                word = word[: draw % len(word)] + word[draw % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    near = {w: [o for o in words if abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in words}
    form = {}
    for w, found in near.items():
        if found and words[best := min(found, key=lambda o: (-words[o], o))] >= 10 * words[w]:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None


def spelled_texts():
    base = ["responsable", "xxxxxxx", "xxxxxxxx", "xxxxxxxxx", "abababab", "ababababa", "éléphant", "elephant", "ÉLéphant", "x" * 3000, "x" * 3001]
    made = {b[:i] + c + b[i + k :] for b in base[:8] for i in range(len(b) + 1) for k in (0, 1) for c in ("", "a", "x", "é")}
    rows = [(i, " ".join(sorted(made)[i::3])) for i in range(3)] + [(10 + i, " ".join(sorted(made))) for i in range(2)]
    chain = " ".join(["wordformal"] * 2000 + ["wordforma"] * 150 + ["wordform"] * 12)
    return [*rows, (20, chain), (21, None), (22, ""), (None, "nullable nullable"), (23, " ".join(base) * 2), (23, " ".join(base))]


@pytest.mark.parametrize("state_words", [spelling.STATE_WORDS, 3])
def test_variants_equal_brute_force(spark, state_words):
    texts = spelled_texts()
    rows = spark.createDataFrame([(i, t, 5, "k") for i, t in texts], "doc_id long, text string, n int, key string").repartition(3)
    found = spelling.spelling_variants(rows, state_words=state_words).select("word", "form", "root", "n", "n_near", "form_n")
    expected = {r[0]: r for r in variants_by_hand(texts)}
    assert {r["word"]: tuple(r) for r in found.collect()} == expected
    assert expected["wordform"][1:3] == ("wordforma", "wordformal")


def test_acceptor_is_minimal_and_finds_each_pair_once():
    words = sorted({"".join(c) for c in ["abc", "abd", "xbc", "xbd", "ab", "abcc", "b", "bc", ""]})
    acceptor = spelling.Acceptor()
    start = acceptor.add(words)
    pairs = list(acceptor.pairs(start))
    assert sorted(tuple(sorted(p)) for p in pairs) == sorted((x, y) for i, x in enumerate(words) for y in words[i + 1 :] if one_edit(x, y))
    assert len({(s[0], s[1]) for s in acceptor.states}) == len(acceptor.states)


def test_variants_of_nothing(no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0


# MinHash groups


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = mix(rng.integers(0, 2**62, 4000, dtype=np.uint64))
    for n, same in ((40, 30), (500, 300), (1500, 1400)):
        x, y = pool[:n], np.concatenate([pool[:same], pool[2000 : 2000 + n - same]])
        found = signatures([x, y, np.zeros(0, np.uint64), x[::-1].copy()], 256)
        assert np.array_equal(found[0], found[3]) and (found[2] == EMPTY).all()
        assert abs((found[0] == found[1]).mean() - same / (2 * n - same)) < 0.12


def plain_signature(s, registers):
    """The published loop, one element and one step at a time."""
    found = [None] * registers
    for element in s.tolist():
        order = list(range(registers))
        for step in range(registers):
            draw = int(mix(np.array([(element + 0x9E3779B97F4A7C15 * (step + 1)) % 2**64], np.uint64))[0])
            at = step + (draw & 0xFFFFFFFF) % (registers - step)
            order[step], order[at] = order[at], order[step]
            value = step << 32 | draw >> 32
            if found[order[step]] is None or value < found[order[step]]:
                found[order[step]] = value
    return found


def test_early_stop_changes_nothing():
    sets = [mix(np.arange(a, b, dtype=np.uint64)) for a, b in ((0, 3), (5, 40), (100, 101), (7, 900))]
    for s, row in zip(sets, signatures(sets, 16).tolist(), strict=True):
        assert row == plain_signature(s, 16)


def copies_by_hand(docs):
    sets = [frozenset(s.tolist()) for s in shingle_sets(pa.array([t for _, t in docs], pa.string()), 4)]
    up = {doc: doc for doc, _ in docs if doc is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (x, _) in enumerate(docs):
        for j in range(i):
            y, both = docs[j][0], len(sets[i] & sets[j])
            if x is None or y is None or not both or 100 * both < 80 * (len(sets[i]) + len(sets[j]) - both):
                continue
            up[max(top(x), top(y))] = min(top(x), top(y))
    for (doc, _), s in zip(docs, sets, strict=True):
        component = None if doc is None else top(doc)
        yield -1 if doc is None else doc, len(s), -1 if doc is None else component, doc == component


def many_copies():
    """A family around a base, a family around a common passage, exact copies, and ids with two texts."""
    rng = np.random.default_rng(5)
    base = prose(120).split()
    family = []
    for i in range(60):
        words = base.copy()
        for at in rng.integers(0, len(words), int(rng.integers(1, 6))):
            words[at] = f"new{i}x{at}"
        family.append((100 + i, " ".join(words)))
    common = prose(100, 9)
    passage = [(300 + i, f"{common} " + " ".join(f"own{i}w{k}" for k in range(10 + i % 12))) for i in range(60)]
    exact = [(500 + i, prose(50, 11)) for i in range(40)]
    return [*DOCS, *family, *passage, *exact, (900, prose(50, 11)), (900, family[3][1]), (901, "one two"), (902, None)]


@pytest.mark.parametrize("few", [minhash_dedup.PAIRS_PER_MEMBER, 0])
def test_copies_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(minhash_dedup, "PAIRS_PER_MEMBER", few)
    texts = many_copies()
    rows = spark.createDataFrame([(i, t, "k", 1, 2, False) for i, t in texts], "doc_id long, text string, key string, n int, sid int, kept boolean")
    found = minhash_dedup.near_copies(rows.repartition(3)).na.fill(-1, ["doc_id", "component_id"])
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    key = lambda r: tuple(map(str, r))
    expected = [(d, n, c, True if d == -1 else k) for d, n, c, k in copies_by_hand(texts)]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


def test_copies_of_nothing(spark, no_docs):
    assert minhash_dedup.near_copies(no_docs).count() == 0
    lone = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e")], "doc_id long, text string")
    assert {tuple(r) for r in minhash_dedup.near_copies(lone).collect()} == {(1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True)}


# Registered queries


def driver_docs():
    table = pa.parquet.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


def test_registered_queries_equal_brute_force(spark):
    docs = driver_docs()
    run = lambda name, *columns: sorted(tuple(r) for r in entries.QUERIES[name](spark, SMALL).select(*columns).collect())
    assert run("op11_token_alignment", *COLUMNS) == sorted(aligned_by_hand(docs))
    assert run("op13_minhash_dedup", "doc_id", "n_shingles", "component_id", "kept") == sorted(copies_by_hand(docs))
    words = {r["word"]: r for r in entries.QUERIES["op12_spelling_variants"](spark, SMALL).collect()}
    assert len(words) > 100
    counts = Counter(len(w) for w in words)
    assert min(counts) == 7
    assert all(r["form_n"] >= 10 * r["n"] for r in words.values() if r["form"])
    some = sorted(words)[::20]
    assert all(words[w]["n_near"] == sum(one_edit(w, o) for o in words if abs(len(o) - len(w)) < 2) for w in some)
