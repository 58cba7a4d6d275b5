"""Encoding, packing, token files, chats and neighbours against libraries and brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quitanda.llm import chat, multi_index, packing, token_files
from quitanda.llm.bpe import ForcedBPE, decode_ids, default_tokenizer, encode_texts
from tests.llm.conftest import DOCS, prose

PATH = default_tokenizer()


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_ids_equal_the_library(library):
    bpe, rng = ForcedBPE(PATH), random.Random(1)
    texts = ["", "İΣΑΣ ß <|endoftext|>x<|startoftext|><|endoftext|", "日本語 é ​　x", "a" * 3000, "ab'" * 500, "don't I'LL", "x\x1cy\x85z"]
    texts += [f"a{chr(c)}b" for c in range(0x300)]
    texts += ["".join(rng.choice("abcdeéèñ'st l123#$%&.,\n<|> ÀÇΣσ日本") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert bpe.decode(expected) == library.decode(expected, skip_special_tokens=False)


def test_long_fragments_merge_alike():
    bpe = ForcedBPE(PATH)
    for word in (b"abababab" * 2, b"theinging", b"hello"):
        symbols = [*bpe.single[0][list(word[:-1])], bpe.single[1][word[-1]]]
        row = np.array([[*symbols, *[-1] * 4]], np.int64)
        merged = bpe.merge_short(row)[0]
        assert bpe.merge_long([int(s) for s in symbols]) == [i for i in merged.tolist() if i >= 0]


def test_encoded_table(docs, no_docs, library):
    out = decode_ids(encode_texts(docs, PATH), PATH).collect()
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    found = sorted((r["doc_id"] or -1, r["ids"], r["decoded"]) for r in out)
    assert found == sorted((i or -1, ids(t), library.decode(ids(t), skip_special_tokens=False)) for i, t in DOCS)
    assert encode_texts(no_docs, PATH).count() == 0


def test_packing(docs, no_docs, library):
    out = packing.pack_documents(docs, PATH).collect()
    lengths = sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    expected = []
    for i, t in DOCS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            expected.append((i or -1, k, a, len(part), zlib.crc32(part.tobytes())))
    assert lengths == sorted(expected)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [a for a, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_two_replace_the_smallest():
    plan = packing.plan_patterns({60: 1, 30: 1, 25: 1, 13: 1}, 100)
    assert plan[0] == ((60, 25, 13), 1) and plan[1] == ((30,), 1)
    rng = random.Random(3)
    counts = {rng.randint(1, 120): rng.randint(1, 40) for _ in range(80)}
    plan = packing.plan_patterns(counts, 300)
    assert all(sum(items) <= 300 for items, _ in plan)
    total = sum(k * n for k, n in counts.items())
    assert sum(sum(items) * n for items, n in plan) == total
    assert sum(n for _, n in plan) <= -(-total // 300) + 3


def test_token_files(spark, docs, no_docs):
    bpe = ForcedBPE(PATH)
    blocks = token_files.write_blocks(docs, PATH, block_tokens=64)
    found = token_files.count_tokens(blocks)
    lengths = [len(bpe.encode(t, special=False)) for i, t in DOCS]
    assert sorted(r["n_tokens"] for r in found.collect()) == sorted(lengths)
    assert found.filter("NOT closed").count() == 0
    assert token_files.count_tokens(token_files.write_blocks(no_docs, PATH)).count() == 0


def test_separators_across_blocks(spark):
    rng = random.Random(4)
    rows, expected = [], []
    for file in range(3):
        stream = [rng.choice((9, 9, 9, 1, 2, 3)) if rng.random() < 0.3 else 5 for _ in range(2500)]
        if file == 2:
            stream[-1] = 9
        start, number = 0, 0
        for at, token in enumerate(stream):
            if token == 9:
                expected.append((file, number, start, at - start, True))
                start, number = at + 1, number + 1
        if start < len(stream):
            expected.append((file, number, start, len(stream) - start, False))
        data = np.array(stream, "<u2").tobytes()
        rows += [(file, k, data[a : a + 4]) for k, a in enumerate(range(0, len(data), 4))]
    frame = spark.createDataFrame(rows + [(7, 0, None), (8, 0, b"")], "file long, block long, tokens binary").repartition(4)
    out = token_files.count_tokens(frame, separator=9)
    assert sorted(map(tuple, out.select("file", "doc_no", "start", "n_tokens", "closed").collect())) == sorted(expected)


def test_events_fold(spark):
    events = [
        (1, 1, 1, "open", "user", None), (1, 1, 2, "delta", None, "he"), (1, 1, 3, "delta", None, "llo"), (1, 1, 3, "delta", None, "llo"),
        (1, 2, 4, "open", "assistant", None), (1, 2, 5, "delta", None, "bad"), (1, 3, 6, "open", "user", None), (1, 3, 7, "delta", None, "lost"),
        (1, 2, 8, "regenerate", None, None), (1, 2, 9, "delta", None, "good"), (1, 4, 10, "open", None, None), (1, 4, 11, "edit", None, "new"),
        (None, 1, 1, "delta", "system", None),
    ]
    log = spark.createDataFrame(events, "conv_id long, message int, seq long, kind string, role string, text string").repartition(3)
    out = {tuple(r) for r in chat.fold_events(log).select("conv_id", "message", "role", "text").collect()}
    assert out == {(1, 1, "user", "hello"), (1, 2, "assistant", "good"), (1, 4, "", "new"), (None, 1, "system", "")}
    assert chat.format_chats(log.limit(0)).count() == 0


def test_chats_read_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s><\\\\s>[\\INST]", "", None, "plain ünï" * 200, "[INST[INST]]<s</s>"]
    rows = [(c, t, role, texts[(c + t) % len(texts)]) for c in range(6) for t, role in enumerate(("system", "user", "assistant", "assistant", "<s>x", None))]
    rows += [(1, 2, "assistant", "tie"), (1, 2, "assistant", "tie")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.format_chats(chat.events_of(frame)).select("conv_id", chat.read_back().alias("turns"), chat.loss_text().alias("loss"))
    for r in out.collect():
        mine = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]))
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(role, text) for _, role, text in mine]
        assert r["loss"] == "".join(text for _, role, text in mine if role == "assistant")


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1500, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[300:420] = vectors[300]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (None, [1.0] * 16), (20, vectors[20].tolist())]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    out = multi_index.search(frame, F.col("vec_id") % 20 == 0, block_rows=300).collect()
    scores = vectors @ vectors.T
    hits = total = 0
    for q in range(0, 1500, 20):
        best = sorted((-scores[q, i], i) for i in range(1500) if i != q)[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [r[0] for r in mine] == list(range(1, 21)) and len({r[1] for r in mine}) == 20
        assert all(s == pytest.approx(scores[q, i], abs=1e-12) for _, i, s in mine)
        assert mine == sorted(mine, key=lambda r: (-r[2], r[1]))
        hits += len({i for _, i in best} & {r[1] for r in mine})
        total += 20
    assert hits / total >= 0.9
    few = multi_index.search(frame.filter("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4
    assert multi_index.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_walk_goes_by_summed_distance():
    counts = np.ones((3, 3), np.int64)
    walked = multi_index.walk(np.array([0.0, 1.0, 5.0]), np.array([0.0, 0.5, 9.0]), counts, 4)
    assert walked.tolist() == [[True, True, False], [True, True, False], [False] * 3]


def test_blocks_hold_every_cell_once():
    counts = np.array([[3, 0, 4], [25, 1, 2], [9, 9, 0]])
    at = multi_index.layout(counts, 10)
    assert at.cells.tolist() == [0, 2, 3, 4, 5, 6, 7]
    assert at.block.tolist() == [0, 0, 1, 4, 4, 5, 6] and at.place.tolist() == [0, 1, 0, 0, 1, 0, 0]
    assert at.parts.tolist() == [1, 1, 3, 1, 1, 1, 1]


@pytest.mark.parametrize("share", [0.33, 0.6])
def test_neighbours_beside_a_dense_group(spark, share):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 32))
    dense = rng.random(3000) < share
    vectors[dense] = vectors[0] + 0.02 * rng.normal(size=(dense.sum(), 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 1, 0.5) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int, floor double").repartition(4)
    out = multi_index.search(frame, F.col("vec_id") % 20 == 0, block_rows=500, seed=8).collect()
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    recall = {True: [], False: []}
    for q in range(0, 3000, 20):
        mine = {r["vec_id"] for r in out if r["query_id"] == q}
        recall[bool(dense[q])].append(len(mine & set(np.argsort(-scores[q])[:20].tolist())) / 20)
    assert min(np.mean(recall[True]), np.mean(recall[False])) >= 0.9, {k: np.mean(v) for k, v in recall.items()}
    assert min(recall[False]) >= 0.5


def test_prose_has_no_long_repeats():
    assert len(set(prose(80).split())) > 60
