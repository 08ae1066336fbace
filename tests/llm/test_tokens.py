"""Token operators against their libraries."""

import gc
import hashlib
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from runlens.llm import bpe, token_counts, token_file
from runlens.llm.catalog import QUERIES

from .conftest import rows

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
PIECES = P.path("piece_bpe_32k.model")
PIECE = st.sampled_from(["a", "B", " ", "  ", "\n", "\t", "'s", "'", "é", "漢", "1", "23", ".", ",", "!", "\xa0", "<|endoftext|>", "▁", "<s>", "don't", "İ", "ß"])
TEXT = st.lists(PIECE, max_size=40).map("".join)


def expected_ids(text):
    return bpe.encoding(RANKS, P.PATTERN).encode_ordinary(text or "")


def test_bpe_equals_the_library_and_decodes(clashing_docs, edge_rows):
    encoded = bpe.encode(clashing_docs, RANKS, P.PATTERN)
    got = bpe.decode(encoded, RANKS).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((r.doc_id, tuple(expected_ids(r.text))) for r in edge_rows)
    assert sorted((r.doc_id, bytes(r.bytes)) for r in got) == sorted((r.doc_id, (r.text or "").encode()) for r in edge_rows)


def test_bpe_encodes_and_decodes_in_one_step(spark, clashing_docs, edge_rows, no_docs):
    for chunk in (bpe.CHUNK, 40):  # most texts in one chunk, and in several
        got = bpe.encode(clashing_docs, RANKS, P.PATTERN, chunk=chunk, overlap=min(chunk // 4, bpe.OVERLAP), decoded=True)
        assert got.columns == ["doc_id", "ids", "bytes"]
        want = [(r.doc_id, tuple(expected_ids(r.text)), (r.text or "").encode()) for r in edge_rows]
        assert sorted((r.doc_id, tuple(r.ids), bytes(r.bytes)) for r in got.collect()) == sorted(want)
    assert bpe.encode(no_docs, RANKS, P.PATTERN, decoded=True).count() == 0


def python_steps(node, above=0):
    """The most Python steps that one task runs at once, each in a worker of its own."""
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        node = node.initialPlan()
    here = 0 if "Exchange" in node.nodeName() else above + (node.nodeName() == "MapInArrow")
    below = node.children()
    return max([here, *(python_steps(below.apply(i), here) for i in range(below.size()))])


def test_tasks_of_bpe_keep_one_python_worker_each(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df in (corpus_pipeline.encode(spark, docs, small), QUERIES["op1_byte_bpe"](spark, small)):
        assert python_steps(df._jdf.queryExecution().executedPlan()) == 1


def test_bpe_chunks_stitch(spark):
    texts = [
        "aaaa " * 200,
        "x" * 700 + "'s" * 100 + "   " * 100,
        " " * 500 + "end",
        "a1!b2?" * 150,
        "it's we're 'tis '" * 60,
        "漢字かな" * 100 + "é" * 99,
        "\n \t" * 200 + "y",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk, overlap in ((50, 8), (97, 30), (10, 4)):
        got = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS, P.PATTERN, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: expected_ids(t) for i, t in enumerate(texts)}


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(4, 30))
def test_trusted_boundaries_are_those_of_the_whole_text(text, size):
    import regex

    true = {m.start() for m in regex.finditer(P.PATTERN, text)}
    overlap = 6
    n = max(1, -(-(len(text) - overlap) // size))
    for c in range(n):
        part = text[c * size : c * size + size + overlap]
        _, tail = bpe.boundaries(part, P.PATTERN, c * size, size, overlap, c == 0, c == n - 1)
        assert set(tail.tolist()) <= true


def test_bpe_of_an_empty_table_and_unknown_ids(spark, no_docs):
    assert bpe.encode(no_docs, RANKS, P.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, [5]), (2, [10**9]), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.bytes for r in bpe.decode(odd, RANKS).collect()}
    assert got[1] is not None and got[2] is None and got[3] is None


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_token_counts_equal_the_library(texts):
    model = token_counts.processor(PIECES)[0]
    assert token_counts.count_texts(texts, PIECES) == [len(model.encode(t)) for t in texts]


def test_token_counts_of_edges(clashing_docs, edge_rows, no_docs):
    model = token_counts.processor(PIECES)[0]
    got = rows(token_counts.token_counts(clashing_docs, PIECES, batch_bytes=1000))
    want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in edge_rows]
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(no_docs, PIECES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_words_encode_as_whole_texts(texts):
    model = token_file.tokenizer(WORDS)[0]
    assert [a.tolist() for a in token_file.encode_texts(texts, WORDS)] == [
        model.encode(t, add_special_tokens=False).ids for t in texts
    ]


def test_words_that_differ_in_case_or_marks_are_merged_once():
    model, merged = token_file.tokenizer(WORDS)[0], []
    counted = SimpleNamespace(
        model=SimpleNamespace(tokenize=lambda w: merged.append(w) or model.model.tokenize(w)), encode_batch_fast=model.encode_batch_fast
    )
    known = token_file._encode_parts(["zwirnfarn"], counted, {})
    got = token_file._encode_parts(["Zwirnfarn", "ZWIRNFARN", "Zwirnfarn.", "zwirnFARN!?"], counted, known)
    assert len(merged) == 1
    for part, ids in got.items():
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(part, add_special_tokens=False).ids


def test_texts_encode_from_slices_of_arrow_columns(monkeypatch):
    monkeypatch.setattr(token_file, "KEPT_PARTS", 3)
    model, known = token_file.tokenizer(WORDS)
    known.clear()
    texts = ["left out", None, "", " Ab, ab\tAB.\n", "d\u00e9j\u00e0 vu; it's 3.", "a<|endoftext|>. x", "ab ab", "j\u030cJ\u030c. e\u0301!", None]
    for _ in range(2):
        column = pa.array(texts, pa.string()).slice(1, 7)
        got = token_file.encode_texts(column, WORDS)
        assert [a.tolist() for a in got] == [model.encode(t or "", add_special_tokens=False).ids for t in texts[1:8]]
        assert len(known) <= 3 and gc.isenabled()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 31), st.data())
def test_packing_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=60)), np.uint32)
    packed = token_file.pack(ids, bits)
    assert len(packed) == (len(ids) * bits + 7) // 8
    start = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - start))
    assert token_file.unpack(packed, bits, start, count).tolist() == ids[start : start + count].tolist()


def test_packing_refuses_ids_that_do_not_fit():
    with pytest.raises(ValueError):
        token_file.pack(np.array([8], np.uint32), 3)


def test_token_files(spark, clashing_docs, edge_rows, no_docs, tmp_path, monkeypatch):
    model = token_file.tokenizer(WORDS)[0]
    path = token_file.write_token_files(clashing_docs, WORDS, str(tmp_path / "a"), 2)
    got = sorted(token_file.crc(token_file.read_documents(spark, path)).collect(), key=lambda r: r.start)
    at = 0
    order = sorted(edge_rows, key=lambda r: (r.doc_id, r.text or ""))
    assert [r.doc_id for r in got] == [r.doc_id for r in order]
    for r, doc in zip(got, order):
        ids = model.encode(doc.text or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    whole = model.encode(edge_rows[8].text, add_special_tokens=False).ids
    assert token_file.read_span(spark, path, 7, 2, 3) == model.encode(edge_rows[7].text, add_special_tokens=False).ids[2:5]
    assert token_file.read_span(spark, path, 8, 1000, 5) == whole[1000:1005]
    assert token_file.read_span(spark, path, 99) == []
    empty = token_file.write_token_files(no_docs, WORDS, str(tmp_path / "b"), 2)
    assert token_file.read_documents(spark, empty).count() == 0


def test_queries_on_the_smallest_tables(spark, small):
    from runlens.llm import queries_tokens as q

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in q.op1(spark, small).collect():
        ids = expected_ids(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    assert q.op2(spark, small).count() == len(docs)
    model = token_counts.processor(PIECES)[0]
    for r in q.op6(spark, small).collect():
        n = len(model.encode(docs[r.doc_id]))
        assert (r.n_tokens, r.over_limit) == (n, n > 4096)


def test_ids_are_read_and_summed_in_one_step(spark, edge_docs, tmp_path):
    path = token_file.write_token_files(edge_docs, WORDS, str(tmp_path / "tokens"), 2)
    summed = token_file.read_crc(spark, path)
    want = token_file.crc(token_file.read_documents(spark, path))
    assert summed.schema == want.schema
    assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, want.collect()))
    edge_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op2_token_files"](spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
