"""Byte-level BPE against the public library and against the merges applied one by one."""

import hashlib
import random

import numpy as np
import pytest

from spanlight.llm.byte_bpe import Decoder, Transducer, Utf8Stream, encode_bpe, op4_byte_bpe, read_ranks, vocabulary


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(vocabulary()[0])


@pytest.fixture(scope="module")
def library(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("x", pat_str=vocabulary()[1], mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    alphabet = "abcdefghijklmnop  \n\t.,'!é漢字😀0123ÄÖ"
    made = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)]
    return ["", " ", "a", "\n" * 700, "a" * 5000, "ab" * 4000, "漢" * 900, "thetheinging" * 300, "x" + "0" * 3000, *made]


@pytest.mark.parametrize("kept, pieces", [(0, 2), (3, 4), (30_000, 400_000)])
def test_the_library(ranks, library, kept, pieces):
    coder, back = Transducer(ranks, vocabulary()[1], kept, pieces), Decoder(ranks)
    for text in [*texts(), *texts()[:50]]:
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert back.text(ids) == text


def test_the_merges(ranks):
    coder, rng = Transducer(ranks, vocabulary()[1]), random.Random(4)
    for _ in range(400):
        data = bytes(rng.choices(b"etaoin shrdlu\xc3\xa9", k=rng.randrange(1, 40)))
        assert np.frombuffer(coder.piece(data), "<u4").tolist() == coder.merged(data)


def test_stream_cut_anywhere():
    data = "aé漢😀".encode() + b"\xff\xe6\xbc" + "b".encode()
    for cut in range(len(data) + 1):
        stream = Utf8Stream()
        assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.finish() == data.decode("utf-8", "replace")


def test_edge_cases(spark, library):
    path, pattern = vocabulary()
    rows = [(1, None, "u"), (1, None, "u"), (None, "", "v"), (2, "word " * 200_000, "w"), (3, "q" * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = encode_bpe(docs, path, pattern, decoded_col="decoded", keep_learned=False).collect()
    assert [len(r.token_ids) for r in got if not r.text] == [0, 0, 0]
    for r in got:
        assert r.decoded == (r.text or "")
        if r.doc_id == 2:
            assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode_ordinary(r.text)
    assert encode_bpe(docs.limit(0), path, pattern).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op4_byte_bpe(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
