"""Nulls, empty texts, repeated rows, clashing columns and empty tables."""

import collections

import pytest

from spanlight.llm.byte_bpe import Utf8Stream, decode_bpe, encode_bpe, vocabulary
from spanlight.llm.exact_dedup import exact_dedup
from spanlight.llm.label_shards import label_shards
from spanlight.llm.mixing import poisson_mix

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 5000), (6, "c"), (6, "c"), (None, "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", 7) for i, t in ROWS], "doc_id long, text string, source string, copy int")


def test_exact(docs):
    got = sorted(((r.doc_id is None, r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect())
    assert got[0][1:] == (2, 3, False) and got[1][1:] == (2, 3, True) and got[2][1:] == (4, 2, False) and got[3][1:] == (4, 2, True)
    assert got[4][1:] == (5, 1, True) and got[5][1:] == got[6][1:] == (6, 2, True) and got[7][1:] == (2, 3, False)
    assert exact_dedup(docs.limit(0)).count() == 0


def test_shards(spark, docs):
    many = docs.unionByName(spark.range(100, 160).selectExpr("id AS doc_id", "'same' AS text", "'s' AS source", "0 AS copy"))
    rows = label_shards(many, shards=4, cells=16).collect()
    counts = collections.Counter(r.shard for r in rows)
    assert sum(counts.values()) == 68 and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_mix(docs):
    rows = poisson_mix(docs, rate=3.0).collect()
    per = collections.Counter((r.doc_id, r.text) for r in rows)
    assert all(r.copy < r.reps for r in rows) and len(rows[0]) == 6 and per
    assert poisson_mix(docs.limit(0)).count() == 0


def test_tokens(docs):
    path, pattern = vocabulary()
    rows = decode_bpe(encode_bpe(docs, path, pattern), path).collect()
    assert all(r.decoded == (r.text or "") for r in rows) and len(rows) == len(ROWS)


def test_tokens_with_little_kept_and_decoded_in_one_pass(docs):
    path, pattern = vocabulary()
    want = {(r.doc_id, r.text): bytes(r.token_ids) for r in encode_bpe(docs, path, pattern).collect()}
    rows = encode_bpe(docs, path, pattern, keep_learned=False, decoded_col="copy", max_kept=3, max_pieces=1).collect()
    assert len(rows) == len(ROWS) and all(r.copy == (r.text or "") and bytes(r.token_ids) == want[r.doc_id, r.text] for r in rows)


def test_utf8_in_parts():
    data = "aé漢🙂z".encode()
    for cut in range(len(data) + 1):
        s = Utf8Stream()
        assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.finish() == "aé漢🙂z"
