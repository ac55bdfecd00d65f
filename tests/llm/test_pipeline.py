"""The stages of the pipeline on rows with every edge case, and the whole against plain loops."""

import hashlib
import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key string, node string"


def sentences(seed, words, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


WORDS = {"en": "the of and house water river quickly under morning light people time every other would".split(), "de": "der die und haus wasser fluss schnell unter morgen licht leute zeit jeder andere würde".split()}


def rows():
    out = [(i, sentences(i, WORDS["en" if i % 2 else "de"], 40), "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    out += [(100, out[3][1], "en", "s0"), (101, out[3][1], "en", "s1"), (102, out[4][1] + " licht", "de", "s2"), (102, sentences(77, WORDS["de"], 50), "de", None)]
    out += [(None, sentences(5, WORDS["en"], 40) + " water", None, None), (None, None, "en", "s0"), (103, "", "en", "s0"), (104, "12345 !!", None, "s1"), (105, sentences(9, WORDS["en"], 60_000), "en", "s1")]
    return [(*r, len(r[1] or ""), "k", "n") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_near(items):
    left, sets = dict.fromkeys(range(len(items))), [shingles(t or "") for _, t in items]
    parent = list(range(len(items)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in left:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in left:
        groups.setdefault(find(i), []).append(i)
    order = lambda i: (items[i][0] is None, items[i][0] or 0)
    return sorted((items[min(g, key=order)] for g in groups.values()), key=str)


def test_each_stage(spark, docs):
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]
    for stage in stages:
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0
        if stage is not stages[-1]:
            assert empty.columns == docs.columns
    kept = stages[0](spark, docs, "")
    texts = [r.text for r in kept.collect()]
    assert None not in texts and "" not in texts and "12345 !!" not in texts
    assert len(texts) == len([r for r in rows() if r[1] and r[1] != "12345 !!"])
    want = {}
    for r in rows():
        want[r[1] or ""] = max(want.get(r[1] or "", (False, -1)), (r[0] is not None, r[0] or 0))
    got = {r.text or "": (r.doc_id is not None, r.doc_id or 0) for r in stages[1](spark, docs, "").collect()}
    assert got == want
    once = [(r.doc_id, r.text) for r in stages[1](spark, docs, "").collect()]
    left = [(r.doc_id, r.text) for r in stages[2](spark, stages[1](spark, docs, ""), "").collect()]
    assert sorted(left, key=str) == brute_near(once)
    mixed = stages[3](spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in mixed} <= {(r[0], r[1]) for r in rows()}


def test_run(spark, docs, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    from spanlight.llm.byte_bpe import read_ranks, vocabulary

    docs.drop("__key", "node").write.parquet(f"{tmp_path}/documents.parquet")
    path, pattern = vocabulary()
    library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    known = {hashlib.sha256((r[1] or "").encode()).hexdigest(): r[1] or "" for r in rows()}
    assert len(got) > 40
    for r in got:
        text = known[r.decoded_sha256]
        assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode_ordinary(text) and r.n_tokens == len(r.token_ids) // 4
        assert r.ids_sha256 == hashlib.sha256(r.token_ids).hexdigest()
