import hashlib
import random
from collections import defaultdict

import pytest

from spanlight.llm.repeats import remove_repeats


def brute(rows, length):
    seen = defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for (doc, _), t, g in zip(rows, texts, gone, strict=True):
        runs = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((doc, len(t), sum(g), runs, hashlib.sha256(bytes(b for b, x in zip(t, g, strict=True) if not x)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    passages = [text(rng.randint(20, 120)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [text(rng.randint(0, 60)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "ab" * 100), (103, "a" * 300), (104, "x" * 39), (105, rows[3][1]), (106, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, doc string")
    for q in (20, 7):
        got = remove_repeats(docs, 40, q).drop("kept").collect()
        assert sorted(map(tuple, got)) == brute(rows, 40)
    assert remove_repeats(docs.limit(0), 40, 20).count() == 0
