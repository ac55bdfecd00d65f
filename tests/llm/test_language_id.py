"""Language ID: the model equals brute-force PPM; rare languages beside a frequent one."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from spanlight.llm.language_id import UNIT, fit_language_model, predict_language


def brute(rows, new, depth):
    """Bits of each new text in each language, by the definition of method C with exclusion."""
    trees, symbols = defaultdict(lambda: defaultdict(Counter)), set()
    for text, lang in rows:
        data = text.lower().encode()
        symbols |= set(data)
        line = b"\n" * depth + data
        for i in range(depth, len(line)):
            for k in range(depth + 1):
                trees[lang][line[i - k : i]][line[i]] += 1

    def chance(tree, context, byte):
        parent = (lambda b: chance(tree, context[1:], b)) if context else (lambda b: 1 / (len(symbols) + 1))
        seen = tree.get(context)
        if not seen:
            return parent(byte)
        total = sum(seen.values()) + len(seen)
        return seen[byte] / total if byte in seen else len(seen) / total * parent(byte) / (1 - sum(parent(b) for b in seen))

    out = []
    for text in new:
        line = b"\n" * depth + text.lower().encode()
        out.append([sum(-math.log2(chance(trees[lang], line[i - depth : i], line[i])) for i in range(depth, len(line))) for lang in sorted(trees)])
    return np.array(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("abcde é", k=rng.randint(0, 40))), "x") for _ in range(12)] + [("".join(rng.choices("cdefg ü漢", k=30)), "y") for _ in range(2)] + [("zq", "z")]
    new = ["abcABC é ü", "cde fg漢漢", "zq", "12?", "e"]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    for depth in (1, 3, 4):
        data = [t.lower().encode() for t in new]
        got = fit_language_model(docs, depth=depth).lengths(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])) / UNIT
        assert np.abs(got - brute(rows, new, depth)).max() < 0.02


def test_rare_languages_beside_a_frequent_one(spark):
    rng = random.Random(6)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=4)) for _ in range(10))
    rare = {"l1": "abcdxyz", "l2": "abcdefg", "l3": "abcduvw"}
    rows = [(i, make("abcdmno"), "a") for i in range(5_000)] + [(10_000 * k + i, make(letters), lang) for k, (lang, letters) in enumerate(rare.items(), 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language_model(docs, sample_docs=100)
    assert model.langs == ["a", *rare]
    new = spark.createDataFrame([(i, make(letters), lang) for lang, letters in rare.items() for i in range(20)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == r.lang for r in predict_language(new, model).collect())
