import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spanlight.llm.katz import discounts, katz_scores


def brute(rows, held, order, min_count):
    tokens = {d: [*(t or "").lower().split(), None] for d, t in rows}
    grams = [Counter() for _ in range(order + 1)]
    for d, line in tokens.items():
        if d not in held:
            for i in range(len(line)):
                for k in range(1, order + 1):
                    before = tuple(line[j] if j >= 0 else "<start>" for j in range(i - k + 1, i))
                    grams[k][(*before, line[i])] += 1
    total, words = sum(grams[1].values()), len(grams[1])
    factors = [discounts(Counter(g.values())) for g in grams]
    off = lambda k, c: c * factors[k][c - 1] if c <= 5 else c
    tables = [None, {g: off(1, c) / total for g, c in grams[1].items()}]
    unknown = 1 - sum(tables[1].values())
    alpha = [None, None]
    for k in range(2, order + 1):
        ctx, kept = Counter(), {}
        for g, c in grams[k].items():
            ctx[g[:-1]] += c
        seen, low = defaultdict(float), defaultdict(float)
        for g, c in grams[k].items():
            if c >= min_count:
                kept[g] = off(k, c) / ctx[g[:-1]]
                seen[g[:-1]] += kept[g]
                low[g[:-1]] += tables[k - 1].get(g[1:], 0)
        tables.append(kept)
        alpha.append({h: (1 - seen[h]) / (1 - low[h]) for h in seen})

    def chance(g):
        k = len(g)
        if k == 1:
            return tables[1].get(g, unknown)
        return tables[k][g] if g in tables[k] else alpha[k].get(g[:-1], 1.0) * chance(g[1:])

    out = {}
    for d, line in tokens.items():
        score = sum(math.log10(chance((*(line[j] if j >= 0 else "<start>" for j in range(i - order + 1, i)), line[i]))) for i in range(len(line)))
        base = sum(math.log10((grams[1][(w,)] + 0.1) / (total + 0.1 * (words + 1))) for w in line)
        out[d] = (len(line), sum(grams[1][(w,)] > 0 for w in line), total, base, score)
    vocabulary = [g[0] for g in grams[1]]
    for h in list(alpha[order])[:20]:
        assert abs(sum(chance((*h, w)) for w in vocabulary) + alpha[order][h] * (unknown if order == 2 else alpha[order - 1].get(h[1:], 1.0) * unknown) - 1) < 1e-9
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 60)))) for i in range(60)] + [(90, None), (91, ""), (92, "NEW words\there w1"), (93, "w1  W2")]
    held = {d for d, _ in rows if d % 7 == 3}
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    for order in (2, 3):
        want = brute(rows, held, order, 2)
        got = {r.doc_id: r for r in katz_scores(docs, F.col("doc_id") % 7 == 3, order).collect()}
        assert set(got) == set(want)
        for d, (n, known, total, base, score) in want.items():
            r = got[d]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, d in held)
            assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6
    assert katz_scores(docs.limit(0), F.lit(False)).count() == 0
