"""Language ID and toxicity: held-out results, edge cases and empty tables."""

import random

from spanlight.llm.language_id import UNDETERMINED, fit_language_model, predict_language
from spanlight.llm.toxicity import fit_toxicity, score_toxicity

EDGES = [(900, None), (901, ""), (902, "12 34 !?"), (903, "one two " * 20_000), (904, "one two"), (904, "one two")]


def texts(words, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=12)) for _ in range(n)]


def test_language(spark):
    a, b = "the one two and three of that".split(), "der und zwei eine das nicht ist".split()
    rows = [(i, t, "x") for i, t in enumerate(texts(a, 40, 1))] + [(100 + i, t, "y") for i, t in enumerate(texts(b, 40, 2))]
    learned = spark.createDataFrame(rows + [(300, None, "x"), (301, "a", None)], "doc_id long, text string, lang string")
    model = fit_language_model(learned)
    new = [(i, t, 5) for i, t in enumerate(texts(a, 20, 3))] + [(100 + i, t, 5) for i, t in enumerate(texts(b, 20, 4))]
    docs = spark.createDataFrame(new + [(i, t, 5) for i, t in EDGES], "doc_id long, text string, score int")
    got = predict_language(docs, model).collect()
    assert len(got) == len(new) + len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == ("x" if r.doc_id < 100 else "y") for r in got if r.doc_id < 200)
    assert {r.doc_id for r in got if r.lang_pred == UNDETERMINED} == {900, 901, 902}
    assert fit_language_model(learned.limit(0)) is None
    assert {r.lang_pred for r in predict_language(docs, None).collect()} == {UNDETERMINED}
    assert predict_language(docs.limit(0), model).count() == 0


def test_toxicity(spark):
    insult, group, plain = "gorp", "zindle", "a walk in the old park with some friends".split()

    def make(n, seed):
        out = []
        for k, t in enumerate(texts(plain, n, seed)):
            both, kind = t.split(), k % 4  # neither term alone is toxic; both are
            both[2:2] = [[], [insult], [group], [insult, group]][kind]
            out.append((seed * 1000 + k, " ".join(both), int(kind == 3)))
        return out

    rows, new = make(400, 1), make(80, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(7, None)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    other = spark.createDataFrame([(i, t, "s") for i, t, _ in new] + [(i, t, "s") for i, t in EDGES], "doc_id long, text string, score string")
    got = score_toxicity(other, model).collect()
    assert len(got) == len(new) + len(EDGES) and all(0 <= r.score <= 1 for r in got)
    truth = {i: x for i, _, x in new}
    right = sum((r.score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert right >= 0.95 * len(new), right
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    none = fit_toxicity(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in score_toxicity(docs.limit(5), none).collect())
    assert score_toxicity(other.limit(0), model).count() == 0


def test_toxic_pairs_whose_members_say_nothing_alone(spark):
    plain = "a walk in the old park with some friends".split()

    def make(n, seed):
        out = []
        for k, t in enumerate(texts(plain, n, seed)):
            both = t.split()
            both[2:2] = [[], ["gorp"], ["zindle"], ["gorp", "zindle"]][k % 4]
            out.append((seed * 10_000 + k, " ".join(both), int(k % 4 in (0, 3))))  # both or neither
        return out

    rows, new = make(800, 1), make(200, 2)
    model = fit_toxicity(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.score >= 0.5 for r in score_toxicity(spark.createDataFrame([r[:2] for r in new], "doc_id long, text string"), model).collect()}
    assert sum(got[i] == x for i, _, x in new) >= 190


def test_machine_against_loops(spark):
    import numpy as np

    from spanlight.llm.toxicity import FactorizationMachine

    rng = np.random.default_rng(3)
    model = FactorizationMachine(np.arange(20, dtype=np.int16), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    sets = [sorted(rng.choice(20, rng.integers(0, 9), replace=False).tolist()) for _ in range(30)]
    doc, term = np.repeat(np.arange(30), [len(s) for s in sets]), np.array([t for s in sets for t in s], np.int64)
    for s, margin in zip(sets, model.margins(30, doc, term), strict=True):
        want = 0.3 + sum(model.weights[t] for t in s) + sum(float(model.factors[a] @ model.factors[b]) for i, a in enumerate(s) for b in s[:i])
        assert abs(margin - want) < 1e-9


def test_code_lengths_against_plain_ppm(spark):
    """Escape method C with exclusion, context by context, on dictionaries."""
    import math
    from collections import Counter, defaultdict

    import numpy as np

    from spanlight.llm.language_id import UNIT

    depth, learned = 2, {"x": ["abcab", "abd", ""], "y": ["bcbcd", "d d"]}
    rows = [(10 * k + j, t, lang) for k, (lang, ts) in enumerate(learned.items()) for j, t in enumerate(ts)]
    model = fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), depth=depth)
    counts = {lang: [defaultdict(Counter) for _ in range(depth + 1)] for lang in learned}
    for lang, ts in learned.items():
        for t in ts:
            line = "\n" * depth + t
            for i in range(depth, len(line)):
                for k in range(depth + 1):
                    counts[lang][k][line[i - k : i]][line[i]] += 1
    seen = {c for lang in learned for c in counts[lang][0][""]}

    def bits(lang, history, symbol):
        tables = counts[lang]

        def chance(k, c):
            if k < 0:
                return 1 / (len(seen) + 1)
            here = tables[k].get(history[len(history) - k :])
            if not here:
                return chance(k - 1, c)
            total, kinds = sum(here.values()), len(here)
            if c in here:
                return here[c] / (total + kinds)
            return kinds / (total + kinds) * chance(k - 1, c) / (1 - sum(chance(k - 1, s) for s in here))

        return -math.log2(chance(depth, symbol))

    for text in ("abcbd", "zz a", "dddd", "a"):
        line = "\n" * depth + text
        data = np.frombuffer(text.encode(), np.uint8)
        got = model.lengths(data, np.array([0, len(data)]))[0]
        for k, lang in enumerate(model.langs):
            want = sum(bits(lang, line[i - depth : i], line[i]) for i in range(depth, len(line)))
            assert abs(got[k] / UNIT - want) < len(text) * 2 / UNIT + 1e-3, (text, lang)
