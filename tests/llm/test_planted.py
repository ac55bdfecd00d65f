"""Passages planted in prose: those of 400 bytes and more go, shorter ones stay."""

import random

from spanlight.llm.repeats import remove_repeats


def test_planted_passages(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(2, 10))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    long, short = [prose(90)[:520] for _ in range(5)], [prose(50)[:330] for _ in range(5)]
    rows, planted = [], {}
    for i in range(300):
        kind = ("long", "short", "clean")[i % 3]
        middle = rng.choice(long) if kind == "long" else rng.choice(short) if kind == "short" else ""
        rows.append((i, f"{prose(rng.randint(20, 120))} {middle} {prose(rng.randint(20, 120))}"))
        planted[i] = kind, len(middle.encode())
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = [i for i in got if got[i] > 0]
    assert {planted[i][0] for i in caught} == {"long"} and len(caught) == 100  # precision 1, recall 1 of 400 bytes and more
    assert all(planted[i][1] <= got[i] <= planted[i][1] + 10 for i in caught)  # and what agrees by chance beside it
