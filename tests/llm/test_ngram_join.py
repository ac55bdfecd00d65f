import random
import time

import numpy as np
import pyarrow as pa
import pytest

from spanlight.llm import ngram_join
from spanlight.llm.components import connected_components
from spanlight.llm.ngram_join import ngram_components


def brute(rows, words=5, percent=80):
    sets = []
    for _, text in rows:
        line = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            line = line.replace(c, " ")
        w = [x for x in line.split(" ") if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed, groups=12, copies=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.5:
            base[3:3] = passage
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in text))
    rows += ["", None, "one", "one", "ONE  ", "two words", " \n\t", "a b c d e", "a b c d e", "x " * 3000]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    assert sorted(map(tuple, ngram_components(docs).collect())) == brute(rows)


def test_large_blocks(spark):
    rows = corpus(7, groups=3, copies=60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_components(docs, block_bytes=6_000).collect())) == brute(rows)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_components(empty).collect() == []
    text = "a b c d e f g h"
    rows = ngram_components(spark.createDataFrame([(None, text), (4, text), (2, text), (2, text)], "doc_id long, text string")).collect()
    assert {r.component_id for r in rows} == {2} and len(rows) == 4


def test_tree_prunes_nothing_needed():
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(1, 25), rng.randint(5, 20))) for _ in range(150)]
    tree = ngram_join.PrefixTree(80)
    for k in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        tree.add(k, len(sets[k]), sets[k])
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(set(sets[i]) & set(sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = parent[i], parent[j]
                parent = [a if p == b else p for p in parent]
    for i in range(len(sets)):
        for j in range(i):
            assert (parent[i] == parent[j]) == (tree.find(i) == tree.find(j))


def test_rows_without_an_id_link_and_bridge(spark):
    line = [f"w{i}" for i in range(60)]
    # each step changes one word at an end: neighbours have 54 or more of 58 or fewer n-grams in common, the ends too few
    step = lambda k: " ".join([*line[k:], *(f"x{i}" for i in range(k))])
    rows = [(7, step(0)), (None, step(5)), (4, step(10)), (None, "alone " * 3), (9, None), (None, step(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id) for r in ngram_components(docs).collect()), key=str)
    assert got == sorted([(7, 4), (0, 4), (4, 4), (0, None), (9, 9), (0, 4)], key=str)
    apart = spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")
    assert {r.component_id for r in ngram_components(apart).collect()} == {7, 4}


def block(seed, count, words):
    """Near copies of one text of which about half link, as a block's table: (node, n, line)."""
    rng = random.Random(seed)
    sets = []
    for k in range(count):
        text = [(i, 0) for i in range(words)]
        for _ in range(rng.randint(0, max(2, words // 20))):
            i = rng.randrange(words)
            text[i] = (i, rng.randint(1, 9) if rng.random() < 0.7 else -k - 1)
        sets.append({hash(tuple(text[i : i + 5])) & (1 << 56) - 1 for i in range(words - 4)})
    number = {}
    for s in sets:
        for x in s:
            number[x] = number.get(x, 0) + 1
    lines = [np.array(sorted(min(number[x], 62) << 57 | x for x in s if number[x] > 1), np.uint64).tobytes() for s in sets]
    return sets, pa.table({"node": [7919 * k - count for k in range(count)], "n": [len(s) for s in sets], "line": pa.array(lines, pa.binary())})


def one_by_one(table):
    tree = ngram_join.PrefixTree(80)
    for n, name, line in sorted(zip(table["n"].to_pylist(), table["node"].to_pylist(), table["line"].to_pylist(), strict=True)):
        tree.add(name, n, np.frombuffer(line, np.uint64).tolist())
    return {name: tree.find(name) for name in table["node"].to_pylist()}


def test_all_sets_at_once_link_like_one_by_one():
    for seed, (count, words) in enumerate([(33, 8), (60, 40), (90, 100), (250, 60), (64, 400)]):
        sets, table = block(seed, count, words)
        got = ngram_join._join_block(80)(table)
        got = dict(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
        assert got == one_by_one(table) and len(set(got.values())) > 1
        names = table["node"].to_pylist()
        for i in range(count):
            for j in range(i):
                both = len(sets[i] & sets[j])
                assert got[names[i]] == got[names[j]] or 100 * both < 80 * (len(sets[i]) + len(sets[j]) - both)


def test_a_large_block_of_near_copies_that_do_not_link_takes_a_fraction_of_one_by_one():
    _, table = block(1, 700, 400)
    began = time.process_time()
    expected = one_by_one(table)
    middle = time.process_time()
    got = ngram_join._join_block(80)(table)
    assert dict(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == expected
    assert (time.process_time() - middle) * 3 < middle - began


def test_the_plan_of_links_runs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    links = spark.range(40).selectExpr("id div 4 AS a", "id + 100 AS b").mapInArrow(count, "a long, b long")
    assert {(r.node, r.component) for r in connected_components(links).collect()} == {(k, k) for k in range(10)} | {(k + 100, k // 4) for k in range(40)}
    assert made.value == 40
