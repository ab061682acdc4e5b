import random

import pytest

from riskmill.llm import minhash
from riskmill.llm.shared import components


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def by_hand(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(draw, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
        yield " ".join(words)


def check(spark, rows, how=minhash.Near()):
    docs = spark.createDataFrame(
        [(i, t, "x", 0, "y") for i, t in rows], "doc_id long, text string, n string, id int, sketch string"
    ).repartition(5)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, how).collect()}
    wanted = by_hand(rows)
    assert len(got) == len(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == wanted
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_against_all_pairs(spark):
    draw = random.Random(8)
    texts = ["", None, " \t", "one", "One", "a b c d", "a b c d e", "A B C D E", "a b c d e", "é É", "x " * 3000]
    passage = [f"p{i}" for i in range(40)]
    for size in (12, 30, 90, 300):
        base = [f"v{draw.randrange(900)}" for _ in range(size)]
        texts += near_copies(draw, base, 25, max(1, size // 12))
    # A passage that many unlike texts share, and repeated rows.
    texts += [" ".join(passage + [f"u{draw.randrange(10**6)}" for _ in range(60)]) for _ in range(60)]
    texts += texts[:20] + ["hot copy of one and the same text"] * 80
    check(spark, list(enumerate(texts)))


def test_group_whose_members_are_only_partly_alike(spark):
    """A large group around the threshold: centres find some links, the rest comes from the open lists."""
    draw = random.Random(9)
    base = [f"v{i}" for i in range(80)]
    texts = list(near_copies(draw, base, 150, 3))
    check(spark, list(enumerate(texts)), minhash.Near(rounds=1))


def test_empty_null_ids_and_stage(spark):
    docs = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (1, "a b c"), (1, "a b c"), (5, "")],
                                 "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (5, 0, 5, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted((r.doc_id or 0) for r in minhash.drop_near_duplicates(docs).collect()) == [0, 1, 1, 5]


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(9, 3), (3, 9), (9, 5), (7, 8), (None, 2)],
])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(frame).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for o in near[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        assert got[node] == min(seen)
    assert set(got) == set(near)


def test_main_root_of_a_tie_in_any_order(spark):
    """Both sides of the last join choose it anew, so rows in another order must not change it."""
    sizes = [(v, root, c) for v in range(20) for root, c in ((3, 1), (7, 1), (5, 1))] + [(20, 9, 1), (20, 2, 4)]
    wanted = {(v, 7, 3) for v in range(20)} | {(20, 2, 2)}
    for rows in (sizes, sizes[::-1], sorted(sizes, key=lambda r: r[1])):
        one = spark.createDataFrame(rows, "value long, root long, c long").coalesce(1)
        assert {tuple(r) for r in minhash.main_roots(one).collect()} == wanted
