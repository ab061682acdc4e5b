import numpy as np

from riskmill.llm import itq
from tests.llm.test_url_licence_warc import SF


def by_hand(rows, cosine):
    """Links, degrees and components over all pairs of a label."""
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (label, np.array(v, float))
    near = {i: set() for i, _, _ in rows}
    ids = sorted(ok)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            (la, x), (lb, y) = ok[a], ok[b]
            if la == lb and len(x) == len(y) and x @ y >= cosine * np.sqrt(x @ x) * np.sqrt(y @ y):
                near[a].add(b)
                near[b].add(a)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for o in near[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        out[i] = (len(near[i]), min(seen))
    return out, sum(map(len, near.values()))


def check(spark, rows, least_recall, how=itq.Codes()):
    frame = spark.createDataFrame(
        [(i, v, label, 1, "x") for i, v, label in rows],
        "vec_id long, embedding array<float>, label int, v int, key string",
    )
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]  # as stored, in single precision
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_vectors(frame, how).collect()}
    wanted, links = by_hand(rows, how.cosine)
    assert set(got) == set(wanted)
    assert all(got[i][0] <= wanted[i][0] for i in got)
    assert sum(n for n, _ in got.values()) >= least_recall * links
    return got, wanted


def test_recall_and_components(spark):
    draw = np.random.default_rng(4)
    rows = []
    for c in range(60):
        centre = draw.standard_normal(64)
        for _ in range(8):
            rows.append((len(rows), (centre + draw.standard_normal(64) * draw.choice([0.0, 0.05, 0.1, 0.14])).tolist(), c % 3))
    check(spark, rows, 0.99)


def test_given_embeddings(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(spark, rows, 0.99)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, nan], 0), (5, [1.0, inf], 0), (6, [1.0, None], 0),
        (7, [1.0, 2.0], None), (8, [1.0, 2.0], 0), (9, [1.0, 2.0], 0), (10, [2.0, 4.0], 0), (11, [1.0, 2.0], 1),
        (12, [1.0, 2.0, 0.0], 0), (13, [-1.0, -2.0], 0), (14, [0.0, 0.0], 0),
    ]
    got, wanted = check(spark, rows, 1.0)
    assert got == wanted
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert itq.near_vectors(empty).count() == 0
    single = spark.createDataFrame([(None, [1.0], 1), (3, None, None)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in itq.near_vectors(single).collect()] == [(3, 0, 3, True)]


def test_copies_are_counted_not_paired(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(500)] + [(1000, [1.0, 2.0, 3.01], 1)]
    got, _ = check(spark, rows, 1.0)
    assert set(got.values()) == {(500, 0)}


def test_tables_cover_the_radius():
    for bits, radius, largest in ((64, 11, 10), (64, 11, 5000), (64, 11, 10**6), (64, 9, 10**9), (8, 3, 100)):
        cut = itq.tables(bits, radius, largest, 32)
        assert sum(length for _, length, _ in cut) == bits
        # Even spread over the tables stays one below the flips plus one in every table.
        assert sum(flips + 1 for _, _, flips in cut) >= radius + 1
