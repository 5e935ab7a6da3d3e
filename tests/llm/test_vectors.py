"""The operators on embeddings against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from millrace.llm.near_vectors import near_vectors
from millrace.llm.topk import top_k

from .conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, n string, id string"


def odd_vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    near = base + 0.02 * rng.normal(size=8)
    nan, inf = float("nan"), float("inf")
    return [
        (4, base.tolist()),
        (2, base.tolist()),
        (2, base.tolist()),
        (9, (3 * near).tolist()),
        (5, None),
        (6, [0.0] * 8),
        (7, [nan] + [1.0] * 7),
        (8, [inf] + [1.0] * 7),
        (10, [None] + [1.0] * 7),
        (None, base.tolist()),
        (11, []),
        (12, [1.0, 2.0]),
        (13, [2.0, 4.0]),
        (50, rng.normal(size=8).tolist()),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in odd_vectors()], SCHEMA)


def test_near_vectors_of_odd_rows(spark, odd):
    found = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(odd).collect()}
    alone = {(i, 0, i, True) for i in (5, 6, 7, 8, 10, 11, 50)}
    assert found == alone | {
        (2, 2, 2, True),
        (4, 2, 2, False),
        (9, 2, 2, False),
        (12, 1, 12, True),
        (13, 1, 12, False),
        (None, None, None, False),
    }
    assert near_vectors(odd).count() == len(odd_vectors())
    assert near_vectors(odd.limit(0)).collect() == []


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_near_vectors_query(spark, folder):
    found = queries()["op6_embedding_near_dedup"](spark, folder).toPandas().sort_values("vec_id")
    given = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().sort_values("vec_id")
    unit = np.stack(given.embedding).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    true = linked.sum(1)
    assert (found.n_links.to_numpy() <= true).all()
    assert found.n_links.sum() >= 0.9 * true.sum()
    assert (found.kept == (found.vec_id == found.component_id)).all()
    assert (found.component_id <= found.vec_id).all()
    ids, lowest = found.vec_id.to_numpy(), found.vec_id.to_numpy().copy()
    while True:  # the smallest id that links reach
        lower = np.array([min(lowest[row].min(initial=i), i) for row, i in zip(linked, lowest)])
        if (lower == lowest).all():
            break
        lowest = lower
    if (found.n_links.to_numpy() == true).all():  # as on these tables
        assert (found.component_id.to_numpy() == lowest).all()
    assert (found.component_id.to_numpy() >= lowest).all() and len(ids) == len(given)


def plain_top(rows, k):
    known = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            known[i] = [int(np.floor(np.float32(x).astype(float) * 256)) for x in v]
    out = []
    for q, v in known.items():
        if q % 50 == 0:
            scored = sorted(
                (-sum(a * b for a, b in zip(v, w)), i) for i, w in known.items() if i != q
            )
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k_of_odd_rows(spark, odd):
    from millrace.llm.topk import usable

    terms = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    vectors = odd.filter(usable("embedding")).select(F.col("vec_id").alias("id"), terms.alias("terms"))
    found = top_k(vectors, vectors.filter("id % 50 = 0"), 5, shard_rows=3, shards_per_task=2)
    assert sorted(map(tuple, found.collect())) == plain_top(odd_vectors(), 5)
    assert top_k(vectors.limit(0), vectors.limit(0)).collect() == []
    alone = vectors.filter("id = 50")
    assert top_k(alone, alone).collect() == []


def test_top_k_ties(spark):
    vectors = spark.createDataFrame(
        [(k, [1, k % 2]) for k in range(40)], "id long, terms array<long>"
    )
    found = top_k(vectors, vectors.filter("id in (0, 1)"), 3, 8, 4, 2)
    got = sorted(map(tuple, found.collect()))
    assert got == [(0, 1, 1, 1), (0, 2, 2, 1), (0, 3, 3, 1), (1, 1, 3, 2), (1, 2, 5, 2), (1, 3, 7, 2)]


def test_top_k_of_large_components(spark):
    """Products beyond 2**53 are told apart; beyond 64 bits there is an error, not a wrong score."""
    vectors = [(1, [2**19, 1]), (2, [2**19, 0]), (3, [2**19 - 1, 2**18])]
    queries = [(100, [2**40, 1]), (200, [-(2**43), 2**20])]
    schema = "id long, terms array<long>"
    found = top_k(spark.createDataFrame(vectors, schema), spark.createDataFrame(queries, schema), 3, 2)
    expected = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors)
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    huge = spark.createDataFrame([(5, [2**62, 2**62])], schema)
    with pytest.raises(Exception, match="more than 64 bits"):
        top_k(huge, spark.createDataFrame([(100, [3, 3])], schema)).collect()


@pytest.mark.parametrize("signs", [1, -1])
def test_essential_terms_follow_the_best_score(signs):
    """Whatever the floor, nothing that reaches it is left out."""
    from millrace.llm.topk import Shard

    rng = np.random.default_rng(7)
    terms = signs * rng.integers(0 if signs == 1 else -50, 100, (300, 12))
    shard = Shard(np.arange(300), terms)
    for _ in range(40):
        query = rng.integers(-30, 100, 12)
        scores = terms @ query
        for floor in (None, int(np.sort(scores)[-3]), int(scores.max()), int(scores.max()) + 1, int(scores.min())):
            ids, found = shard.search(query, 7, 5, floor)
            assert (scores[ids] == found).all()
            others = np.delete(np.arange(300), 7)
            fifth = np.sort(scores[others])[-5]
            least = fifth if floor is None else max(floor, fifth)
            assert set(others[scores[others] >= least]) <= set(ids.tolist())


@pytest.mark.parametrize("query_rows, shards_per_task", [(1, 1), (3, 2), (100, 100)])
def test_top_k_in_tiles(spark, query_rows, shards_per_task):
    rng = np.random.default_rng(9)
    rows = [(k, rng.integers(-9, 9, 5).tolist()) for k in range(150)]
    vectors = spark.createDataFrame(rows, "id long, terms array<long>").repartition(3)
    found = top_k(vectors, vectors.filter("id % 10 = 0"), 4, 16, query_rows, shards_per_task)
    expected = []
    for q, v in rows[::10]:
        scored = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:4], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_top_k_query(spark):
    found = queries()["op9_exact_top_k"](spark, SMALL)
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    expected = plain_top([(r.vec_id, r.embedding) for r in given], 5)
    assert sorted(map(tuple, found.collect())) == expected
