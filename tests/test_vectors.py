import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft import vocab
from weft.functions.vectors import cosine_distance, densify, fit_length, unit
from weft.operators import nearest, reduction
from weft.operators.nearest import Blocks, nearest_chunks
from weft.operators.reduction import components_from, components_table, fit_reduction, reduce_rows
from weft.operators import terms as term_module
from weft.operators.terms import dense_terms, document_terms, fit_vocabulary, term_statistics, text_tasks, weigh


def test_dense_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0], [2.0]), ([0.0, 0.0], [1], [1.0])],
                               "v array<double>, i array<int>, w array<double>")
    rows = df.select(unit(F.col("v")), fit_length(F.col("v"), 3), fit_length(F.col("v"), 1),
                     densify(F.col("i"), F.col("w"), 3),
                     cosine_distance(unit(F.col("v")), unit(F.col("v")))).collect()
    assert list(rows[0]) == [[0.6, 0.8], [3.0, 4.0, 0.0], [3.0], [2.0, 0.0, 0.0], 0.0]
    assert list(rows[1]) == [[0.0, 0.0], [0.0, 0.0, 0.0], [0.0], [0.0, 1.0, 0.0], 1.0]


def order_of(products, n):
    distances = np.round(1 - products, 6) + 0.0
    names = [f"c{j}" for j in range(products.shape[1])]
    return {
        i: sorted(zip(distances[i], names))[:n] for i in range(products.shape[0])
    }


def as_found(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["hit_rank"])):
        found.setdefault(r["query_id"], []).append((r["distance"], r["chunk_id"]))
    return found


@pytest.fixture(params=[(256, 16384), (7, 33)])
def tiles(request, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_TILE", request.param[0])
    monkeypatch.setattr(nearest, "CHUNK_TILE", request.param[1])


@pytest.mark.parametrize("blocks", [Blocks(1, 1), Blocks(3, 5), None])
def test_dense_nearest(spark, blocks, tiles):
    rng = np.random.default_rng(1)
    chunks, queries = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    chunks[50:150] = chunks[50]  # a third of the chunks are copies: ties go by id
    chunks[7] = 0.0
    c = spark.createDataFrame([(f"c{j}", v.tolist()) for j, v in enumerate(chunks)], "chunk_id string, vector array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id int, vector array<float>")

    def units(m):
        m = m.astype(np.float32).astype(np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    rows = nearest_chunks(q, c, 25, sparse=False, blocks=blocks).collect()
    assert as_found(rows) == order_of(units(queries) @ units(chunks).T, 25)


def sparse_rows(rng, count, terms, hot):
    rows = []
    for _ in range(count):
        ids = sorted(set(rng.choice(terms, size=rng.integers(0, 6)).tolist()) | ({0} if rng.random() < hot else set()))
        weights = rng.random(len(ids)) + 0.1
        rows.append((ids, (weights / max(np.linalg.norm(weights), 1e-9)).tolist()))
    return rows


@pytest.mark.parametrize("blocks", [Blocks(1, 1), Blocks(2, 7)])
def test_sparse_nearest(spark, blocks, tiles):
    rng = np.random.default_rng(2)
    chunks, queries = sparse_rows(rng, 400, 30, 0.4), sparse_rows(rng, 30, 30, 0.4)
    dense = lambda rows: np.array([np.bincount(i, w, 30) if i else np.zeros(30) for i, w in rows])
    schema = "ids array<int>, weights array<double>"
    c = spark.createDataFrame([(f"c{j}", *r) for j, r in enumerate(chunks)], f"chunk_id string, {schema}")
    q = spark.createDataFrame([(i, *r, 5 + i) for i, r in enumerate(queries)], f"query_id int, {schema}, own int")
    expected = order_of(dense(queries) @ dense(chunks).T, 100)
    assert as_found(nearest_chunks(q, c, 100, sparse=True, blocks=blocks).collect()) == expected
    own = as_found(nearest_chunks(q, c, 100, sparse=True, own_n="own", blocks=blocks).collect())
    assert own == {i: hits[: 5 + i] for i, hits in expected.items()}


def test_nearest_edges(spark):
    schema = "ids array<int>, weights array<double>"
    c = spark.createDataFrame([("a", [1], [1.0])], f"chunk_id string, {schema}")
    q = spark.createDataFrame([(1, [], [])], f"query_id int, {schema}")
    assert [tuple(r) for r in nearest_chunks(q, c, 9, True).collect()] == [(1, "a", 1.0, 1)]
    assert nearest_chunks(q, c.limit(0), 9, True).count() == 0
    assert nearest_chunks(q.limit(0), c, 9, True).count() == 0


def test_block_plan():
    assert Blocks.plan(10, 10, 8) == Blocks(1, 1)
    assert Blocks.plan(3000, 60000, 8) == Blocks(4, 4)
    big = Blocks.plan(10**6, 10**9, 4000)
    assert 10**6 / big.queries <= 32768 and 10**9 / big.chunks <= 131072


def tfidf(texts, stop, limit):
    """Unit TF-IDF rows by hand: dict per text, term -> weight."""
    import re

    bags = []
    for text in texts:
        words = [w for w in re.findall(r"\b\w\w+\b", (text or "").lower()) if w not in stop]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        bags.append({t: terms.count(t) for t in terms})
    total = {}
    for bag in bags:
        for t, n in bag.items():
            total[t] = total.get(t, 0) + n
    kept = sorted(total, key=lambda t: (-total[t], t))[:limit]
    idf = {t: math.log((1 + len(texts)) / (1 + sum(t in b for b in bags))) + 1 for t in kept}
    rows = []
    for bag in bags:
        row = {t: (1 + math.log(n)) * idf[t] for t, n in bag.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in row.values()))
        rows.append({kept.index(t): w / norm for t, w in row.items()})
    return kept, rows


TEXTS = ["The blue cotton shirt, blue!", "a red SHIRT of cotton", "été chic, chic chic", "", None, "of the",
         "wool coat for winter and wool scarf"]


@pytest.mark.parametrize("limit", [1000, 7])
def test_term_weights(spark, limit):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    stop = ("the", "of", "for", "and")
    vocabulary = fit_vocabulary(df, "k", "t", limit, stop)
    kept, rows = tfidf(TEXTS, stop, limit)
    assert [r["term"] for r in vocabulary.orderBy("term_id").collect()] == kept
    got = {r["k"]: dict(zip(r["ids"], r["weights"])) for r in weigh(df, "k", "t", vocabulary, stop).collect()}
    assert got.keys() == set(range(len(TEXTS)))
    for i, row in enumerate(rows):
        assert got[i] == pytest.approx(row)


def test_default_stop_words_are_few():
    assert len(set(vocab.TERM_STOP_WORDS)) == len(vocab.TERM_STOP_WORDS) < 200


def test_reduction_matches_exact_svd(spark):
    rng = np.random.default_rng(3)
    matrix = np.zeros((200, 40))
    for row in matrix:
        row[rng.choice(40, 6, replace=False)] = rng.random(6)
    matrix[5] = 0
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    rows = spark.createDataFrame(
        [(i, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(matrix)],
        "k int, ids array<int>, weights array<double>",
    ).repartition(5)
    made = fit_reduction(rows, 40, 200, length=10, iterations=30)
    exact = np.linalg.svd(matrix, full_matrices=False)[2][:10].T
    assert made.shape == (40, 10)
    assert np.allclose(np.abs((made * exact).sum(axis=0)), 1, atol=1e-4)
    table = components_table(spark, made)
    assert np.allclose(components_from(table), made)
    got = {r["k"]: np.array(r["vector"]) for r in reduce_rows(rows, made, "k").collect()}
    assert np.allclose(np.linalg.norm(got[0]), 1, atol=1e-5) and not got[5].any()
    want = matrix @ exact
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    ours = np.array([got[i] for i in range(200)])
    assert np.allclose(ours @ ours.T, want @ want.T, atol=1e-3)


def test_too_small_to_reduce(spark):
    df = spark.createDataFrame([(1, "blue cotton shirt")], "k int, t string")
    vocabulary = fit_vocabulary(df, "k", "t")
    rows = weigh(df, "k", "t", vocabulary)
    assert fit_reduction(rows, vocabulary.count(), 1) is None
    assert components_from(components_table(spark, None)) is None
    vector = dense_terms(rows).first()["vector"]
    assert len(vector) == 384 and np.linalg.norm(vector) == pytest.approx(1, abs=1e-6)
    assert len(dense_terms(rows, 2).first()["vector"]) == 2


def test_one_large_limit_leaves_other_queries_as_they_are(spark):
    chunks = [(f"c{k:03d}", [k % 7, 10 + k % 5], [0.6, 0.8]) for k in range(200)]
    c = spark.createDataFrame(chunks, "chunk_id string, ids array<int>, weights array<double>")
    rows = [(k, [k % 7, 10], [0.6, 0.8], 3) for k in range(20)]
    kinds = "query_id int, ids array<int>, weights array<double>, own long"
    plain = nearest_chunks(spark.createDataFrame(rows, kinds), c, 3, sparse=True, own_n="own", blocks=Blocks(2, 3)).collect()
    most = 25 * (2**31 - 1)
    more = [*rows, (99, [1, 11], [0.6, 0.8], most), (100, [1, 11], [0.6, 0.8], 0), (101, [1, 11], [0.6, 0.8], None)]
    found = nearest_chunks(spark.createDataFrame(more, kinds), c, most, sparse=True, own_n="own", blocks=Blocks(2, 3))
    both = found.collect()
    assert sorted(r for r in both if r["query_id"] < 99) == sorted(plain)
    assert sum(r["query_id"] == 99 for r in both) == 200 and not any(r["query_id"] > 99 for r in both)


@pytest.mark.parametrize("sparse", [False, True])
def test_a_table_searched_for_itself(spark, sparse):
    """Both sides come from the same columns of one table, as in ``nearest_vectors``."""
    v = [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]]
    rows = spark.createDataFrame(
        [(i, x, [0, 1], x) for i, x in enumerate(v)], "vec_id int, vector array<double>, ids array<int>, weights array<double>"
    )
    both = rows.select(
        F.col("vec_id").alias("query_id"), F.col("vec_id").alias("chunk_id"),
        *(["ids", "weights"] if sparse else ["vector"]),
    )
    found = as_found(nearest_chunks(both, both, 2, sparse, blocks=Blocks(2, 2)).collect())
    assert found == {0: [(0.0, 0), (0.2, 1)], 1: [(0.0, 1), (0.2, 0)], 2: [(0.0, 2), (0.4, 1)]}


def test_tasks_grow_with_the_texts(spark, monkeypatch):
    """More text makes more tasks, and the counts stay those of one task; keys may repeat or be null."""
    rows = [(i % 40, f"red shirt number{i} and blue shirt") for i in range(60)] + [(None, "red shirt"), (99, None), (98, "")]
    df = spark.createDataFrame(rows, "k int, t string")

    def counts():
        tasks = text_tasks(df, "t")
        made = term_statistics(document_terms(df, "k", "t", (), tasks), tasks)
        return tasks, made.rdd.getNumPartitions(), {r["term"]: (r["total"], r["documents"]) for r in made.collect()}

    few = counts()
    monkeypatch.setattr(term_module, "TASK_BYTES", 64)
    monkeypatch.setattr(term_module, "MERGE_TASKS", 2)
    many = counts()
    assert few[2] == many[2] and few[0] == 8 and many[0] > 20 and many[1] == many[0]
    assert many[2]["red shirt"] == (61, 41) and many[2]["number3"] == (1, 1)
    vocabulary = fit_vocabulary(df, "k", "t", 4, ())
    assert [r["term"] for r in vocabulary.orderBy("term_id").collect()] == ["shirt", "red", "red shirt", "and"]
    weighed = weigh(df, "k", "t", vocabulary, ()).collect()
    assert len(weighed) == 43 and {r["k"]: r["ids"] for r in weighed}[99] == []


def test_batches_multiply_alike_over_their_own_terms(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(40, n, replace=False).tolist()) for n in (3, 0, 5, 1)]
    batch = pa.RecordBatch.from_pydict({"ids": rows, "weights": [[1.0 + i for i in r] for r in rows]})
    basis = rng.normal(size=(40, 6))
    terms, dense = reduction._own_terms(batch)
    assert list(terms) == sorted(set(sum(rows, []))) and dense.sum() == sum(1.0 + i for r in rows for i in r)
    near = reduction._project(batch, basis)
    monkeypatch.setattr(reduction, "DENSE_SHARE", 0)
    assert reduction._own_terms(batch) is None
    assert np.allclose(near, reduction._project(batch, basis), atol=1e-12)


@pytest.mark.parametrize("own", [None, "own"])
def test_dense_chunks_beside_few_queries(spark, monkeypatch, own):
    """Many chunks are read where they lie: the same hits, ties by id, and no chunk is dealt."""
    rng = np.random.default_rng(5)
    chunks, queries = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    chunks[50:150] = chunks[50]
    chunks[7] = queries[3] = 0.0
    order = rng.permutation(300)
    c = spark.createDataFrame([(f"c{j}", chunks[j].tolist()) for j in order], "chunk_id string, vector array<float>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist(), i % 30) for i, v in enumerate(queries)], "query_id int, vector array<double>, own int")
    dealt = as_found(nearest_chunks(q, c, 25, False, own_n=own, blocks=Blocks(3, 5)).collect())
    monkeypatch.setattr(nearest, "MOST_CHUNKS_PER_BLOCK", 100)
    monkeypatch.setattr(nearest, "CHUNK_TILE", 33)
    monkeypatch.setattr(nearest, "QUERY_TILE", 7)
    monkeypatch.setattr(nearest, "ROWS_PASSED_ON", 40)
    found = nearest_chunks(q, c, 25, False, own_n=own)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    assert as_found(found.collect()) == dealt
    monkeypatch.setattr(nearest, "QUERY_BYTES", 100)
    many = nearest_chunks(q, c, 25, False, own_n=own)
    assert "CoGroup" in many._jdf.queryExecution().executedPlan().toString()
    assert as_found(many.collect()) == dealt


def test_products_with_the_basis_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(*r,) for r in sparse_rows(rng, 200, 4000, 0.5)] + [(sorted(rng.choice(4000, 300, replace=False).tolist()), [0.5] * 300)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["ids", "weights"]
    )
    basis = rng.normal(size=(4000, 5))
    whole = reduction._project(batch, basis)
    monkeypatch.setattr(reduction, "ENTRIES_AT_ONCE", 40)
    parts = list(reduction._pieces(batch))
    assert sum(p.num_rows for p in parts) == 201 and all(p.num_rows == 1 or len(reduction._rows(p)[1]) <= 40 for p in parts)
    assert np.allclose(reduction._project(batch, basis), whole)
    assert np.allclose(whole, [np.asarray(w) @ basis[i] if i else np.zeros(5) for i, w in rows])


def test_rows_keep_their_weights_beside_them(spark, monkeypatch):
    """``weigh_rows`` is the join with ``weigh``: repeated keys share their weights, rows without a key join nothing."""
    texts = ["blue jeans", "blue shirt", "red jeans for men", None, "", "denim"]
    rows = [(f"k{i % 23}" if i % 11 else None, i, texts[i % 6], (i, f"m{i}")) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, n int, t string, meta struct<a:int,b:string>").repartition(4)
    vocabulary = fit_vocabulary(df, "k", "t")
    monkeypatch.setattr(term_module, "BATCH_ROWS", 7)
    made = term_module.weigh_rows(df, "k", "t", vocabulary)
    assert made.columns == ["k", "n", "t", "meta", "ids", "weights", "first"]
    joined = df.join(weigh(df, "k", "t", vocabulary), "k")
    assert sorted(map(repr, made.drop("first").collect())) == sorted(map(repr, joined.collect()))
    firsts = [r["k"] for r in made.filter("first").collect()]
    assert sorted(firsts) == sorted({r[0] for r in rows if r[0] is not None})


def test_the_reduction_leaves_no_sums_on_disk(spark):
    """Passes over few rows take one task, and neither shuffles nor tables of the sums stay."""
    import glob

    from weft.session import checkpoint_folder

    rng = np.random.default_rng(8)
    rows = spark.createDataFrame(sparse_rows(rng, 60, 30, 0.5), "ids array<int>, weights array<double>").repartition(6)
    sums = f"{checkpoint_folder(spark).removeprefix('file:')}/weft/gram-*"
    before = set(glob.glob(sums))
    made = fit_reduction(rows, 30, 60, length=4, iterations=20)
    dense = np.array([np.bincount(r["ids"], r["weights"], 30) if r["ids"] else np.zeros(30) for r in rows.collect()])
    assert np.allclose(np.abs(made.T @ np.linalg.svd(dense)[2][:4].T), np.eye(4), atol=1e-4)
    assert set(glob.glob(sums)) <= before
