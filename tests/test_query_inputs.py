"""Queries against their SQL, and operators against plain versions, on small tables that hold what the driver's smallest do not."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from clausegrid import catalog
from clausegrid.functions import vectors
from clausegrid.operators import semantic


def shown(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    return str(value)


@pytest.fixture
def same(spark, tmp_path):
    """same(name, table=(rows, schema), …): the query's rows, which have to be those of its SQL on these tables."""
    def check(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = catalog.queries()[name](spark, str(tmp_path))
        run = con.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in run.description]
        got, want = (sorted(tuple(shown(r[at]) for at in order) for r in rows) for rows, order in ((df.collect(), names), (run.fetchall(), range(len(names)))))
        assert sorted(df.columns) == sorted(names) and got == want
        return [dict(zip(names, r)) for r in got]

    return check


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_amounts_are_not_cut_before_letters(same):
    texts = ["key cad463aef45", "cad5b7 and cad60f0d", "$5kg or $7k2", "USD 12 million, $3 millionaires", "a $2.5m and $9B bid", "CAD$ 40K_x"]
    rows = same("q_features_dollars", documents=([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), part=([(1, "red nut", "Brand#1", "LARGE", 3, 901.0)], PART))
    found = {r["key"]: (int(r["dollar_min"]), int(r["dollar_max"])) for r in rows}
    assert found["d0"] == (463, 463) and found["d1"] == (5, 60) and found["d2"] == (5, 7) and found["d3"] == (3, 12_000_000) and found["d4"] == (2_500_000, 9_000_000_000)


def test_rules_that_move_to_a_taken_id(same):
    rows = [(7, "red nut", "Brand#1", "LARGE", 30, 907.0), (1_000_007, "hot bolt", "Brand#2", "SMALL", 3, 901.0), (35, "tin cap", "Brand#3", "LARGE", 30, 935.0), (1_000_035, "blue ring", "Brand#4", "SMALL", 3, 902.0), (14, "a", None, "b", 40, 1.0)]
    found = same("q_ruleset_diff", part=(rows, PART))
    assert [(r["change"], r["fields"]) for r in found if r["rule_id"] == "R-1000007"] == [("unchanged", ""), ("unchanged", "")]
    assert [(r["change"], r["fields"]) for r in found if r["rule_id"] == "R-1000035"] == [("changed", "severity"), ("changed", "severity,gate_threshold")]


def test_hash_vector_works_its_digests_out_once(spark):
    df = spark.createDataFrame([("word " * 2000,), ("",), (None,)], "text string").select(vectors.hash_vector(F.col("text")).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 2  # not one for each use in the lambdas
    for text, v in zip(("word " * 2000, "", ""), (r["v"] for r in df.collect())):
        first = hashlib.sha256(text.encode()).digest()
        lanes = [int.from_bytes(raw[k:k + 2], signed=True) / 32767.0 for raw in (first, hashlib.sha256(first).digest()) for k in range(0, 32, 2)]
        norm = sum(x * x for x in lanes) ** 0.5
        assert len(v) == 32 and v == pytest.approx([x / norm for x in lanes], abs=1e-12)


ODD = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [1.0, 2.0, 3.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, [1.0, None, 2.0]), (7, [1.0, 2.0]), (8, []), (9, [float("nan"), 1.0, 0.0]),
       (10, [-1.0, -2.0, -3.0]), (11, [3.0, -1.0, 0.5]), (12, [0.5, 0.25, 8.0]), (13, [1.0, None, 2.0]), (14, [7.0, 1.0]), (15, [1.0, 2.0, 3.0])]


def by_expression(queries, items):
    pairs = items.crossJoin(queries.withColumnRenamed("embedding", "q"))
    return {(r["query_id"], r["item_id"]): r["c"] for r in pairs.select("query_id", "item_id", vectors.cosine(F.col("q"), F.col("embedding")).alias("c")).collect()}


@pytest.mark.parametrize("tile, held", [((256, 2048), 1 << 18), ((2, 4), 20)])
def test_vectors_of_every_kind(spark, monkeypatch, tile, held):
    monkeypatch.setattr(semantic, "_TILE", tile)
    monkeypatch.setattr(semantic, "_HELD", held)
    items = spark.createDataFrame(ODD, "item_id long, embedding array<float>").repartition(2)
    queries = items.withColumnRenamed("item_id", "query_id")
    all_pairs = by_expression(queries, items)
    got = {(r["query_id"], r["item_id"]): r["similarity"] for r in semantic.similarities(queries, items, 6).collect()}
    assert got.keys() == all_pairs.keys()
    for pair, c in all_pairs.items():
        assert shown(got[pair]) == shown(c if c is None or c != c else round(c, 6) + 0.0) or (c == 0 and got[pair] == 0), pair
    # NaN above all numbers, null below; equal directions tie by id
    rank = lambda c: (2, 0) if c is None else (0, 0) if c != c else (1, -round(c, 12))
    want = {(q, i, n) for q, _ in ODD for n, (_, i) in enumerate(sorted((rank(all_pairs[q, i]), i) for i, _ in ODD)[:4], 1)}
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in semantic.top_k(queries, items, 4).collect()} == want


def test_pairs_are_products_of_matrices_on_all_cores(spark, tmp_path, same):
    rows = [(k, [((k * 37 + j * 11) % 23 - 11) / 7.0 for j in range(16)]) for k in range(0, 300)]
    for name in ("q_cosine", "q_semantic_topk"):
        same(name, embeddings=(rows, "vec_id long, embedding array<float>"))
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        df = catalog.queries()[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "BroadcastNestedLoopJoin" not in plan and "RoundRobinPartitioning(4)" in plan
