"""The registered queries, their SQL where there is one, and the pipeline's stages against plain versions."""

import collections
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import VOCABULARY, WORD, base_spans, brute_near
from tidemark.llm import mixing, queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted(map(tuple, want), key=str)


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_rows(spark, sf_dir, name):
    """The digests of these are held against plain versions in test_operators; here, every row comes back once."""
    table, key = {"op1": ("conversations", "conv_id"), "op3": ("pages", "page_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    want = {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct().collect()} | ({-7} if table == "conversations" else set())
    got = [r[0] for r in queries.QUERIES[name](spark, sf_dir).select(key).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, made[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        made.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(sorted(m.columns) == sorted(docs.columns) for m in made[:-1])
    rows = [m.collect() for m in made]
    ids = [[r.doc_id for r in x] for x in rows]
    # quality: the query's verdicts
    kept = {r.doc_id for r in queries.QUERIES["op8_quality_rules"](spark, sf_dir).filter("kept").collect()}
    assert sorted(ids[1]) == sorted(kept) and 0 < len(kept) < len(ids[0])
    # near duplicates: the smallest id of each class of five-word similarity 0.8 or more among what is left
    own = brute_near([r.text or "" for r in rows[1]])
    least = {}
    for r in rows[1]:
        least[own[r.text or ""]] = min(least.get(own[r.text or ""], r.doc_id), r.doc_id)
    assert sorted(ids[2]) == sorted(least.values()) and len(ids[2]) < len(ids[1])
    # secrets: every document stays, and no pattern finds anything in it
    before = {r.doc_id: r for r in rows[2]}
    assert sorted(ids[3]) == sorted(ids[2]) and any(base_spans(r.text or "") for r in rows[2])
    for r in rows[3]:
        assert r.n_chars == (len(r.text) if r.text != before[r.doc_id].text else before[r.doc_id].n_chars)
        assert base_spans(r.text or "") == ""
    # mixing: each source near its target
    size, taken, n = collections.Counter(), collections.Counter(), lambda r: len(WORD.findall(r.text or ""))
    for r in rows[3]:
        size[r.source] += n(r)
    for r in rows[4]:
        taken[r.source] += n(r)
    longest = max(map(n, rows[3]))
    assert all(abs(taken[s] - t) <= longest for s, t in mixing.targets(size).items()) and max(collections.Counter(ids[4]).values()) == 2
    # tokens
    from tokenizers import Tokenizer

    t, body = Tokenizer.from_file(VOCABULARY), {r.doc_id: r.text or "" for r in rows[3]}
    assert sorted(ids[5]) == sorted(ids[4])
    for r in rows[5][:60]:
        own = t.encode(body[r.doc_id], add_special_tokens=False).ids
        assert r.token_ids == own and r.ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()


def test_pipeline_edges(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (3, "one two three", None, "b", 13), (3, "one two three", None, "b", 13)]
    rows += [(k, " ".join(f"w{k}x{i}" for i in range(60)) + (" token=abcdefghijkl1234" if k == 12 else ""), "en", "ab"[k % 2], 400) for k in range(10, 30)]
    folder = tmp_path / "sf"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, str(folder)).collect()
    assert got and {r.doc_id for r in got} <= set(range(10, 30))
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_dedup_edges(spark):
    """Only rows with like texts go; a null id stays if it stands alone, columns named like internal ones survive."""
    rows = [(None, "none of the others is like this one", 1), (4, "b b b", 2), (4, "b b b", 1), (4, None, 3), (5, None, 1), (6, "", 1), (7, "b b b", 0), (8, "B b b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long").withColumn("key", F.lit("x")).withColumn("__id", F.lit(1)).withColumn("a.b", F.lit("y"))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text, r.component_id) for r in got.collect()} == {(None, rows[0][1], 1), (4, "b b b", 1), (4, None, 3)}


def test_near_dedup_deals_texts_once(spark, sf_dir):
    """Rows are dealt for the join, and not again for the aggregation."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large to broadcast
    try:
        plan = corpus_pipeline.near_dedup(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"functions=\[min\(__row[^\n]*\n\W*SortAggregate[^\n]*partial_min\(__row", plan)
