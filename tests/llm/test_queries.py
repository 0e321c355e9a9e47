"""Registered queries against their SQL, and the pipeline against its stages' brute force."""

import collections
import os
import random
import re

import duckdb
import pytest

import corpus_pipeline
from larderflow.llm import queries

from .conftest import DOCS, corpus, frame, odd_rows, word
from .test_docs import brute_groups, brute_perplexity, train_ids

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels")


def test_one_query_for_each_operator():
    assert sorted(int(m[1]) for n in queries.queries() if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    want = sorted(map(repr, r.fetchall()))
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(x) for x in df.select(*cols).collect()))) == want


@pytest.fixture(scope="module")
def folder(spark, labels, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    key = "token = 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = corpus(60, 1) + [r for r in odd_rows() if r[0] is not None] + [(2000, f"{corpus(1, 77)[0][1]} {key} " + "thing on the other " * 3, "en", "hot", 1)]
    frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return d


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing", "packing"]
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, at, folder)
        assert out.columns == names
        path = f"{folder}/stage{k}"
        out.write.parquet(path)
        before, after = at.collect(), spark.read.parquet(path).collect()
        if k == 0:
            # what goes has no words or is above its ceiling
            known = brute_perplexity([(r["doc_id"], r["text"]) for r in before], train_ids(labels))
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            assert {1000, 1001, 1002} <= gone
            assert all(i not in known or max(known[i]) > min(max(v) for v in known.values()) for i in gone)
            assert len(gone) <= 3 + 0.05 * len(before)
        elif k == 1:
            groups = brute_groups([(r["doc_id"], r["text"]) for r in before], 2, 0.6)
            drop = {i for i, g, *_ in groups if i != g}
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - drop and drop
            assert max(collections.Counter(r["doc_id"] for r in after).values()) == 1
        elif k == 2:
            a, b = {r["doc_id"]: r for r in before}, {r["doc_id"]: r for r in after}
            assert a.keys() == b.keys()
            assert {i for i in a if a[i]["text"] != b[i]["text"]} == {2000}
            assert "<secret>" in b[2000]["text"] and b[2000]["n_chars"] == len(b[2000]["text"])
        else:
            assert sorted(map(repr, before)) == sorted(map(repr, after))
        at = spark.read.parquet(path)
    windows = corpus_pipeline.STAGES[4][1](spark, at, folder)
    want = {r["doc_id"]: len(re.findall(rb"[0-9A-Za-z_\x80-\xff]+", r["text"].encode())) for r in at.collect()}
    got = collections.Counter()
    for r in windows.collect():
        got[r["doc_id"]] += r["n_tokens"]
    assert got == want
    assert sorted(map(repr, corpus_pipeline.run(spark, folder).collect())) == sorted(map(repr, windows.collect()))


def test_weights_reach_the_windows(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    rows = [(i, " ".join(word(r) + str(r.randint(0, 99)) for _ in range(120)), "en", "ab"[i % 2], 1) for i in range(200)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for first in (0, 1):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", {"ab"[first]: 9, "ba"[first]: 1})
        at = sorted((x["window_id"], x["pos"], x["doc_id"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect() if x["doc_from"] == 0)
        assert sorted(i for *_, i in at) == list(range(200))
        # nine in ten of the first half are of the heavy source, give or take a block of the schedule and a path's documents
        assert 80 <= sum(i % 2 == first for *_, i in at[:100]) <= 98
        source = [i % 2 for *_, i in at]
        assert sum(a == b for a, b in zip(source, source[1:])) > 120  # related documents of a source follow each other


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
