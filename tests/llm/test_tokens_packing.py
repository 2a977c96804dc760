import random

import numpy as np
import pytest
from compare import connect, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyard.llm import packing, queries, tokens

TEXTS = [
    "Hello world", "", None, " ", "  two  blanks \n\n new ", "<|endoftext|> and <|startoftext|>", "naïve café — 数字 १२३ 🙂🙂", "don't we'll I'M 3.14159", "a" * 5000,
    "tab\tnbsp\xa0em end", "​﻿", "Hello world", "x\r\ny", "ab" * 300 + " tail",
]


def direct():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode_batch([x or ""], add_special_tokens=False)[0].ids


def docs(spark):
    rows = [(i, x, "clash", 7) for i, x in enumerate(TEXTS)] + [(None, "no id", "clash", 7), (3, " ", "clash", 7)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, block string, ids int").repartition(3)


@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_encoding_equals_the_tokenizer(spark, block_bytes):
    enc, got = direct(), {}
    rows = tokens.encode(docs(spark), block_bytes=block_bytes).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = enc("no id" if r["doc_id"] is None else TEXTS[r["doc_id"]])
        assert list(r["ids"]) == want
        got[r["doc_id"]] = len(want)
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs(spark), block_bytes=block_bytes).collect()}
    assert counts == got


def test_no_task_has_a_frequent_word_to_itself(spark):
    rows = [(i, f"the same words stand here, and number{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    documents, held = tokens.split(df, "doc_id", "text", 64)
    known = tokens.encoded_words(held, f"{tokens.TOKENIZERS}/byte_bpe_50k.json", lengths=False)
    assert known.count() == known.select("word").distinct().count() == held.select("word").distinct().count()
    assert held.groupBy("word").count().agg(F.max("count")).first()[0] > 100  # a word in most blocks
    plan = tokens.returned(held, known, hot_words=50, hot_rows=10)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan
    enc = direct()
    table = tokens.returned(held, known, hot_words=50, hot_rows=10)
    for r in tokens._reassembled(documents, table, df.schema["doc_id"].dataType, False).collect():
        assert list(r["ids"]) == enc(rows[r["id"]][1])


def test_decoding_is_the_inverse(spark):
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(docs(spark))).collect()}
    for i, t in enumerate(TEXTS):
        assert back[i] == (t or "")


def test_empty_table(spark):
    none = docs(spark).limit(0)
    assert tokens.encode(none).count() == 0
    assert packing.pack(tokens.token_counts(none)).count() == 0


def test_every_document_equals_the_tokenizer(spark, sf):
    enc = direct()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.p7_ids(spark, sf).collect():
        assert list(r["ids"]) == enc(text[r["doc_id"]])


def test_decoded_query_equals_sql(spark, sf):
    same(queries.p7_decoded(spark, sf), connect(sf), queries.SQL["p7_decoded"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_best_fit_and_its_bound(sizes):
    s = np.array(sizes, dtype="int64")
    bins = packing.best_fit_decreasing(s, 50)
    bound = packing.lower_bound(np.bincount(s, minlength=51), 50)
    if len(s):
        assert np.bincount(bins, weights=s).max() <= 50
        used = bins.max() + 1
        assert bound <= used or s.sum() == 0
        assert used <= 11 / 9 * max(bound, 1) + 6


def test_bound_sees_large_items():
    counts = np.zeros(101, dtype="int64")
    counts[51], counts[34] = 10, 3
    assert packing.lower_bound(counts, 100) >= 10


@pytest.mark.parametrize("per_partition", [20, 5000])
def test_packing_is_whole_and_tight(spark, per_partition):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 3, 17, 250, 400, 511, 700, 1023, 1024, 1025, 5000])) for i in range(400)] + [(None, 10), (7, 10), (7, 10), (500, None)]
    items = spark.createDataFrame(rows, "doc_id bigint, n_tokens int").repartition(4)
    got = packing.pack(items, per_partition=per_partition).toPandas()
    fill = got.groupby("container_id").n_tokens.sum()
    assert fill.max() <= 1024
    assert got.n_tokens.sum() == sum(n or 0 for _, n in rows)
    pieces = got.groupby("doc_id", dropna=False).size()
    assert all(pieces[i] == max(1, -(-n // 1024)) for i, n in rows[:400] if i != 7)
    assert pieces[7] == max(1, -(-rows[7][1] // 1024)) + 2 and got.doc_id.isna().sum() == 1
    cert = packing.certificate(spark.createDataFrame(got)).first()
    assert cert["lower_bound"] <= cert["containers"] <= cert["lower_bound"] * 1.02 + 1
    long = got[got.doc_id.isin([i for i, n in rows[:400] if n == 5000])]
    assert (long.groupby(["doc_id", "piece_no"]).first_token.first() == long.groupby(["doc_id", "piece_no"]).piece_no.first() * 1024).all()


def test_documents_are_packed_near_the_bound(spark, sf):
    c = queries.p8_certificate(spark, sf).first()
    assert c["containers"] <= c["lower_bound"] + 1
    assert queries.p8_containers(spark, sf).select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.p8_containers(spark, sf).groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where("n > 1024").count() == 0
