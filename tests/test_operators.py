import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyard.operators import compaction, delivery, flatten
from tallyard.operators.ordering import mid_ranks, numbered
from tallyard.operators.quality import one_to_one


def call(model, rid, **more):
    return json.dumps({"request_model": model, "response": {"id": rid, "text": 'a "}" {'}, **more})


BODIES = {
    "one": (call("m", "1"), [("m", "1")]),
    "bom and blank": ("﻿  " + call("m", "2") + "\r\n", [("m", "2")]),
    "two joined": (call("m", "3") + call("n", "3"), [("m", "3"), ("n", "3")]),
    "array": ("[" + call("m", "4") + ",\n" + call("m", "5"), [("m", "4"), ("m", "5")]),
    "unfinished": (call("m", "6")[:-1], []),
    "unfinished, then whole": (call("m", "7")[:30] + "\n" + call("m", "8"), [("m", "8")]),
    "wrapper": (json.dumps({"calls": [json.loads(call("m", "9"))]}), [("m", "9")]),
    "no response": ('{"request_model": "m", "error": {"id": "x"}}', []),
    "inside a string": (json.dumps({"note": call("m", "10")}), []),
    "separators": ('{"request_model": "m", "response": {"id": "11"}}\x1e\x1b', [("m", "11")]),
    "empty": ("", []), "null literal": ("null", []), "id not a string": ('{"request_model": "m", "response": {"id": null}}', []),
    "same again": (call("m", "1", archived_by="retry"), [("m", "1")]),
}


def test_scanner_finds_complete_calls():
    for name, (body, want) in BODIES.items():
        assert sorted(compaction.calls_in(body)) == sorted(want), name


def test_compaction_keeps_every_byte_and_call(spark):
    rows = [(k, b) for k, (b, _) in BODIES.items()] + [("null", None), ("long", call("m", "12", pad="x" * 300_000))]
    records, path = compaction.compact(spark.createDataFrame(rows, "file_path string, body string").repartition(5), target_bytes=100_000)
    kept = [r["payload"] for r in records.collect()]
    assert sorted(kept) == sorted((b.removeprefix("﻿") for _, b in rows if b is not None))
    want = {c for _, (_, cs) in BODIES.items() for c in cs} | {("m", "12")}
    got = compaction.distinct_calls(records)
    assert {(r[0], r[1]) for r in got.select("request_model", "response_id").collect()} == want
    assert got.count() == len(want)


def test_compaction_of_nothing(spark):
    records, _ = compaction.compact(spark.createDataFrame([], "body string"))
    assert records.count() == 0 and compaction.distinct_calls(records).count() == 0


NESTED = "id bigint, `a` string, r struct<name:string, xs:array<struct<index:int, a:string, ys:array<struct<v:double>>>>, tags:array<string>, m:map<string,int>>"


def nested(spark):
    return spark.createDataFrame(
        [
            (1, "p", ("n", [(5, "q", [(1.0,), (2.0,)]), (None, None, None), None], ["t", None], {"k": 1})),
            (2, None, ("o", [], None, None)),
            (3, "r", None),
            (None, "s", ("u", [(0, "z", [])], [], {})),
        ],
        NESTED,
    )


def test_flat_tables_keep_parents(spark):
    t = flatten.shred(nested(spark), ["id"], {"r.xs": "index"})
    assert sorted(t) == ["", "r.m", "r.tags", "r.xs", "r.xs.ys"]
    assert t[""].count() == 4
    xs = [tuple(r) for r in t["r.xs"].select("id", "`r.xs#`", "a").collect()]
    assert sorted(xs, key=str) == sorted([(1, 5, "q"), (1, 1, None), (1, 2, None), (None, 0, "z")], key=str)
    assert [tuple(r) for r in t["r.xs.ys"].collect()] == [(1, 5, 0, 1.0), (1, 5, 1, 2.0)]
    assert sorted(r["value"] or "" for r in t["r.tags"].collect()) == ["", "t"]
    assert [tuple(r) for r in t["r.m"].collect()] == [(1, 0, "k", 1)]


def test_triples_pivot_to_the_tables(spark):
    df = nested(spark).where("id is not null")
    long = flatten.triples(df, ["id"], {"r.xs": "index"})
    for path, t in flatten.shred(df, ["id"], {"r.xs": "index"}).items():
        leaves = [c for c in t.columns if c != "id" and not c.endswith("#")]
        wide = long.where(F.col("group") == path).groupBy("id", "ordinals").pivot("path", leaves).agg(F.first("value"))
        got = sorted(str(tuple(r)[2:]) for r in wide.collect())
        want = sorted(str(tuple(r)) for r in t.select(*[F.col(f"`{c}`").cast("string") for c in leaves]).collect())
        assert got == want, path


def test_names_that_clash_are_told_apart(spark):
    df = spark.createDataFrame([(1, (2, [(3,)]))], "id bigint, r struct<id:bigint, xs:array<struct<id:bigint>>>")
    assert flatten.unnest(df, ["id"], "r.xs").columns == ["id", "r.xs#", "id_"]


def test_latest_ok(spark):
    rows = [(1, "c", "a", True, "x"), (2, "c", "a", False, "y"), (3, "c", "b", None, "z"), (4, "c", "b", False, "z"), (5, None, None, True, "n"), (4, "c", "b", False, "z"), (None, "c", "d", False, "w")]
    log = spark.createDataFrame(rows, "record_no bigint, cond string, item_id string, ok boolean, __kept string")
    for payload in (["record_no"], None):
        kept = delivery.latest_ok(log, ["cond", "item_id"], payload=payload).collect()
        assert sorted([r["record_no"] for r in kept], key=str) == sorted([1, 4, 5, None], key=str)
    assert delivery.latest_ok(log.limit(0), ["cond", "item_id"], payload=["record_no"]).count() == 0


def test_hot_identifier_is_reduced_before_the_shuffle(spark):
    log = spark.range(0, 20000, 1, 8).selectExpr("id as record_no", "'c' as cond", "if(id % 3 = 0, 'hot', cast(id as string)) as item_id", "id % 2 = 0 as ok")
    kept = delivery.latest_ok(log, ["cond", "item_id"], payload=["record_no"])
    assert kept.where("record_no = 19998").count() == 1
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "SortAggregate" not in plan


def test_numbering_and_mid_ranks(spark):
    rng = random.Random(1)
    vals = [(rng.choice("ab"), rng.randrange(40)) for _ in range(500)]
    df = spark.createDataFrame(vals, "g string, v int")
    places = [r["n"] for r in numbered(df, ["g", "v"], "n").orderBy("n").collect()]
    assert places == list(range(1, 501))
    got = {(r["g"], r["v"]): r["mid"] for r in mid_ranks(df, "v", ["g"]).collect()}
    p = pd.DataFrame(vals, columns=["g", "v"])
    p["mid"] = p.groupby("g")["v"].rank()
    assert got == {(r.g, r.v): r.mid for r in p.itertuples()}
    assert numbered(df.limit(0), ["v"], "n").count() == 0


def test_one_to_one_raises_on_a_repeated_key(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(1, "z")], "k int, w string")
    with pytest.raises(Exception, match="one-to-one"):
        one_to_one(a, b, ["k"]).collect()
