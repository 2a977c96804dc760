"""Many small files into a few well-sized ones, byte for byte.

Bodies are joined as RFC 7464-style text sequences: a record separator closes
each body, bytes that would clash with it are stuffed, a byte-order mark at the
head of a body is dropped, and nothing is parsed. Whole input partitions are merged
(``coalesce``), so bodies never cross a shuffle, and the text writer's commit
protocol makes task retries safe. Lengths and checksums of what was read and of what
was written are then compared as order-free sums, without a join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyard.durable import fresh_path, materialise
from tallyard.functions.spans import object_spans
from tallyard.operators.delivery import keep_one

SEPARATOR, ESCAPE, HEADER = "\x1e", "\x1b", "\x1f"


def _stuff(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "E")), F.lit(SEPARATOR), F.lit(ESCAPE + "R"))


def _unstuff(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESCAPE + "R"), F.lit(SEPARATOR)), F.lit(ESCAPE + "E"), F.lit(ESCAPE))


def _fingerprint(payload: Column) -> list[Column]:
    return [
        F.count(payload).alias("n"),
        F.sum(F.octet_length(payload).cast("decimal(38,0)")).alias("bytes"),
        F.sum(F.xxhash64(payload).cast("decimal(38,0)")).alias("hash_sum"),
        F.bit_xor(F.crc32(payload)).alias("crc_xor"),
    ]


def compact(files: DataFrame, body: str = "body", target_bytes: int = 128 << 20, path: str | None = None, name: str | None = None) -> tuple[DataFrame, str]:
    """Write all bodies of ``files`` into files of about ``target_bytes`` and return (their records, path).

    The records have a column ``payload``, one row per non-null body. Null bodies
    hold no bytes and are left out; empty ones stay as empty records; repeated bodies
    stay repeated. With ``name`` every record is headed by that column of its file, and
    the records have a column ``name`` too, so that each leads back to where it came from
    (a null name becomes an empty one). Raises if lengths or checksums of the written files
    differ from those of the input.
    """
    spark = files.sparkSession
    path = path or fresh_path(spark, "containers")
    payload = F.regexp_replace(F.col(f"`{body}`"), "^\\uFEFF", "")
    value = _stuff(payload)
    if name is not None:
        head = F.replace(_stuff(F.coalesce(F.col(f"`{name}`"), F.lit(""))), F.lit(HEADER), F.lit(ESCAPE + "U"))
        value = F.concat(head, F.lit(HEADER), value)
    bodies = files.select(value.alias("value")).where("value is not null")
    before = bodies.select(*_fingerprint(F.col("value"))).first()
    want = max(1, ceil(int(before["bytes"] or 0) / target_bytes))
    # fewer files than tasks: whole partitions are merged; more files than tasks, as of packed input: rows are spread by hash
    sized = bodies.coalesce(want) if want <= bodies.rdd.getNumPartitions() else bodies.repartition(want, F.xxhash64("value"))
    sized.write.option("lineSep", SEPARATOR).text(path)
    written = spark.read.option("lineSep", SEPARATOR).text(path)
    after = written.select(*_fingerprint(F.col("value"))).first()
    if before != after:
        raise ValueError(f"containers differ from their sources: {before} and {after}")
    if name is None:
        return written.select(_unstuff(F.col("value")).alias("payload")), path
    cut = F.instr("value", HEADER)
    head, rest = F.expr("substring(value, 1, cut - 1)"), F.expr("substring(value, cut + 1)")
    split = written.withColumn("cut", cut)
    return split.select(_unstuff(F.replace(head, F.lit(ESCAPE + "U"), F.lit(HEADER))).alias("name"), _unstuff(rest).alias("payload")), path


def _walk(value: object) -> Iterator[tuple[str, str]]:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            model, response = v.get("request_model"), v.get("response")
            if isinstance(model, str) and isinstance(response, dict) and isinstance(response.get("id"), str):
                yield model, response["id"]
            else:
                todo.extend(v.values())
        elif isinstance(v, list):
            todo.extend(v)


def calls_in(text: str | None) -> list[tuple[str, str]]:
    """(request_model, response.id) of every complete JSON object with both, in any layout."""
    out: list[tuple[str, str]] = []
    todo = [text or ""]
    while todo:
        piece = todo.pop()
        for a, b in object_spans(piece):
            try:
                out.extend(_walk(json.loads(piece[a:b])))
            except (ValueError, RecursionError):
                todo.append(piece[a + 1 : b - 1])
    return list(dict.fromkeys(out))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("request_model", T.StringType()), T.StructField("response_id", T.StringType())])))
def _scan_calls(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: [{"request_model": m, "response_id": i} for m, i in calls_in(b)])


def calls(records: DataFrame, payload: str = "payload") -> DataFrame:
    """Every call in the records, once per record: payload, request_model, response_id.

    A payload that opens with a complete JSON object with both fields and names
    request_model once is read on the JVM; only other layouts (several calls, arrays,
    unfinished objects) go to the scanner.
    """
    v = F.try_parse_json(F.col(payload))
    one = records.withColumn("__v", v).withColumns({"request_model": F.try_variant_get("__v", "$.request_model", "string"), "response_id": F.try_variant_get("__v", "$.response.id", "string")})
    once = F.octet_length(payload) - F.octet_length(F.replace(F.col(payload), F.lit("request_model"), F.lit(""))) == len("request_model")
    whole = once & F.col("request_model").isNotNull() & F.col("response_id").isNotNull()
    found = F.when(whole, F.array(F.struct("request_model", "response_id")))
    one = one.select(payload, found.alias("__found"))
    simple = one.where("__found is not null").select(payload, F.inline("__found"))
    other = one.where("__found is null").where(F.col(payload).contains("request_model")).select(payload, F.inline(_scan_calls(F.col(payload))))
    return simple.unionByName(other)


def distinct_calls(records: DataFrame) -> DataFrame:
    """Every call exactly once, told apart by (request_model, response_id), with the smallest payload that holds it."""
    return keep_one(calls(records), ["request_model", "response_id"], [F.octet_length("payload"), F.col("payload")], ["payload"])


def call_objects(text: str | None) -> list[tuple[str, str, str]]:
    """(request_model, response.id, text) of the calls of ``calls_in``: each as its own object, character for character."""
    out: dict[tuple[str, str], str] = {}
    todo: list[tuple[str, set | None]] = [(text or "", None)]
    while todo:
        piece, among = todo.pop()
        for a, b in object_spans(piece):
            try:
                value = json.loads(piece[a:b])
                held = set(_walk(value))
            except (ValueError, RecursionError):
                todo.append((piece[a + 1 : b - 1], among))
                continue
            held = held if among is None else held & among
            if not held:
                continue
            response = value.get("response")
            key = (value.get("request_model"), response.get("id") if isinstance(response, dict) else None)
            if key in held:
                out.setdefault(key, piece[a:b])
            else:
                todo.append((piece[a + 1 : b - 1], held))
    return [(m, i, t) for (m, i), t in out.items()]


_OBJECT = T.StructType([T.StructField(n, T.StringType()) for n in ("request_model", "response_id", "call")])


@F.pandas_udf(T.ArrayType(_OBJECT))
def _scan_objects(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: [dict(zip(("request_model", "response_id", "call"), x)) for x in call_objects(b)])


def write_calls(records: DataFrame, target_bytes: int = 128 << 20, path: str | None = None) -> tuple[DataFrame, str]:
    """Write every call of ``records`` (column payload) exactly once into files of about ``target_bytes``; return (calls, path).

    The calls have request_model, response_id and call, the object itself without what
    surrounds it in its file. Raises if keys or bytes of the written files differ.
    """
    spark = records.sparkSession
    path = path or fresh_path(spark, "calls")
    found = records.where(F.col("payload").contains("request_model")).select(F.inline(_scan_objects("payload")))
    once = materialise(keep_one(found, ["request_model", "response_id"], [F.octet_length("call"), F.col("call")], ["call"]), "once")
    value = once.select(_stuff(F.col("call")).alias("value"))
    before = value.select(*_fingerprint(F.col("value"))).first()
    value.coalesce(max(1, ceil(int(before["bytes"] or 0) / target_bytes))).write.option("lineSep", SEPARATOR).text(path)
    written = spark.read.option("lineSep", SEPARATOR).text(path)
    after = written.select(*_fingerprint(F.col("value"))).first()
    back = written.select(_unstuff(F.col("value")).alias("call")).select("call", F.inline(_scan_calls("call")))
    keys = calls(records).select("request_model", "response_id").distinct()
    there = back.select("request_model", "response_id")
    wrong = there.groupBy("request_model", "response_id").count().join(keys.withColumn("due", F.lit(1)), ["request_model", "response_id"], "full").where("count is null or count <> 1 or due is null").count()
    if before != after or wrong:
        raise ValueError(f"calls differ from their sources: {before} and {after}, {wrong} keys")
    return back.select("request_model", "response_id", "call"), path
