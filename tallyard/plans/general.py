"""Queries of the general data-preparation problems (files, nesting, redelivery)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.durable import ship
from tallyard.operators import compaction, delivery, flatten
from tallyard.sources.tables import table

CHOICES = "response.choices"
TOKENS = CHOICES + ".logprobs.content"
ALTERNATIVES = TOKENS + ".top_logprobs"
#: A choice is named by choices.index, or by its place where that is null.
ORDINALS = {CHOICES: "index"}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct calls of the archive, read back from the compacted and verified containers."""
    ship(spark)
    records, _ = compaction.compact(table(spark, sf_dir, "raw_files", "body"))
    return compaction.distinct_calls(records).select("request_model", "response_id")


def p2_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call exactly once, as its own object, read back from the files that hold nothing else."""
    ship(spark)
    records, _ = compaction.compact(table(spark, sf_dir, "raw_files", "body"))
    return compaction.write_calls(records)[0]


def p2_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every archived file as its container holds it: its bytes, and whether they are as many as the archive says."""
    records, _ = compaction.compact(table(spark, sf_dir, "raw_files", "file_path", "body"), name="file_path")
    stored = table(spark, sf_dir, "raw_files", "file_path", "n_bytes")
    held = records.select(F.col("name").alias("file_path"), F.octet_length("payload").cast("bigint").alias("held_bytes"))
    return stored.join(held, "file_path", "left").select("file_path", "n_bytes", "held_bytes", (F.col("n_bytes") == F.col("held_bytes")).cast("int").alias("as_stated"))


def p2_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive before and after: files, records and bytes."""
    files = table(spark, sf_dir, "raw_files", "body")
    _, path = compaction.compact(files)
    before = files.agg(F.count(F.lit(1)).alias("files"), F.count("body").alias("records"))
    written = spark.read.option("lineSep", compaction.SEPARATOR).text(path)
    after = written.select(F.input_file_name().alias("file")).agg(F.count_distinct("file").alias("files"), F.count("file").alias("records"))
    return before.select(F.lit("archive").alias("state"), "files", "records").unionByName(after.select(F.lit("containers").alias("state"), "files", "records"))


def _nested(spark: SparkSession, sf_dir: str, columns: dict[str, list[str]]) -> DataFrame:
    """Archived responses with nothing but the named paths, and what names their nodes."""
    full = table(spark, sf_dir, "raw_responses", "record_id", "response").schema
    return spark.read.schema(flatten.skeleton(full, ["record_id"], ORDINALS, columns)).parquet(f"{sf_dir}/raw_responses.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of every archived response; all groups come from one pass."""
    kinds = {flatten.ROOT: "response", CHOICES: "choice", TOKENS: "token", ALTERNATIVES: "alternative"}
    n = flatten.nodes(_nested(spark, sf_dir, {}), ["record_id"], ORDINALS, set(kinds), {})
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("group"))
    at = [F.coalesce(F.get("ordinals", F.lit(i)), F.lit(-1)).alias(c) for i, c in enumerate(("choice_index", "token_index", "alt_index"))]
    return n.select(kind.alias("node_kind"), F.col("k0").alias("record_id"), *at)


def p3_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of responses; provider and total_tokens stand here once."""
    held = ["response__id", "response__model", "response__provider", "response__usage__completion_tokens", "response__usage__total_tokens"]
    t = flatten.unnest(_nested(spark, sf_dir, {flatten.ROOT: held}), ["record_id"], flatten.ROOT, columns=held)
    return t.select("record_id", F.col("response__id").alias("response_id"), F.col("response__model").alias("model"), F.col("response__provider").alias("provider"), F.col("response__usage__completion_tokens").alias("completion_tokens"), F.col("response__usage__total_tokens").alias("total_tokens"))


def p3_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ["finish_reason", "native_finish_reason", "message__content"]
    t = flatten.unnest(_nested(spark, sf_dir, {CHOICES: held}), ["record_id"], CHOICES, ORDINALS, held)
    return t.select("record_id", F.col(f"`{CHOICES}#`").alias("choice_index"), "finish_reason", "native_finish_reason", F.col("message__content").alias("content"))


def p3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ["token", "logprob"]
    t = flatten.unnest(_nested(spark, sf_dir, {TOKENS: held}), ["record_id"], TOKENS, ORDINALS, held)
    return t.select("record_id", F.col(f"`{CHOICES}#`").alias("choice_index"), F.col(f"`{TOKENS}#`").alias("token_index"), "token", F.round("logprob", 6).alias("logprob"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row kept of each item within its condition."""
    log = table(spark, sf_dir, "panel_records", "record_no", "cond", "item_id", "ok")
    return delivery.latest_ok(log, ["cond", "item_id"], payload=["record_no"]).select("record_no")


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept rows themselves."""
    log = table(spark, sf_dir, "panel_records", "record_no", "cond", "item_id", "ok", "prompt_id", "judge", "true_author", "parsed", "says_yes")
    kept = delivery.latest_ok(log, ["cond", "item_id"])
    return kept.select("record_no", "cond", "item_id", "ok", "prompt_id", "judge", "true_author", F.col("parsed.model").alias("guessed"), "says_yes")


_CHOICE = "coalesce(u.c.\"index\", u.p::int)"
_EACH = "(select record_id, unnest(response.choices) c, generate_subscripts(response.choices, 1) - 1 p from raw_responses) u"
_TOKEN = f"(select record_id, {_CHOICE} ci, unnest(c.logprobs.content) t, generate_subscripts(c.logprobs.content, 1) - 1 tp from {_EACH}) v"
_KEPT = "(select *, row_number() over (partition by cond, item_id order by coalesce(ok, false) desc, record_no desc) rn from panel_records)"

QUERIES = {f.__name__: f for f in (p2_found, p2_calls, p2_index, p2_compaction, p3_found, p3_responses, p3_choices, p3_tokens, p4_found, p4_kept)}

SQL = {
    "p2_index": "select file_path, n_bytes, octet_length(encode(regexp_replace(body, '^\\x{FEFF}', '')))::bigint as held_bytes, (n_bytes = octet_length(encode(regexp_replace(body, '^\\x{FEFF}', ''))))::int as as_stated from raw_files",
    "p2_compaction": "select 'archive' as state, count(*) as files, count(body) as records from raw_files union all select 'containers', greatest(1, ceil(sum(octet_length(encode(body))) / 134217728))::bigint, count(body) from raw_files",
    "p3_found": f"""
        select 'response' as node_kind, record_id, -1 as choice_index, -1 as token_index, -1 as alt_index from raw_responses
        union all select 'choice', record_id, {_CHOICE}, -1, -1 from {_EACH}
        union all select 'token', record_id, ci, tp::int, -1 from {_TOKEN}
        union all select 'alternative', record_id, ci, tp::int, ap::int from
            (select record_id, ci, tp, unnest(t.top_logprobs) a, generate_subscripts(t.top_logprobs, 1) - 1 ap from {_TOKEN}) w""",
    "p3_responses": "select record_id, response.id as response_id, response.model as model, response.provider as provider, response.usage.completion_tokens as completion_tokens, response.usage.total_tokens as total_tokens from raw_responses",
    "p3_choices": f"select record_id, {_CHOICE} as choice_index, c.finish_reason as finish_reason, c.native_finish_reason as native_finish_reason, c.message.content as content from {_EACH}",
    "p3_tokens": f"select record_id, ci as choice_index, tp::int as token_index, t.token as token, round(t.logprob, 6) as logprob from {_TOKEN}",
    "p4_found": f"select record_no from {_KEPT} where rn = 1",
    "p4_kept": f"select record_no, cond, item_id, ok, prompt_id, judge, true_author, parsed.model as guessed, says_yes from {_KEPT} where rn = 1",
}
