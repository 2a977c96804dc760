"""Queries of the language-model data problems, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.durable import ship
from tallyard.llm import packing, pairs, pii, splits, tokens, truncation
from tallyard.sources.tables import table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_responses", "record_id", "messages", "response")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective question and answer pairs."""
    ship(spark)
    return pairs.defects(_raw(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices whose content breaks off."""
    ship(spark)
    choices = truncation.choices(_raw(spark, sf_dir)).select("record_id", "choice_index", "question", "content", "signs")
    return pairs.cut_answers(choices).where("is_cut").select("record_id", "choice_index")


def p5_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each provider's contents are cut; spellings of a provider differ in case and blanks only."""
    ship(spark)
    cut = pairs.cut_answers(truncation.choices(_raw(spark, sf_dir)).select("provider", "question", "content", "signs"))
    return truncation.by_source(cut.withColumn("provider", F.lower(F.trim("provider"))))


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = table(spark, sf_dir, "responses", "prompt_id", "text")
    return splits.components(splits.ties(responses, splits.prompt_key(F.col("prompt_id")), F.col("text")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tied prompts with the smallest prompt of their group."""
    ship(spark)
    return _components(spark, sf_dir).select(F.col("vertex").alias("prompt_id"), F.col("root").alias("group_prompt_id"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every row of the judging log; rows without a prompt form one group."""
    ship(spark)
    log = table(spark, sf_dir, "panel_records", "record_no", "prompt_id").select("record_no", F.coalesce(splits.prompt_key(F.col("prompt_id")), F.lit("")).alias("key"))
    groups = _components(spark, sf_dir)
    per_prompt = log.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(groups, F.col("key") == F.col("vertex"), "left").select("key", "n", F.coalesce("root", "key").alias("grp"))
    assigned = splits.assign(per_prompt.groupBy("grp").agg(F.sum("n").alias("n")), SHARES)
    of_prompt = per_prompt.join(assigned, "grp").select("key", "grp", "split")
    return log.join(of_prompt, "key").select("record_no", F.col("grp").alias("group_prompt_id"), "split")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return tokens.encode(table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return tokens.decode(p7_ids(spark, sf_dir)).select("doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its container of 1,024 tokens."""
    ship(spark)
    return packing.pack(tokens.token_counts(table(spark, sf_dir, "documents", "doc_id", "text")))


def p8_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used against the lower bound of all documents together."""
    return packing.certificate(p8_containers(spark, sf_dir))


def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.find(docs, pii.train(docs))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of personal information per document."""
    ship(spark)
    values = F.array_distinct(F.transform("found", lambda f: F.struct(f["kind"].alias("kind"), f["found_text"].alias("found_text"))))
    return _pii(spark, sf_dir).select("doc_id", F.inline(values))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with typed placeholders."""
    ship(spark)
    return _pii(spark, sf_dir).select("doc_id", F.col("redacted").alias("text"))


_TIES = """
    with recursive t as (select distinct upper(trim(prompt_id)) p, regexp_replace(text, '\\s', '', 'g') b from responses where text is not null and prompt_id is not null),
    f as (select * from t where b <> ''),
    e as (select distinct x.p a, y.p b from f x join f y using (b) where x.p <> y.p),
    r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
    select a as prompt_id, least(a, min(b)) as group_prompt_id from r group by a"""

QUERIES = {f.__name__: f for f in (p1_found, p5_found, p5_by_provider, p6_found, p6_splits, p7_ids, p7_decoded, p8_containers, p8_certificate, p9_found, p9_redacted)}
SQL = {
    "p6_found": _TIES,
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
