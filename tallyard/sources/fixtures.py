"""The audit's fact tables, read from the judging log and the corpus.

``responses``: one text per prompt and author, the one collected last. ``judgments``:
attributions of the log (cond 'single'), each item once, the last call that worked. The
log has no line-up; a session of cond 'lineup' is what one judge said last of every
text of one prompt, set in the slots of a Latin square. ``ratings``: yes/no and quality
judgments of the same items. Log-likelihoods stand in no table and are drawn from md5 of
the item, so every engine and every partitioning has the same ones. DuckDB has the same
tables as the common table expressions in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.operators.delivery import keep_one, latest_ok
from tallyard.sources.tables import table

MODELS = ("GPT", "Claude", "Gemini", "Grok", "DeepSeek")
GENRES = ("prose", "code", "short", "math")


def u(key: Column) -> Column:
    """The first eight hexadecimal digits of md5, as a number."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def prompt_key(c: Column | str) -> Column:
    """Case and surrounding blanks of a prompt's id have no meaning."""
    return F.upper(F.trim(c))


def place_of(model: Column | str) -> Column:
    """The place (from 0) of a model in the panel, whatever its case and surrounding blanks; null for any other name."""
    at = F.array_position(F.array(*[F.lit(m.lower()) for m in MODELS]), F.lower(F.trim(model)))
    return F.when(at > 0, (at - 1).cast("int"))


def model_at(place: Column | str) -> Column:
    return F.get(F.array(*map(F.lit, MODELS)), F.col(place) if isinstance(place, str) else place)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text of every prompt and author; one without a text only where there is no other."""
    r = table(spark, sf_dir, "responses", "response_no", "prompt_id", "model", "genre", "text")
    r = r.select("response_no", prompt_key("prompt_id").alias("prompt_id"), place_of("model").alias("author_idx"), "genre", "text").where("prompt_id is not null and author_idx is not null")
    kept = keep_one(r, ["prompt_id", "author_idx"], [F.col("text").isNull(), -F.col("response_no")], ["response_no", "genre", "text"])
    return kept.select(F.col("response_no").alias("doc_id"), u(F.col("prompt_id")).alias("prompt_no"), "prompt_id", "author_idx", model_at("author_idx").alias("author"), "genre", "text")


def _log(spark: SparkSession, sf_dir: str, conds: tuple[str, ...], *columns: str) -> DataFrame:
    """Each item of the log once within its cond, with who wrote, who judged and in which sample."""
    log = table(spark, sf_dir, "panel_records", "record_no", "cond", "item_id", "ok", "prompt_id", "genre", "true_author", "judge", "sample_no", *columns).where(F.col("cond").isin(*conds))
    kept = latest_ok(log, ["cond", "item_id"])
    kept = kept.withColumns({"prompt_id": prompt_key("prompt_id"), "author_idx": place_of("true_author"), "judge_idx": place_of("judge"), "genre": F.coalesce("genre", F.lit("none"))})
    kept = kept.where("prompt_id is not null and author_idx is not null and judge_idx is not null")
    return kept.withColumns({"item": F.col("item_id"), "prompt_no": u(F.col("prompt_id")), "author": model_at("author_idx"), "judge": model_at("judge_idx"), "block": F.concat_ws("|", "prompt_id", F.coalesce("sample_no", F.lit(1)).cast("string"))})


def judgments_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All judgments of both formats, unparsed guesses (null, needs_review 1) included.

    ``item`` is the log's item, ``k`` the judgment, ``block`` what was judged in one go:
    a prompt's texts of one sample.
    """
    j = _log(spark, sf_dir, ("single",), "parsed", "needs_review")
    guess = F.when(F.coalesce("ok", F.lit(False)), model_at(place_of("parsed.model")))
    j = j.withColumns({"guess": guess, "confidence": F.col("parsed.confidence"), "reason": F.col("parsed.reason"), "slot_no": ((F.col("author_idx") + F.col("judge_idx") + F.col("prompt_no")) % 5).cast("int")})
    review = (F.coalesce("needs_review", F.lit(False)) | F.col("guess").isNull()).cast("int")
    kept = ["prompt_no", "prompt_id", "genre", "author", "author_idx", "judge", "judge_idx", "item", "block", "slot_no", "guess", "confidence", "needs_review", "reason"]
    single = j.withColumn("needs_review", review).select("sample_no", *kept)
    last = keep_one(single, ["prompt_id", "author_idx", "judge_idx"], [-F.coalesce("sample_no", F.lit(1)), F.col("item")])
    both = single.select(F.lit("single").alias("cond"), *kept).unionByName(last.withColumn("block", F.col("prompt_id")).select(F.lit("lineup").alias("cond"), *kept))
    return both.withColumns({"k": F.concat_ws("|", "cond", "item"), "slot": F.expr("substring('ABCDE', slot_no + 1, 1)")})


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid judgments with their derived flags."""
    return flags(judgments_all(spark, sf_dir).where("needs_review <> 1 and guess is not null"))


def flags(j: DataFrame) -> DataFrame:
    return j.withColumns({"correct": (F.col("guess") == F.col("author")).cast("int"), "is_self": (F.col("author") == F.col("judge")).cast("int"), "named_self": (F.col("guess") == F.col("judge")).cast("int")})


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All judgments that were asked for: an unparsed guess counts as wrong (a guess '')."""
    return flags(judgments_all(spark, sf_dir).withColumn("guess", F.coalesce("guess", F.lit(""))))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: p_yes and says_yes, quality (null where the item was not asked so), and log-likelihoods."""
    log = _log(spark, sf_dir, ("binary", "quality"), "p_yes", "says_yes", "expected")
    yes, rated = F.col("cond") == "binary", F.col("cond") == "quality"
    number = lambda when, c: F.round(F.max(F.when(when & ~F.isnan(c), F.col(c))), 6)
    keys = ["item", "prompt_no", "prompt_id", "author", "author_idx", "judge", "judge_idx", "block"]
    r = log.groupBy(*keys).agg(F.min("genre").alias("genre"), number(yes, "p_yes").alias("p_yes"), F.max(F.when(yes, F.col("says_yes").cast("int"))).alias("says_yes"), number(rated, "expected").alias("quality"))
    v = {x: u(F.concat(F.lit("x|"), "item", F.lit("|" + x))) / F.lit(4294967296.0) for x in "lm"}
    less = F.when(F.col("author") == F.col("judge"), 0.0).otherwise(0.25)
    return r.withColumns({"lp_cond": F.round(-1 - v["l"] - less, 6), "lp_uncond": F.round(-1 - v["m"] - less, 6)})


def yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of the items that were asked 'did you write this?'."""
    return ratings(spark, sf_dir).where("p_yes is not null")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of the items whose quality was asked."""
    return ratings(spark, sf_dir).where("quality is not null")


def _list(options: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


def _u(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::bigint"


def _place(c: str) -> str:
    return f"(nullif(list_position({_list(tuple(m.lower() for m in MODELS))}, lower(trim({c}))), 0) - 1)::int"


_NAMES = _list(MODELS)
_KEPT = "select *, row_number() over (partition by cond, item_id order by coalesce(ok, false) desc, record_no desc) as rn from panel_records"
CTE = f"""with recursive models as (select unnest({_NAMES}) as m, unnest([0, 1, 2, 3, 4]) as mi),
r0 as (select response_no, upper(trim(prompt_id)) as prompt_id, {_place('model')} as author_idx, genre, text from responses),
resp as (select response_no as doc_id, {_u('prompt_id')} as prompt_no, prompt_id, author_idx, {_NAMES}[author_idx + 1] as author, genre, text
  from (select *, row_number() over (partition by prompt_id, author_idx order by (text is null)::int, response_no desc) as rn from r0 where prompt_id is not null and author_idx is not null) where rn = 1),
p0 as (select * replace (upper(trim(prompt_id)) as prompt_id, coalesce(genre, 'none') as genre), {_place('true_author')} as author_idx, {_place('judge')} as judge_idx from ({_KEPT}) where rn = 1),
p1 as (select * replace ({_NAMES}[judge_idx + 1] as judge), item_id as item, {_u('prompt_id')} as prompt_no, {_NAMES}[author_idx + 1] as author, prompt_id || '|' || coalesce(sample_no, 1) as block
  from p0 where prompt_id is not null and author_idx is not null and judge_idx is not null),
j0 as (select sample_no, prompt_no, prompt_id, genre, author, author_idx, judge, judge_idx, item, block, ((author_idx + judge_idx + prompt_no) % 5)::int as slot_no,
  case when coalesce(ok, false) then {_NAMES}[{_place('parsed.model')} + 1] end as guess, parsed.confidence as confidence, parsed.reason as reason, coalesce(needs_review, false) as asked_review from p1 where cond = 'single'),
j1 as (select * exclude (asked_review), (asked_review or guess is null)::int as needs_review from j0),
jall as (select *, cond || '|' || item as k, substr('ABCDE', slot_no + 1, 1) as slot from (
  select 'single' as cond, * exclude (sample_no) from j1 union all by name
  select 'lineup' as cond, * exclude (sample_no, rn) replace (prompt_id as block) from (select *, row_number() over (partition by prompt_id, author_idx, judge_idx order by coalesce(sample_no, 1) desc, item) as rn from j1) where rn = 1)),
judg as (select *, (guess = author)::int as correct, (author = judge)::int as is_self, (guess = judge)::int as named_self from jall where needs_review <> 1 and guess is not null),
jfull as (select * replace (coalesce(guess, '') as guess), (coalesce(guess, '') = author)::int as correct, (author = judge)::int as is_self, (coalesce(guess, '') = judge)::int as named_self from jall),
rate as (select item, prompt_no, prompt_id, author, author_idx, judge, judge_idx, block, min(genre) as genre,
  round(max(case when cond = 'binary' and not isnan(p_yes) then p_yes end), 6) as p_yes, max(case when cond = 'binary' then says_yes::int end) as says_yes, round(max(case when cond = 'quality' and not isnan(expected) then expected end), 6) as quality,
  round(-1 - {_u("'x|' || item || '|l'")} / 4294967296.0 - case when author = judge then 0.0 else 0.25 end, 6) as lp_cond,
  round(-1 - {_u("'x|' || item || '|m'")} / 4294967296.0 - case when author = judge then 0.0 else 0.25 end, 6) as lp_uncond
  from p1 where cond in ('binary', 'quality') group by 1, 2, 3, 4, 5, 6, 7, 8),
yesno as (select * from rate where p_yes is not null),
qual as (select * from rate where quality is not null)
"""
