"""Sources, sinks, projections, joins, sets and orderings of the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyard.durable import fresh_path
from tallyard.operators.delivery import keep_one
from tallyard.operators.ordering import numbered
from tallyard.operators.quality import one_to_one
from tallyard.plans.registry import registry
from tallyard.sources.fixtures import CTE, MODELS, judgments, judgments_all, quality, ratings, responses, yes_no
from tallyard.sources.tables import table

QUERIES, SQL, query = registry()
EXCLUDE = ("P0000003", "P0000007")
CAPS = {"prose": 700, "code": 500, "short": 300, "math": 400}


def models(spark: SparkSession) -> DataFrame:
    """The panel: five rows, a constant."""
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, MODELS))).alias("mi", "m"))


# --- sources and sinks


@query(CTE + "select prompt_id, author, length(text)::int as chars from resp where text is not null")
def src01_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses through a CSV file with quotes and line breaks in its cells."""
    path, schema = fresh_path(spark, "csv"), "prompt_id string, author string, text string"
    r = responses(spark, sf_dir).where("text is not null").select("prompt_id", "author", "text")
    r.write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("lineSep", "\n").csv(path)
    back = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return back.groupBy("prompt_id", "author").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@query("select record_no, item_id, judge from panel_records where coalesce(ok, false)")
def src02_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSONL log in which some lines are no JSON: they are skipped, as are calls not ok."""
    path = fresh_path(spark, "jsonl")
    log = table(spark, sf_dir, "panel_records", "record_no", "item_id", "judge", "ok")
    line = F.to_json(F.struct("record_no", "item_id", "judge", "ok"))
    broken = F.when(F.col("record_no") % 50 == 0, F.concat(F.lit("{broken "), F.col("record_no").cast("string")))
    log.select(F.explode(F.array(line, broken)).alias("value")).where("value is not null").write.text(path)
    back = spark.read.schema("record_no bigint, item_id string, judge string, ok boolean, bad string").option("columnNameOfCorruptRecord", "bad").json(path)
    return back.where("bad is null and ok").select("record_no", "item_id", "judge")


@query("select record_id, split_part(regexp_replace(source_file, '^.*/|\\.json$', '', 'g'), '__', 1) as condition, nullif(split_part(regexp_replace(source_file, '^.*/|\\.json$', '', 'g'), '__', 2), '') as prompt_id, response.provider as provider, response.usage.total_tokens as total_tokens from raw_responses")
def src03_call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-call files: keys from the file name, figures from the body."""
    stem = F.regexp_replace("source_file", r"^.*/|\.json$", "")
    parts = F.split(stem, "__")
    return table(spark, sf_dir, "raw_responses", "record_id", "source_file", "response").select("record_id", F.get(parts, 0).alias("condition"), F.get(parts, 1).alias("prompt_id"), F.col("response.provider").alias("provider"), F.col("response.usage.total_tokens").alias("total_tokens"))


@query("with f as (select record_id, split_part(source_file, '__', 2) p from raw_responses), q as (select distinct prompt_id, genre from prompts_v2) select record_id, f.p as prompt_id, q.genre as genre from f join q on f.p = q.prompt_id")
def src04_raw_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived calls with the design row of their prompt."""
    calls = table(spark, sf_dir, "raw_responses", "record_id", "source_file").select("record_id", F.get(F.split("source_file", "__"), 1).alias("prompt_id"))
    return calls.join(table(spark, sf_dir, "prompts_v2", "prompt_id", "genre").distinct(), "prompt_id").select("record_id", "prompt_id", "genre")


@query("select cond, item_id, record_no from (select *, row_number() over (partition by cond, item_id order by record_no desc) rn from panel_records where ok) where rn = 1")
def src05_latest_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ok record of each item; items without one are left out."""
    log = table(spark, sf_dir, "panel_records", "record_no", "cond", "item_id", "ok").where("ok")
    return keep_one(log, ["cond", "item_id"], [-F.col("record_no")], ["record_no"])


@query("select record_id, response.usage.total_tokens::varchar as total_tokens, list_filter(response.choices, lambda c: c.\"index\" = 1)[1].finish_reason as second_finish from raw_responses")
def src10_dig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted paths into result JSON, an array element chosen by a field."""
    doc = F.to_json("response")
    return table(spark, sf_dir, "raw_responses", "record_id", "response").select("record_id", F.get_json_object(doc, "$.usage.total_tokens").alias("total_tokens"), F.get(F.filter("response.choices", lambda c: c["index"] == 1), 0)["finish_reason"].alias("second_finish"))


@query(CTE + "select cond, judge, '{\"n\":' || count(*) || ',\"correct\":' || sum(correct) || '}' as doc from judg group by cond, judge")
def snk03_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON, one document per cell of a mart."""
    t = judgments(spark, sf_dir).groupBy("cond", "judge").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("correct"))
    return t.select("cond", "judge", F.to_json(F.struct("n", "correct")).alias("doc"))


@query("select o_orderkey, case when o_totalprice > 100000 then null else round(o_totalprice, 2) end as price from orders")
def snk04_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN and infinities become null before a JSON sink."""
    x = F.when(F.col("o_totalprice") > 200000, F.lit(float("inf"))).when(F.col("o_totalprice") > 100000, F.lit(float("nan"))).otherwise(F.round("o_totalprice", 2))
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", x.alias("x"))
    return t.select("o_orderkey", F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x")).alias("price"))


@query(CTE + "select cond, judge, '| ' || judge || ' | ' || sum(correct) || '/' || count(*) || ' |' as line from judg group by cond, judge")
def snk06_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a Markdown report."""
    t = judgments(spark, sf_dir).groupBy("cond", "judge").agg(F.sum("correct").alias("c"), F.count(F.lit(1)).alias("n"))
    return t.select("cond", "judge", F.format_string("| %s | %d/%d |", "judge", "c", "n").alias("line"))


@query(CTE + "select cond, judge, '\\newcommand{\\acc' || judge || '}{' || sum(correct) || '}' as macro from judg group by cond, judge")
def snk05_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LaTeX macros of a mart."""
    t = judgments(spark, sf_dir).groupBy("cond", "judge").agg(F.sum("correct").alias("c"))
    return t.select("cond", "judge", F.concat(F.lit("\\newcommand{\\acc"), "judge", F.lit("}{"), F.col("c").cast("string"), F.lit("}")).alias("macro"))


# --- projections and filters


@query(CTE + "select k from jall where prompt_id not in ('P0000003', 'P0000007')")
def prj01_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments_all(spark, sf_dir).where(~F.col("prompt_id").isin(*EXCLUDE)).select("k")


@query(CTE + "select k, guess from jall where needs_review <> 1 and guess is not null and guess <> ''")
def prj02_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments_all(spark, sf_dir).where("needs_review <> 1 and guess is not null and guess <> ''").select("k", "guess")


@query(CTE + "select k, correct, is_self, named_self from judg")
def prj03_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("k", "correct", "is_self", "named_self")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per prompt and judge of the lineup: slot to author, and slot to the parsed answer; null where unparsed."""
    j = judgments_all(spark, sf_dir).where("cond = 'lineup'")
    answers = F.when(F.col("guess").isNotNull(), F.struct(F.col("guess").alias("model"), "confidence"))
    pairs = F.collect_list(F.struct("slot", "author"))
    parsed = F.collect_list(F.struct("slot", answers.alias("a")))
    return j.groupBy("prompt_id", "judge").agg(F.map_from_entries(F.array_sort(pairs)).alias("slot_to_author"), F.map_from_entries(F.array_sort(parsed)).alias("parsed"))


@query(CTE + "select prompt_id, judge, slot, author as true_author, guess as guessed_model, case when guess is not null then confidence end as confidence from jall where cond = 'lineup'")
def prj04_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as one row per slot."""
    s = sessions(spark, sf_dir).select("prompt_id", "judge", "parsed", F.explode("slot_to_author").alias("slot", "true_author"))
    a = F.try_element_at("parsed", "slot")
    return s.select("prompt_id", "judge", "slot", "true_author", a["model"].alias("guessed_model"), a["confidence"].alias("confidence"))


@query("select record_no, prompt_id, judge, true_author, parsed.model as guessed_model, parsed.confidence as confidence from panel_records where cond = 'single' and ok")
def prj05_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "panel_records", "record_no", "cond", "ok", "prompt_id", "judge", "true_author", "parsed").where("cond = 'single' and ok")
    return log.select("record_no", "prompt_id", "judge", "true_author", F.col("parsed.model").alias("guessed_model"), F.col("parsed.confidence").alias("confidence"))


@query(CTE + "select k, ((slot_no - author_idx + 5) % 5)::int as rot, (((slot_no - author_idx + 5) % 5) = 0)::int as listed from jall where cond = 'lineup'")
def prj06_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rot = F.pmod(F.col("slot_no") - F.col("author_idx"), F.lit(5))
    return judgments_all(spark, sf_dir).where("cond = 'lineup'").select("k", rot.cast("int").alias("rot"), (rot == 0).cast("int").alias("listed"))


@query(CTE + "select doc_id from resp where text is not null and prompt_id in (select prompt_id from resp where text is not null group by prompt_id having count(distinct author) = 5)")
def prj07_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of prompts that every author answered."""
    r = responses(spark, sf_dir).where("text is not null").select("doc_id", "prompt_id", "author_idx")
    whole = r.groupBy("prompt_id").agg(F.bit_or(F.pow(F.lit(2), F.col("author_idx")).cast("int")).alias("seen")).where("seen = 31")
    return r.join(whole, "prompt_id", "left_semi").select("doc_id")


@query(CTE + "select prompt_id, count(*) as n from judg where prompt_id in (select distinct prompt_id from resp order by 1 limit 10) group by prompt_id")
def prj08_first_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run limited to the first ten prompts (the limit is the option)."""
    first = responses(spark, sf_dir).select("prompt_id").distinct().orderBy("prompt_id").limit(10)
    return judgments(spark, sf_dir).join(first, "prompt_id", "left_semi").groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n"))


@query(CTE + "select cond, prompt_id, judge, sum(correct) as hits from judg group by 1, 2, 3 having sum(correct) > 0 and sum(correct) < count(*)")
def prj09_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata with neither no event nor nothing but events."""
    g = judgments(spark, sf_dir).groupBy("cond", "prompt_id", "judge").agg(F.sum("correct").alias("hits"), F.count(F.lit(1)).alias("n"))
    return g.where("hits > 0 and hits < n").select("cond", "prompt_id", "judge", "hits")


@query(CTE + "select author, prompt_id, max(case when judge = 'GPT' then correct end) as \"GPT\", max(case when judge = 'Claude' then correct end) as \"Claude\", max(case when judge = 'Gemini' then correct end) as \"Gemini\", max(case when judge = 'Grok' then correct end) as \"Grok\", max(case when judge = 'DeepSeek' then correct end) as \"DeepSeek\" from judg where cond = 'lineup' group by author, prompt_id having count(*) = 5")
def prj10_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete cases of judges by prompt."""
    j = judgments(spark, sf_dir).where("cond = 'lineup'")
    return j.groupBy("author", "prompt_id").pivot("judge", list(MODELS)).agg(F.max("correct")).dropna()


@query("select record_id, c.finish_reason as finish_reason, case when c.message.content is null or trim(c.message.content) = '' then 'empty' when c.finish_reason = 'length' then 'truncated' when c.finish_reason = 'content_filter' or c.message.refusal is not null then 'refused' else 'kept' end as mark from (select record_id, unnest(response.choices) c from raw_responses)")
def prj11_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused, truncated and empty answers become missing, not wrong."""
    c = table(spark, sf_dir, "raw_responses", "record_id", "response").select("record_id", F.explode("response.choices").alias("c"))
    content = F.col("c.message.content")
    mark = F.when(content.isNull() | (F.trim(content) == ""), "empty").when(F.col("c.finish_reason") == "length", "truncated").when((F.col("c.finish_reason") == "content_filter") | F.col("c.message.refusal").isNotNull(), "refused").otherwise("kept")
    return c.select("record_id", F.col("c.finish_reason").alias("finish_reason"), mark.alias("mark"))


@query(CTE + "select cond, judge, round(avg(named_self), 6) as rate, (avg(named_self) < 0.03 or avg(named_self) > 0.97)::int as fixed from judg group by cond, judge")
def prj12_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges that nearly always give one answer."""
    g = judgments(spark, sf_dir).groupBy("cond", "judge").agg(F.avg("named_self").alias("r"))
    return g.select("cond", "judge", F.round("r", 6).alias("rate"), ((F.col("r") < 0.03) | (F.col("r") > 0.97)).cast("int").alias("fixed"))


@query("select response_no, word_count, (word_count >= case genre when 'prose' then 700 when 'code' then 500 when 'short' then 300 when 'math' then 400 end - 5)::int as hit_limit from responses")
def prj13_hit_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text reached its genre's cap."""
    caps = F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv])
    r = table(spark, sf_dir, "responses", "response_no", "genre", "word_count")
    return r.select("response_no", "word_count", (F.col("word_count") >= F.try_element_at(caps, F.col("genre")) - 5).cast("int").alias("hit_limit"))


# --- joins


@query(CTE + "select judg.k, length(resp.text)::int as chars from judg join resp on judg.prompt_id = resp.prompt_id and judg.author = resp.author where resp.text is not null")
def jon01_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments with the length of their text; the text itself never crosses the shuffle."""
    r = responses(spark, sf_dir).where("text is not null").select("prompt_id", "author", F.length("text").alias("chars"))
    return judgments(spark, sf_dir).select("k", "prompt_id", "author").join(r, ["prompt_id", "author"]).select("k", "chars")


@query(CTE + "select k, r.rk as length_rank from judg left join (select prompt_id, author, rank() over (partition by prompt_id order by length(text)) as rk from resp where text is not null) r using (prompt_id, author)")
def jon02_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses(spark, sf_dir).where("text is not null").select("prompt_id", "author", F.length("text").alias("n"))
    r = r.select("prompt_id", "author", F.rank().over(W.partitionBy("prompt_id").orderBy("n")).cast("bigint").alias("length_rank"))
    return judgments(spark, sf_dir).select("k", "prompt_id", "author").join(r, ["prompt_id", "author"], "left").select("k", "length_rank")


@query(CTE + "select judg.k, qual.quality from judg join qual using (item) where judg.is_self = 0")
def jon03_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir).where("is_self = 0").select("k", "item")
    return j.join(quality(spark, sf_dir).select("item", "quality"), "item").select("k", "quality")


@query(CTE + "select judg.k, round(rate.lp_cond - rate.lp_uncond, 6) as relative from judg join rate using (item) where judg.named_self = 1")
def jon04_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir).where("named_self = 1").select("k", "item")
    r = ratings(spark, sf_dir).select("item", F.round(F.col("lp_cond") - F.col("lp_uncond"), 6).alias("relative"))
    return j.join(r, "item").dropna().select("k", "relative")


@query(CTE + "select a.k as k, a.guess as lineup, b.guess as single from judg a join judg b using (item) where a.cond = 'lineup' and b.cond = 'single'")
def jon05_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join that fails where its key repeats on either side."""
    j, key = judgments(spark, sf_dir), ["item"]
    a = j.where("cond = 'lineup'").select(*key, "k", F.col("guess").alias("lineup"))
    b = j.where("cond = 'single'").select(*key, F.col("guess").alias("single"))
    return one_to_one(a, b, key).select("k", "lineup", "single")


@query(CTE + "select coalesce(a.k, b.k) as k, case when a.k is null then 'second only' when b.k is null then 'first only' when a.guess is distinct from b.guess then 'differs' else 'agrees' end as state from (select k, guess from jall where needs_review = 0) a full join (select k, case when confidence = 5 then 'GPT' else guess end as guess from jall where slot <> 'E') b on a.k = b.k")
def jon06_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parses of the same answers, row by row."""
    j = judgments_all(spark, sf_dir)
    a = j.where("needs_review = 0").select("k", F.col("guess").alias("ga"), F.lit(1).alias("ia"))
    b = j.where("slot <> 'E'").select("k", F.when(F.col("confidence") == 5, "GPT").otherwise(F.col("guess")).alias("gb"), F.lit(1).alias("ib"))
    state = F.when(F.col("ia").isNull(), "second only").when(F.col("ib").isNull(), "first only").when(~F.col("ga").eqNullSafe(F.col("gb")), "differs").otherwise("agrees")
    return a.join(b, "k", "full").select("k", state.alias("state"))


@query(CTE + "select prompt_id, judge.m as judge, author.m as author, ((author.mi + judge.mi + prompt_no) % 5)::int as slot_no from (select distinct prompt_no, prompt_id from resp), models judge, models author")
def jon07_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts by judges by authors: constant lists are exploded, nothing is cross joined."""
    p = responses(spark, sf_dir).select("prompt_no", "prompt_id").distinct()
    panel = F.array(*map(F.lit, MODELS))
    p = p.select("*", F.posexplode(panel).alias("ji", "judge")).select("*", F.posexplode(panel).alias("ai", "author"))
    return p.select("prompt_id", "judge", "author", ((F.col("ai") + F.col("ji") + F.col("prompt_no")) % 5).cast("int").alias("slot_no"))


@query(CTE + "select a.doc_id as doc_id, b.author as candidate, (length(b.text) - length(a.text))::int as longer from resp a join resp b on a.prompt_id = b.prompt_id where a.text is not null and b.text is not null")
def jon08_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with the five answers to its prompt; at most five rows a text."""
    r = responses(spark, sf_dir).where("text is not null").select("doc_id", "prompt_id", "author", F.length("text").alias("n"))
    b = r.select("prompt_id", F.col("author").alias("candidate"), F.col("n").alias("m"))
    return r.join(b, "prompt_id").select("doc_id", "candidate", (F.col("m") - F.col("n")).alias("longer"))


@query(CTE + "select cond, a.judge as a, b.judge as b, count(*) as texts, sum(a.correct)::bigint as a_right, sum(b.correct)::bigint as b_right from judg a join judg b using (cond, block, author) where a.judge < b.judge and a.author <> a.judge and a.author <> b.judge group by 1, 2, 3")
def jon11_judge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of judges over the texts of third parties: five judges a text, paired inside one row."""
    j = judgments(spark, sf_dir).groupBy("cond", "block", "author").agg(F.array_sort(F.collect_list(F.struct("judge", "correct"))).alias("js"))
    a = j.select("*", F.posexplode("js").alias("i", "a")).select("*", F.explode(F.slice("js", F.col("i") + 2, F.lit(5))).alias("b"))
    a = a.where((F.col("author") != F.col("a.judge")) & (F.col("author") != F.col("b.judge")))
    return a.groupBy("cond", F.col("a.judge").alias("a"), F.col("b.judge").alias("b")).agg(F.count(F.lit(1)).alias("texts"), F.sum("a.correct").alias("a_right"), F.sum("b.correct").alias("b_right"))


@query("select distinct p.prompt_id as prompt_id, (exists (select 1 from responses r where r.prompt_id = p.prompt_id and r.source = 'api'))::int as in_api from prompts_v2 p where exists (select 1 from responses r where r.prompt_id = p.prompt_id and r.source = 'chat')")
def jon12_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts asked in chat, and whether by API too (semi join, then a left join of distinct keys)."""
    r = table(spark, sf_dir, "responses", "prompt_id", "source")
    p = table(spark, sf_dir, "prompts_v2", "prompt_id").distinct().join(r.where("source = 'chat'"), "prompt_id", "left_semi")
    api = r.where("source = 'api'").select("prompt_id").distinct().withColumn("in_api", F.lit(1))
    return p.join(api, "prompt_id", "left").select("prompt_id", F.coalesce("in_api", F.lit(0)).alias("in_api"))


@query(CTE + ", s as (select cond, judge, avg(case when is_self = 1 then correct end) - avg(case when author <> judge then named_self end) as d from judg group by 1, 2) select k from judg where exists (select 1 from s where s.cond = judg.cond and s.judge = judg.judge and s.d > 0.1)")
def jon13_verdict_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of judges whose hits exceed their false alarms by a tenth."""
    j = judgments(spark, sf_dir)
    s = j.groupBy("cond", "judge").agg((F.avg(F.when(F.col("is_self") == 1, F.col("correct"))) - F.avg(F.when(F.col("is_self") == 0, F.col("named_self")))).alias("d")).where("d > 0.1")
    return j.join(s, ["cond", "judge"], "left_semi").select("k")


@query(CTE + "select k from jall a where not exists (select 1 from judg b where b.k = a.k)")
def jon14_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items still without a valid answer."""
    return judgments_all(spark, sf_dir).select("k").join(judgments(spark, sf_dir).select("k"), "k", "left_anti")


# --- sets


@query(CTE + "select 'judgments' as source, cond, count(*) as n from judg group by cond union all select 'ratings', 'binary', count(*) from yesno union all select 'ratings', 'quality', count(*) from qual")
def set01_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = judgments(spark, sf_dir).select(F.lit("judgments").alias("source"), "cond")
    b = yes_no(spark, sf_dir).select(F.lit("ratings").alias("source"), F.lit("binary").alias("cond"))
    c = quality(spark, sf_dir).select(F.lit("ratings").alias("source"), F.lit("quality").alias("cond"))
    return a.unionByName(b).unionByName(c).groupBy("source", "cond").agg(F.count(F.lit(1)).alias("n"))


@query("select prompt_id, model, response_no from (select *, row_number() over (partition by prompt_id, model order by response_no desc) rn from responses) where rn = 1")
def set02_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_one(table(spark, sf_dir, "responses", "prompt_id", "model", "response_no"), ["prompt_id", "model"], [-F.col("response_no")])


@query("select response_no, 'base' as origin from responses where not (coalesce(word_count, 0) < 20) union all select response_no, 'repaired' from responses where coalesce(word_count, 0) < 20")
def set03_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rows without the repaired keys, and the repaired rows."""
    r = table(spark, sf_dir, "responses", "response_no", "word_count")
    fixed = r.where("coalesce(word_count, 0) < 20").select("response_no")
    return r.join(fixed, "response_no", "left_anti").select("response_no", F.lit("base").alias("origin")).unionByName(fixed.withColumn("origin", F.lit("repaired")))


@query("(select prompt_id, 'both' as side from (select prompt_id from responses intersect select prompt_id from prompts_v2)) union all (select prompt_id, 'responses' from (select prompt_id from responses except select prompt_id from prompts_v2))")
def set04_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "responses", "prompt_id"), table(spark, sf_dir, "prompts_v2", "prompt_id")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("responses")))


@query(CTE + "select prompt_id, author, judge, max(case when cond = 'lineup' then guess end) as lineup, max(case when cond = 'single' then guess end) as single from judg group by 1, 2, 3")
def set05_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir)
    return j.groupBy("prompt_id", "author", "judge").agg(*[F.max(F.when(F.col("cond") == c, F.col("guess"))).alias(c) for c in ("lineup", "single")])


# --- orderings


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).where("correct = 0").groupBy("cond", "author", "author_idx", "guess").agg(F.count(F.lit(1)).alias("n"))


@query(CTE + "select cond, author, guess, n from (select cond, author, guess, count(*) as n, row_number() over (partition by cond order by count(*) desc, any_value(author_idx), list_position(['GPT', 'Claude', 'Gemini', 'Grok', 'DeepSeek'], guess)) rn from judg where correct = 0 group by cond, author, guess) where rn <= 6")
def srt01_top_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six largest error flows of each format, ties in panel order."""
    at = F.array_position(F.array(*map(F.lit, MODELS)), F.col("guess"))
    w = W.partitionBy("cond").orderBy(F.desc("n"), "author_idx", at)
    return _flows(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 6").select("cond", "author", "guess", "n")


@query(CTE + "select cond, judge, acc, place from (select cond, judge, round(avg(correct), 6) as acc, row_number() over (partition by cond order by avg(correct) desc, any_value(judge_idx)) as place from judg where is_self = 0 group by cond, judge) where place <= 2")
def srt02_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best judge of others' texts and the runner-up."""
    g = judgments(spark, sf_dir).where("is_self = 0").groupBy("cond", "judge", "judge_idx").agg(F.avg("correct").alias("a"))
    w = W.partitionBy("cond").orderBy(F.desc("a"), "judge_idx")
    return g.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 2").select("cond", "judge", F.round("a", 6).alias("acc"), "place")


@query(CTE + "select cond, author, judge, rate from (select cond, author, judge, round(avg((guess = author)::int), 6) as rate, row_number() over (partition by cond, author order by avg((guess = author)::int) desc, any_value(judge_idx)) rn from judg where is_self = 0 group by cond, author, judge) where rn = 1")
def srt04_strongest_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = judgments(spark, sf_dir).where("is_self = 0").groupBy("cond", "author", "judge", "judge_idx").agg(F.avg("correct").alias("r"))
    return keep_one(g, ["cond", "author"], [-F.col("r"), F.col("judge_idx")]).select("cond", "author", "judge", F.round("r", 6).alias("rate"))


@query("select record_id, row_number() over (order by archived_at nulls first, source_file nulls first, record_id) as place from raw_responses")
def srt05_ledger_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the ledger by time and file: sorted over the cluster, numbered from partition offsets."""
    t = table(spark, sf_dir, "raw_responses", "record_id", "archived_at", "source_file")
    return numbered(t, ["archived_at", "source_file", "record_id"], "place").select("record_id", "place")


@query("select p_brand, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice, p_partkey) rn from part) where rn <= 3")
def srt06_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three cheapest of each family."""
    w = W.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return table(spark, sf_dir, "part", "p_brand", "p_partkey", "p_retailprice").withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")
