"""Similarity of texts and vectors: centroids left-out by algebra, TF-IDF, blocks for stated queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.durable import materialise, ship
from tallyard.functions import text
from tallyard.functions.lexicons import FUNCTION_WORDS
from tallyard.operators.delivery import keep_one
from tallyard.operators.ordering import mid_ranks
from tallyard.plans.registry import registry
from tallyard.sources.fixtures import CTE, judgments, responses
from tallyard.sources.tables import table

QUERIES, SQL, query = registry()
STYLE = ("word_count", "ttr", "avg_word_len", "avg_sent_len", "comma_per_100w")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.features(responses(spark, sf_dir)).select("doc_id", "prompt_id", "prompt_no", "author", "author_idx", *STYLE)


def standardised(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """z scores with the population's deviation; a constant column gives zeros. Mean and deviation are one aggregated row."""
    stats = df.agg(*[F.avg(c).alias(f"{c}__m") for c in columns], *[F.stddev_pop(c).alias(f"{c}__s") for c in columns])
    z = [F.when(F.col(f"{c}__s") > 0, (F.col(c) - F.col(f"{c}__m")) / F.col(f"{c}__s")).otherwise(0.0).alias(c) for c in columns]
    return df.join(F.broadcast(stats)).select(*[c for c in df.columns if c not in columns], *z)


_STYLE_SQL = CTE + ", f as (select r.doc_id, prompt_id, author, author_idx, coalesce(length(r.text), 0)::double as a, (length(coalesce(r.text, '')) - length(replace(coalesce(r.text, ''), ',', '')))::double as b from resp r), z as (select doc_id, prompt_id, author, author_idx, (a - avg(a) over ()) / stddev_pop(a) over () as a, (b - avg(b) over ()) / stddev_pop(b) over () as b from f)"


def _simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    f = responses(spark, sf_dir).select("doc_id", "prompt_id", "author", "author_idx", F.length(t).cast("double").alias("a"), text.count_of(t, ",").cast("double").alias("b"))
    return standardised(f, ("a", "b"))


@query(_STYLE_SQL + " select x.doc_id as doc_id, y.author as candidate, round(-sqrt((x.a - y.a) ^ 2 + (x.b - y.b) ^ 2), 6) as similarity from z x join z y on x.prompt_id = y.prompt_id")
def sim01_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative distance of standardised features among a prompt's five answers."""
    z = _simple(spark, sf_dir)
    y = z.select("prompt_id", F.col("author").alias("candidate"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    d = F.sqrt((F.col("a") - F.col("ya")) ** 2 + (F.col("b") - F.col("yb")) ** 2)
    return z.join(y, "prompt_id").select("doc_id", "candidate", r6(-d).alias("similarity"))


def tfidf(tokens: DataFrame, key: str = "doc_id", least: int = 2) -> DataFrame:
    """(key, term, w): 1 + ln tf, times ln((1 + n) / (1 + df)) + 1, for terms in at least ``least`` texts, of unit length."""
    tf = tokens.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = tokens.select(key).distinct().agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    raw = tf.join(df, "term").join(F.broadcast(n)).select(key, "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def _sql_tfidf(tokens: str) -> str:
    return f"tok as ({tokens}), tf as (select doc_id, term, count(*) as tf from tok group by 1, 2), nd as (select count(distinct doc_id) as n from tok), dfs as (select term, count(*) as df from tf group by 1 having count(*) >= 2), raw as (select doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as w from tf join dfs using (term), nd), norm as (select doc_id, sqrt(sum(w * w)) as norm from raw group by 1), wv as (select doc_id, term, w / norm as w from raw join norm using (doc_id))"


def _words(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.explode(F.transform(text.tokens(text.strip(F.col("text"))), F.lower)).alias("term"))


_WORDS_SQL = "select doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_''-]*[\\p{L}\\p{N}_])?'), lambda x: lower(x))) as term from documents"


_GRAMS_SQL = "select doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) as term from (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_''-]*[\\p{L}\\p{N}_])?'), lambda x: lower(x)) as w from documents)"


@query("with " + _sql_tfidf(_GRAMS_SQL) + " select doc_id, term, round(w, 6) as w from wv")
def sim02_word_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and pairs of neighbouring words."""
    w = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.transform(text.tokens(text.strip(F.col("text"))), F.lower).alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.size("w")), lambda x, y: F.concat(x, F.lit(" "), y))
    return tfidf(w.select("doc_id", F.explode(F.concat("w", pairs)).alias("term"))).select("doc_id", "term", r6("w").alias("w"))


@query("with " + _sql_tfidf("select doc_id, unnest(flatten(list_transform(range(3, least(length(w), 5) + 1), lambda n: list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))))) as term from (select response_no as doc_id, ' ' || unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[\\s\\p{Z}]+'), lambda x: x <> '')) || ' ' as w from responses)") + " select doc_id, count(*) as terms, round(sum(w), 5) as weight from wv group by doc_id")
def sim03_char_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three to five characters within blank-padded words; a shorter word stands for itself."""
    t = table(spark, sf_dir, "responses", "response_no", "text").withColumnRenamed("response_no", "doc_id")
    padded = t.select("doc_id", F.explode(text.white_words(F.lower("text"))).alias("w")).select("doc_id", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    grams = padded.select("doc_id", F.explode(F.expr("flatten(transform(sequence(3, least(length(w), 5)), n -> transform(sequence(1, length(w) - n + 1), i -> substring(w, i, n))))")).alias("term"))
    return tfidf(grams).groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("w"), 5).alias("weight"))


def _is(word: str):
    return lambda x: x == word


@query(CTE + ", w as (select doc_id, prompt_id, author, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') as w from resp), f as (select doc_id, prompt_id, author, f.word, len(list_filter(w, lambda x: x = f.word)) / greatest(len(w), 1) as r from w, (select unnest(" + str(list(FUNCTION_WORDS)) + ") as word) f), z as (select *, case when stddev_pop(r) over (partition by word) > 0 then (r - avg(r) over (partition by word)) / stddev_pop(r) over (partition by word) else 0 end as z from f) select a.doc_id as doc_id, b.author as candidate, round(sum(a.z * b.z) / (sqrt(sum(a.z * a.z)) * sqrt(sum(b.z * b.z))), 5) as delta from z a join z b on a.prompt_id = b.prompt_id and a.word = b.word group by 1, 2")
def sim04_function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of standardised function-word frequencies among a prompt's answers."""
    r = responses(spark, sf_dir).select("doc_id", "prompt_id", "author", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z']+"), 0).alias("w"))
    n = F.greatest(F.size("w"), F.lit(1))
    cols = [f"w{i}" for i in range(len(FUNCTION_WORDS))]
    f = r.select("doc_id", "prompt_id", "author", *[(F.size(F.filter("w", _is(k))) / n).alias(c) for k, c in zip(FUNCTION_WORDS, cols)])
    z = standardised(f, tuple(cols)).select("doc_id", "prompt_id", "author", F.array(*cols).alias("v"))
    y = z.select("prompt_id", F.col("author").alias("candidate"), F.col("v").alias("y"))
    return z.join(y, "prompt_id").select("doc_id", "candidate", F.round(cosine(F.col("v"), F.col("y")), 5).alias("delta"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@query("select vec_id, round(list_cosine_similarity(embedding::double[], (select list(m order by i) from (select i, avg(v) as m from (select unnest(embedding::double[]) v, unnest(range(1, len(embedding) + 1)) i from embeddings) group by i))), 6) as to_mean from embeddings")
def sim05_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector to the mean vector, which is one row of fixed width."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    mean = e.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    return e.join(F.broadcast(mean)).select("vec_id", r6(cosine(F.col("embedding"), F.col("mean"))).alias("to_mean"))


def left_out_centroids(v: DataFrame, group: str, label: str, vec: str, width: int) -> DataFrame:
    """(group, label, c): the label's mean outside each group, as total less the group's own part; no join on inequality."""
    parts = v.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get(vec, i).cast("double")).alias(f"s{i}") for i in range(width)])
    total = parts.groupBy(label).agg(F.sum("n").alias("tn"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(width)])
    groups = v.select(group).distinct()
    grid = groups.join(F.broadcast(total))  # labels: a handful of rows
    left = grid.join(parts, [group, label], "left")
    n = F.col("tn") - F.coalesce("n", F.lit(0))
    c = F.array(*[(F.col(f"t{i}") - F.coalesce(f"s{i}", F.lit(0.0))) / n for i in range(width)])
    return left.where(n > 0).select(group, label, c.alias("c"))


_CENTROID = "with e as (select vec_id, vec_id % 20 as g, label, embedding::double[] as v from embeddings), x as (select vec_id, g, label, unnest(v) as v, unnest(range(1, len(v) + 1)) as i from e), p as (select g, label, i, sum(v) as s, count(*) as n from x group by 1, 2, 3), t as (select label, i, sum(s) as s, sum(n) as n from p group by 1, 2), c as (select gs.g, t.label, list((t.s - coalesce(p.s, 0)) / (t.n - coalesce(p.n, 0)) order by t.i) as c from (select distinct g from e) gs join t on true left join p on p.g = gs.g and p.label = t.label and p.i = t.i group by 1, 2), s as (select e.vec_id, e.label as truth, c.label as label, list_cosine_similarity(e.v, c.c) as sim from e join c on e.g = c.g), b as (select vec_id, truth, label as nearest, sim from (select *, row_number() over (partition by vec_id order by round(sim, 9) desc, label) rn from s) where rn = 1)"


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("g", F.col("vec_id") % 20)
    width = len(e.first()["embedding"])
    c = left_out_centroids(e, "g", "label", "embedding", width).groupBy("g").agg(F.collect_list(F.struct("label", "c")).alias("cs"))  # ten labels a group
    s = e.join(c, "g").select("vec_id", F.col("label").alias("truth"), F.explode(F.transform("cs", lambda x: F.struct(x["label"].alias("label"), cosine(F.col("embedding"), x["c"]).alias("sim")))).alias("x")).select("vec_id", "truth", "x.*")
    return keep_one(s, ["vec_id", "truth"], [-F.round("sim", 9), F.col("label")], ["label", "sim"])


@query(_CENTROID + " select vec_id, nearest, round(sim, 6) as sim from b")
def sim06_left_out_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("vec_id", F.col("label").alias("nearest"), r6("sim").alias("sim"))


@query(_CENTROID + " select truth, count(*) as n, round(avg((nearest = truth)::int), 6) as accuracy from b group by truth")
def jon10_lpo_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the nearest centroid of the other groups."""
    return _nearest(spark, sf_dir).groupBy("truth").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("label") == F.col("truth")).cast("int"))).alias("accuracy"))


def top_neighbours(corpus: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """(query, neighbour, sim, rank): the k nearest of all rows for each stated query, exactly.

    Queries travel in blocks of ``block`` vectors; each partition of the corpus keeps
    its own best k per query, and those are merged. Only blocks are sent to the workers,
    never the corpus, and no pairs are written.
    """
    q = queries.orderBy("id").collect()  # the stated query set
    spark, parts = corpus.sparkSession, []
    for at in range(0, len(q), block):
        ids = [r["id"] for r in q[at : at + block]]
        m = np.array([r["v"] for r in q[at : at + block]], dtype="float64")
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        handle = spark.sparkContext.broadcast((ids, m))

        def best(batches: Iterator[pd.DataFrame], handle=handle) -> Iterator[pd.DataFrame]:
            ids_, m_ = handle.value
            keep_s, keep_i = np.full((len(ids_), 0), 0.0), np.full((len(ids_), 0), 0, dtype="int64")
            for pdf in batches:
                v = np.stack(pdf["v"].to_numpy()).astype("float64")
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                s = np.round(np.hstack([keep_s, m_ @ v.T]), 9)
                i = np.hstack([keep_i, np.broadcast_to(pdf["id"].to_numpy(), (len(ids_), len(pdf)))])
                s[:, keep_s.shape[1] :][np.array(ids_)[:, None] == pdf["id"].to_numpy()[None, :]] = -np.inf
                order = np.lexsort((i, -s), axis=1)[:, :k]
                keep_s, keep_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            for n, row in enumerate(ids_):
                if keep_s.shape[1]:
                    yield pd.DataFrame({"query": row, "neighbour": keep_i[n], "sim": keep_s[n]})

        parts.append(corpus.mapInPandas(best, "query bigint, neighbour bigint, sim double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), "neighbour"))), 1, k)
    return out.where(~F.col("sim").isin(float("-inf"))).groupBy("query").agg(top.alias("t")).select("query", F.posexplode("t").alias("rank", "x")).select("query", F.col("x.neighbour").alias("neighbour"), (-F.col("x.d")).alias("sim"), (F.col("rank") + 1).alias("rank"))


@query("with q as (select vec_id, embedding::double[] as v from embeddings where vec_id % 20 = 0), s as (select q.vec_id as query, e.vec_id as neighbour, round(list_cosine_similarity(q.v, e.embedding::double[]), 6) as sim, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.v, e.embedding::double[]), 9) desc, e.vec_id) as rank from q join embeddings e on q.vec_id <> e.vec_id) select query, neighbour, sim, rank::int as rank from s where rank <= 5")
def jon09_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for every query vector (ids divisible by twenty), in blocks."""
    ship(spark)
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return top_neighbours(e, e.where("id % 20 = 0"), 5).withColumn("sim", r6("sim"))


@query(_STYLE_SQL + ", s as (select x.doc_id, y.author as candidate, -sqrt((x.a - y.a) ^ 2 + (x.b - y.b) ^ 2) as sim, x.prompt_id, x.author from z x join z y on x.prompt_id = y.prompt_id where x.author <> y.author) select s.doc_id as doc_id, j.judge as judge, round(1 + count(*) filter (s.sim > g.sim + 1e-9) + 0.5 * count(*) filter (abs(s.sim - g.sim) <= 1e-9 and s.candidate <> g.candidate), 6) as rank from judg j join s on s.prompt_id = j.prompt_id and s.author = j.author join s g on g.doc_id = s.doc_id and g.candidate = j.guess where j.cond = 'lineup' and j.guess <> j.author group by s.doc_id, j.judge")
def sim07_guess_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near the wrongly named author's answer is among the other four."""
    z = _simple(spark, sf_dir)
    y = z.select("prompt_id", F.col("author").alias("candidate"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    s = z.join(y, "prompt_id").where("author <> candidate").withColumn("sim", -F.sqrt((F.col("a") - F.col("ya")) ** 2 + (F.col("b") - F.col("yb")) ** 2))
    m = s.groupBy("doc_id", "prompt_id", "author").agg(F.map_from_entries(F.collect_list(F.struct("candidate", "sim"))).alias("m"))
    j = judgments(spark, sf_dir).where("cond = 'lineup' and guess <> author").select("prompt_id", "author", "judge", "guess")
    own = F.try_element_at("m", F.col("guess"))
    above = F.size(F.filter(F.map_values("m"), lambda x: x > own + 1e-9))
    level = F.size(F.filter(F.map_values("m"), lambda x: F.abs(x - own) <= 1e-9)) - 1
    return j.join(m, ["prompt_id", "author"]).where(own.isNotNull()).select("doc_id", "judge", r6(1 + above + 0.5 * level).alias("rank"))


@query(_STYLE_SQL + ", d as (select doc_id, prompt_id, author, round(sqrt(a * a + b * b), 9) as v from z), x as (select j.judge, d.v, j.correct as g from judg j join d on d.prompt_id = j.prompt_id and d.author = j.author where j.cond = 'lineup'), rk as (select *, rank() over (partition by judge order by v) + (count(*) over (partition by judge, v) - 1) / 2 as mid from x) select judge, round((sum(mid * g) - sum(g) * (sum(g) + 1) / 2) / (sum(g) * (count(*) - sum(g))), 4) as auc from rk group by judge")
def sim08_typicality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is an untypical text recognised more often? AUC of its distance from the mean."""
    d = _simple(spark, sf_dir).select("prompt_id", "author", F.round(F.sqrt(F.col("a") ** 2 + F.col("b") ** 2), 9).alias("v"))
    x = materialise(judgments(spark, sf_dir).where("cond = 'lineup'").join(d, ["prompt_id", "author"]).select("judge", "v", F.col("correct").alias("g")), "typicality")
    v = x.groupBy("judge", "v").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n"))
    m = v.join(mid_ranks(x, "v", ["judge"]).select("judge", "v", "mid"), ["judge", "v"])
    g, n = F.sum("g"), F.sum("n")
    return m.groupBy("judge").agg(F.round((F.sum(F.col("mid") * F.col("g")) - g * (g + 1) / 2) / (g * (n - g)), 4).alias("auc"))


@query(_STYLE_SQL + ", s as (select x.prompt_id, x.author, y.author as candidate, -sqrt((x.a - y.a) ^ 2 + (x.b - y.b) ^ 2) as sim from z x join z y on x.prompt_id = y.prompt_id where x.author <> y.author), dm as (select *, sim - avg(sim) over (partition by prompt_id, author) as d from s) select j.judge as judge, round(avg(dm.d), 5) as statistic from judg j join dm on dm.prompt_id = j.prompt_id and dm.author = j.author and dm.candidate = j.guess where j.cond = 'lineup' group by j.judge")
def sim09_demeaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of named candidates, above the mean of the candidates there were."""
    z = _simple(spark, sf_dir)
    y = z.select("prompt_id", F.col("author").alias("candidate"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    s = z.join(y, "prompt_id").where("author <> candidate").withColumn("sim", -F.sqrt((F.col("a") - F.col("ya")) ** 2 + (F.col("b") - F.col("yb")) ** 2))
    mean = s.groupBy("prompt_id", "author").agg(F.avg("sim").alias("mean"))
    s = s.join(mean, ["prompt_id", "author"]).select("prompt_id", "author", F.col("candidate").alias("guess"), (F.col("sim") - F.col("mean")).alias("d"))
    j = judgments(spark, sf_dir).where("cond = 'lineup'").select("prompt_id", "author", "guess", "judge")
    return j.join(s, ["prompt_id", "author", "guess"]).groupBy("judge").agg(F.round(F.avg("d"), 5).alias("statistic"))
