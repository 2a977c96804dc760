"""Classifiers of authorship, their folds and figures."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.durable import materialise
from tallyard.functions import text
from tallyard.operators.delivery import keep_one
from tallyard.plans.registry import registry
from tallyard.plans.similarity import _WORDS_SQL, _sql_tfidf, _words, tfidf
from tallyard.sources.fixtures import CTE, MODELS, judgments, responses
from tallyard.sources.tables import table

QUERIES, SQL, query = registry()
FOLDS = 5
#: Rows of a training task; fewer make a fit of many short iterations mostly scheduling.
ROWS_A_TASK = 20_000


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of every text, written once for all models of a query."""
    return materialise(text.features(responses(spark, sf_dir)).select("doc_id", "prompt_no", "author", "author_idx", *text.FULL), "features")


def training(f: DataFrame, columns: tuple[str, ...] = text.FULL) -> DataFrame:
    """Features as a vector, with the author as label and the prompt's fold."""
    f = f.withColumn("fold", F.pmod("prompt_no", F.lit(FOLDS)).cast("int")).withColumn("label", F.col("author_idx").cast("double"))
    return VectorAssembler(inputCols=list(columns), outputCol="raw").transform(f.select("doc_id", "prompt_no", "author", "label", "fold", *columns))


def out_of_fold(data: DataFrame, kind: str, trees: int = 30, seed: int = 42, scale_c: float = 1.0) -> DataFrame:
    """(doc_id, fold, label, prediction): every fold predicted by a model of the others."""
    data = data.select("doc_id", "fold", "label", "raw")
    data = materialise(data.coalesce(max(1, data.count() // ROWS_A_TASK)), "training")
    parts = []
    for k in range(FOLDS):
        train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
        if kind == "forest":
            model = RandomForestClassifier(featuresCol="raw", labelCol="label", numTrees=trees, maxDepth=8, seed=seed, subsamplingRate=0.8).fit(train)
        else:
            scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
            train, test = scaler.transform(train), scaler.transform(test)
            model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1.0 / (scale_c * max(1, train.count())), elasticNetParam=0.0, maxIter=30).fit(train)
        parts.append(model.transform(test).select("doc_id", "fold", "label", "prediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scores(p: DataFrame) -> DataFrame:
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("label") == F.col("prediction")).cast("int"))).alias("accuracy"))


@query()
def ml1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(out_of_fold(training(featured(spark, sf_dir)), "forest"))


@query()
def ml2_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(out_of_fold(training(featured(spark, sf_dir)), "logistic"))


@query(CTE + "select doc_id, (prompt_no % 5)::int as fold from resp")
def ml3_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds that keep a prompt's texts together."""
    return responses(spark, sf_dir).select("doc_id", F.pmod("prompt_no", F.lit(FOLDS)).cast("int").alias("fold"))


@query()
def ml4_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated accuracy against three rotations of the labels within prompts."""
    data = training(featured(spark, sf_dir), text.LENGTH_FREE)
    out = None
    for d in range(4):
        shift = F.lit(0) if d == 0 else F.conv(F.substring(F.md5(F.concat(F.lit(f"perm|{d}|"), F.col("prompt_no").cast("string"))), 1, 8), 16, 10).cast("bigint") % 5
        p = out_of_fold(data.withColumn("label", F.pmod(F.col("label") + shift, F.lit(5)).cast("double")), "logistic")
        row = p.agg(F.lit(d).alias("draw"), r6(F.avg((F.col("label") == F.col("prediction")).cast("int"))).alias("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def ml5_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature sets by models."""
    f, out = featured(spark, sf_dir), None
    for name, cols in (("full", text.FULL), ("length free", text.LENGTH_FREE), ("length only", text.LENGTH_ONLY)):
        for kind in ("forest", "logistic"):
            p = out_of_fold(training(f, cols), kind, trees=10)
            row = p.agg(F.lit(name).alias("features"), F.lit(kind).alias("model"), r6(F.avg((F.col("label") == F.col("prediction")).cast("int"))).alias("accuracy"))
            out = row if out is None else out.unionByName(row)
    return out


_CONF = CTE + ", c as (select author, guess, count(*) n from judg where cond = 'lineup' group by 1, 2)"


@query(_CONF + " select m as name, round((select sum(n) from c where author = m and guess = m) / (select sum(n) from c where guess = m), 6) as p, round((select sum(n) from c where author = m and guess = m) / (select sum(n) from c where author = m), 6) as r, round(2 * (select sum(n) from c where author = m and guess = m) / ((select sum(n) from c where guess = m) + (select sum(n) from c where author = m)), 6) as f1 from models")
def ml6_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = judgments(spark, sf_dir).where("cond = 'lineup'").select("author", "guess")
    per = c.agg(*[F.struct(F.lit(m).alias("name"), F.sum(((F.col("author") == m) & (F.col("guess") == m)).cast("int")).alias("tp"), F.sum((F.col("guess") == m).cast("int")).alias("g"), F.sum((F.col("author") == m).cast("int")).alias("a")).alias(m) for m in MODELS])
    return per.select(F.inline(F.array(*MODELS))).select("name", r6(F.col("tp") / F.col("g")).alias("p"), r6(F.col("tp") / F.col("a")).alias("r"), r6(2 * F.col("tp") / (F.col("g") + F.col("a"))).alias("f1"))


@query()
def ml7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each feature and the share of its family."""
    data = materialise(training(featured(spark, sf_dir)).select("label", "raw"), "training")
    model = RandomForestClassifier(featuresCol="raw", labelCol="label", numTrees=30, maxDepth=8, seed=42).fit(data)
    family = {f: k for k, fs in text.FAMILIES.items() for f in fs}
    imp = [(f, family[f], round(float(x), 6)) for f, x in zip(text.FULL, model.featureImportances.toArray())]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("family"), F.lit(x).alias("importance")) for f, k, x in imp])))


@query()
def srt03_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in the order of their importance."""
    return ml7_importance(spark, sf_dir).orderBy(F.desc("importance"), "feature")


@query(CTE + ", w as (select judge, (prompt_no % 5)::int as fold, author, guess from judg where cond = 'lineup' and correct = 0), n as (select fold, author, guess, count(*) n from w group by 1, 2, 3), t as (select f.fold, n.author, n.guess, sum(n.n) filter (n.fold <> f.fold) as n from n, (select unnest([0, 1, 2, 3, 4]) fold) f group by 1, 2, 3), m as (select fold, author, guess as pick from (select *, row_number() over (partition by fold, author order by coalesce(n, 0) desc, guess) rn from t) where rn = 1), a as (select fold, guess as pick from (select fold, guess, row_number() over (partition by fold order by sum(coalesce(n, 0)) desc, guess) rn from t group by fold, guess) where rn = 1) select count(*) as n, round(avg((w.guess = a.pick)::int), 6) as majority, round(avg((w.guess = m.pick)::int), 6) as identity_only from w join m using (fold, author) join a on a.fold = w.fold")
def ml8_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong guesses predicted by the most blamed name, and by the author's most common wrong name, both from the other folds."""
    w = judgments(spark, sf_dir).where("cond = 'lineup' and correct = 0").select(F.pmod("prompt_no", F.lit(5)).cast("int").alias("fold"), "author", "guess")
    c = w.groupBy("author", "guess").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("fold") == i).cast("int")).alias(f"f{i}") for i in range(5)])
    t = c.select("author", "guess", F.inline(F.array(*[F.struct(F.lit(i).alias("fold"), (F.col("n") - F.col(f"f{i}")).alias("k")) for i in range(5)])))
    m = keep_one(t, ["fold", "author"], [-F.col("k"), F.col("guess")], ["guess", "k"]).select("fold", "author", F.col("guess").alias("pick"))
    a = keep_one(t.groupBy("fold", "guess").agg(F.sum("k").alias("k")), ["fold"], [-F.col("k"), F.col("guess")], ["guess", "k"]).select("fold", F.col("guess").alias("most"))
    x = w.join(F.broadcast(m), ["fold", "author"]).join(F.broadcast(a), "fold")  # 25 and 5 rows
    return x.agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("guess") == F.col("most")).cast("int"))).alias("majority"), r6(F.avg((F.col("guess") == F.col("pick")).cast("int"))).alias("identity_only"))


@query("with " + _sql_tfidf(_WORDS_SQL) + " select doc_id, count(*) as terms, round(sum(w), 5) as weight from wv group by doc_id")
def ml9_shuffle_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word weights of texts with their words shuffled: the same as of the texts themselves."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.shuffled(F.col("text"), F.concat_ws("|", F.lit("7"), "doc_id")).alias("text"))
    return tfidf(_words(d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("w"), 5).alias("weight"))


@query()
def ml10_cross_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on every second prompt, tested on the others."""
    data = materialise(training(featured(spark, sf_dir)).select("prompt_no", "label", "raw"), "training")
    model = RandomForestClassifier(featuresCol="raw", labelCol="label", numTrees=30, maxDepth=8, seed=42).fit(data.where("prompt_no % 2 = 0"))
    p = model.transform(data.where("prompt_no % 2 = 1")).select("label", "prediction", vector_to_array("probability").alias("pr"))
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("label") == F.col("prediction")).cast("int"))).alias("accuracy"), r6(F.avg(F.array_max("pr"))).alias("confidence"))
