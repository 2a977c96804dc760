"""Texts cut off by field limits.

Structure (fences, JSON, lists, final marks, cut markers) tells which texts are surely
finished. All others are held against their near-copies: min-hash bands over the
beginnings of texts bring a short copy together with longer ones, pairs are verified at
five words (0.8 of the shorter text's shingles stand in the beginning of the longer),
aligned, and the copy whose alignment ends early is cut. What has no near-copy is scored:
by how its last words close or go on in all finished sentences and items, with back-off,
and by what the finish reasons and the tokens a character mean among the texts that
structure decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyard.durable import materialise
from tallyard.llm import endings
from tallyard.llm.minhash import SIMILAR, beginning_grams, grams_of, prefix_keys, shingle_words
from tallyard.operators.spread import spread

_ENDING = T.StructType([T.StructField(n, T.StringType()) for n in ("state", "kind", "three", "two", "one")])
#: How reasons to finish are named. Fixed values.
LIMIT, DONE = ("length", "max_tokens", "model_length", "incomplete"), ("stop", "end_turn", "completed", "eos")
#: Texts and open texts of one key that meet in a task; larger keys are split in blocks of both.
BLOCK = 1024


@F.pandas_udf(_ENDING)
def _ending(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([endings.ending(t) for t in text], columns=["state", "kind", "three", "two", "one"])


def _field(schema: T.StructType, path: str) -> bool:
    kind: T.DataType = schema
    for name in path.split("."):
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def _reason(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(c.isNull(), "none").when(low.isin(*LIMIT), "limit").when(low.isin(*DONE), "done").otherwise("other")


def choices(raw: DataFrame) -> DataFrame:
    """One row per choice of raw_responses: its key, content, and what bears on it; the last user message as question.

    ``signs`` are its two reasons to finish, and its characters a token where the call has
    one choice, coarsely; fields that the schema lacks count as null.
    """
    users = F.filter("messages", lambda m: m["role"] == "user")
    held = raw.schema
    raw = spread(raw.select("record_id", "messages", "response"), "record_id")
    tokens = F.col("response.usage.completion_tokens") if _field(held, "response.usage.completion_tokens") else F.lit(None).cast("int")
    base = raw.select("record_id", F.col("messages").isNotNull().alias("asked"), F.try_element_at(users, F.lit(-1))["content"].alias("question"), F.col("response.provider").alias("provider"), F.when(F.size("response.choices") == 1, tokens).alias("tokens"), F.posexplode("response.choices").alias("pos", "c"))
    native = F.col("c.native_finish_reason") if _field(held, "response.choices.native_finish_reason") else F.lit(None).cast("string")
    dense = F.try_divide(F.length("c.message.content").cast("double"), F.col("tokens").cast("double"))
    bins = F.when(dense.isNull(), "none").when(dense < 1.5, "a").when(dense < 2.5, "b").when(dense < 3.5, "c").when(dense < 4, "d").otherwise("e")
    signs = F.array(F.concat(F.lit("r:"), _reason(F.col("c.finish_reason")), F.lit("/"), _reason(native)), F.concat(F.lit("d:"), bins))
    return base.select("record_id", F.coalesce("c.index", "pos").alias("choice_index"), "asked", "question", "provider", F.col("c.finish_reason").alias("finish_reason"), signs.alias("signs"), F.col("c.message.content").alias("content"), F.col("c.message.refusal").alias("refusal"))


def near_copies(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tid, verdict) of open texts that have a longer near-copy: 'cut', or 'complete' where only marks follow.

    ``texts``: distinct (tid, text, open). An open text has keys of its longest measured
    beginning, every text those of all its beginnings, so a copy cut at any length meets
    its longer ones. Within a key every open text is held against every other one, in
    blocks of ``block`` by ``block``: no pairs are written, and no key, however hot, is
    one task's.
    """
    keys = materialise(prefix_keys(texts), "bands")
    asked = keys.where("open").select("tid", F.explode("own").alias("key"))
    q_count = asked.groupBy("key").agg(F.count(F.lit(1)).alias("q"))
    offered = keys.select("tid", F.explode("all").alias("key")).join(q_count, "key")
    sizes = offered.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("q").alias("q")).where("n > 1")
    sizes = materialise(sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("a"), F.ceil(F.col("q") / block).cast("int").alias("b")), "keys")
    at = lambda k: F.pmod(F.xxhash64("tid", "key"), F.col(k)).cast("int")
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    candidates = keys.select("tid", F.explode("all").alias("key")).join(sizes, "key").select("key", "tid", at("a").alias("ca"), upto("b").alias("cb"), F.lit(1).alias("role"))
    queries = asked.join(sizes, "key").select("key", "tid", upto("a").alias("ca"), at("b").alias("cb"), F.lit(0).alias("role"))
    members = queries.unionByName(candidates).join(texts.select("tid", "text"), "tid")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, waiting = None, {}
        for pdf in batches:
            out = []
            for key, a, b, role, tid, text in zip(pdf["key"], pdf["ca"], pdf["cb"], pdf["role"], pdf["tid"], pdf["text"]):
                if (key, a, b) != group:
                    group, waiting = (key, a, b), {}
                w = shingle_words(text)
                if role == 0:
                    waiting[tid] = (text, len(w), grams_of(w))
                    continue
                beginnings: dict[int, set] = {}
                for q in [q for q, (_, n, _) in waiting.items() if q != tid and n <= len(w) + 1]:
                    early, n, grams = waiting[q]
                    if n not in beginnings:
                        beginnings[n] = beginning_grams(w, n)
                    if grams and len(grams & beginnings[n]) >= SIMILAR * len(grams) and (verdict := endings.align(early, text)):
                        out.append((q, verdict))
                        if verdict == endings.CUT:
                            del waiting[q]
            yield pd.DataFrame(out, columns=["tid", "verdict"], dtype=object)

    order = ("key", "ca", "cb")
    found = members.repartition(*order).sortWithinPartitions(*order, "role").select(*order, "role", "tid", "text").mapInPandas(verify, "tid string, verdict string")
    return found.groupBy("tid").agg(F.max("verdict").alias("verdict"))  # 'cut' above 'complete'


def _closing_statistics(texts: DataFrame) -> DataFrame:
    """(kind, key, closes, goes_on) of all texts: how often last words close a finished sentence or item, and how often something follows them."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, bool], Counter] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for (kind, closing), n in seen.items():
                if not n:
                    continue
                times = list(n.values())
                none = [0] * len(n)
                yield pd.DataFrame({"kind": [kind] * len(n), "key": list(n), "closes": times if closing else none, "goes_on": none if closing else times})

        for pdf in batches:
            for t in pdf["text"]:
                for k, keys in endings.interior(t).items():
                    seen.setdefault(k, Counter()).update(keys)
            if sum(map(len, seen.values())) > 1_000_000:
                yield from flush()
                seen = {}
        yield from flush()

    parts = texts.select("text").mapInPandas(partial, "kind string, key string, closes bigint, goes_on bigint")
    return parts.groupBy("kind", "key").agg(F.sum("closes").alias("closes"), F.sum("goes_on").alias("goes_on"))


def sign_weights(judged: DataFrame) -> dict[str, float]:
    """Log odds of cut against complete for every sign, from the texts that structure decides; at most some dozens of signs."""
    from math import log

    n = judged.where(F.col("state").isin(endings.CUT, endings.COMPLETE)).select("state", F.explode("signs").alias("sign")).groupBy("sign").agg(F.sum((F.col("state") == endings.CUT).cast("int")).alias("cut"), F.count(F.lit(1)).alias("n")).collect()
    by_kind: dict[str, list[int]] = {}
    for r in n:
        t = by_kind.setdefault(r["sign"][:2], [0, 0])
        t[0] += r["cut"]
        t[1] += r["n"] - r["cut"]
    return {r["sign"]: log((r["cut"] + 1) / (by_kind[r["sign"][:2]][0] + 8) * (by_kind[r["sign"][:2]][1] + 8) / (r["n"] - r["cut"] + 1)) for r in n}


#: Weights of the score of an open text: what an unknown ending weighs, and the smoothing of counted ones. A sentence
#: without its mark is mostly cut, an item that ends in a known word mostly whole. At most ``MOST`` from all signs together.
SENTENCE, ITEM, SMOOTH, MOST = 2.2, -3.0, 0.02, 1.9


def _score(signs: Column) -> Column:
    """Above zero: cut. ``closes`` and ``goes_on`` of the longest last words that were seen (three, two, one)."""
    ratio = lambda k: F.log((F.col(f"{k}_goes_on") + SMOOTH) / (F.col(f"{k}_closes") + SMOOTH))
    bounded = lambda c, b: F.greatest(F.lit(-b), F.least(F.lit(b), c))
    # fewer words say less: two words count by half, one by a fifth and only against the text
    sentence = F.when(F.col("t_closes").isNotNull(), ratio("t")).when(F.col("p_closes").isNotNull(), bounded(0.5 * ratio("p"), 1.5)).when(F.col("w_closes").isNotNull(), F.greatest(F.lit(0.0), 0.2 * ratio("w"))).otherwise(1.5)
    item = F.when(F.col("w_closes").isNull(), 8.0).otherwise(ITEM + bounded(ratio("w"), 0.8))
    return F.when(F.col("kind") == "item", item).otherwise(SENTENCE + sentence) + bounded(signs, MOST)


def endings_of(df: DataFrame, text_col: str = "content", signs_col: str | None = None) -> DataFrame:
    """``df`` with a column ``is_cut``: null for texts without letter or digit, else whether the text breaks off.

    Every text is read whole and every row kept, repeated ones too. Texts are judged
    once each, whatever number of rows holds them, by all signs these rows give. A null
    text has null. A column ``is_cut`` that is there already is replaced.
    """
    hashed = df.drop("is_cut").withColumn("__tid", F.md5(F.col(f"`{text_col}`")))
    signs = F.col(f"`{signs_col}`") if signs_col else F.array().cast("array<string>")
    texts = hashed.where(F.col("__tid").isNotNull()).groupBy("__tid").agg(F.first(F.col(f"`{text_col}`")).alias("text"), F.array_distinct(F.flatten(F.collect_set(signs))).alias("signs"))
    judged = texts.select(F.col("__tid").alias("tid"), "text", "signs", _ending("text").alias("e")).select("tid", "text", "signs", "e.*")
    judged = materialise(judged, "endings")
    copies = near_copies(judged.where(F.col("state") != endings.NONE).select("tid", "text", F.col("state").isin(endings.OPEN, endings.CUT).alias("open")))
    stats = _closing_statistics(judged)
    rest = judged.where(F.col("state") == endings.OPEN).select("tid", "kind", "three", "two", "one", "signs")
    keyed = rest.select("tid", F.inline(F.array(*[F.struct(F.lit(k).alias("key_kind"), F.col(c).alias("key")) for k, c in (("t", "three"), ("p", "two"), ("w", "one"))])))
    known = keyed.join(stats.withColumnRenamed("kind", "key_kind"), ["key_kind", "key"]).groupBy("tid").agg(*[F.max(F.when(F.col("key_kind") == k, F.col(v))).alias(f"{k}_{v}") for k in "tpw" for v in ("closes", "goes_on")])
    weights = sign_weights(judged) if signs_col else {}
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    # of several rows with one text those signs count that speak most for a cut, per kind of sign
    strongest = lambda kind: F.coalesce(F.array_max(F.transform(F.filter("signs", lambda s: s.startswith(kind)), lambda s: F.coalesce(F.try_element_at(table, s), F.lit(0.0)))), F.lit(0.0))
    weight = strongest("r:") + strongest("d:") if weights else F.lit(0.0)
    scored = rest.join(known, "tid", "left").select("tid", (_score(weight) > 0).alias("open_cut"))
    verdict = judged.select("tid", "state").join(scored, "tid", "left").join(copies, "tid", "left")
    open_cut = F.coalesce(F.col("verdict") == endings.CUT, F.col("open_cut"))
    is_cut: Column = F.when(F.col("state") == endings.NONE, None).when(F.col("state") == endings.OPEN, open_cut).otherwise(F.col("state") == endings.CUT)
    verdict = verdict.select(F.col("tid").alias("__tid"), is_cut.alias("is_cut"))
    return hashed.join(verdict, "__tid", "left").drop("__tid")


def by_source(cut: DataFrame, source: str = "provider") -> DataFrame:
    """Per source: contents with a letter or digit, cut ones, and their share. Null sources are one source."""
    c = F.coalesce(F.col("is_cut"), F.lit(False))
    return cut.where("is_cut is not null").groupBy(source).agg(F.count(F.lit(1)).alias("contents"), F.sum(c.cast("int")).alias("cut"), F.avg(c.cast("double")).alias("share"))
