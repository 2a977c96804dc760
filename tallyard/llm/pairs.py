"""Defective question and answer pairs, each with its defect."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyard.durable import materialise
from tallyard.llm import truncation
from tallyard.llm.language import language, requested
from tallyard.llm.minhash import SHINGLE, shingle_words, verified_links
from tallyard.llm.splits import components

#: Ways of declining, per language; read in the opening only. Fixed values.
_DECLINE = re.compile(
    r"\b(?:i|we)(?:\s+(?:really|simply|just))?\s+(?:can\s?no[tn]|can['’]t|could\s?not|am\s+(?:not\s+able|unable)|(?:wo|ca)n['’]t\s+be\s+able|will\s+not\s+be\s+able|won['’]t|will\s+not|do\s+not\s+feel\s+comfortable|don['’]t\s+feel\s+comfortable|am\s+not\s+comfortable)\b(?!\s+(?:say|tell|explain|see|imagine)\s+(?:who|how|what|where|when|why|whether)|\s+(?:believe|forget|wait|help\s+(?:but|feeling|thinking|noticing|myself)|remember|recall|imagine|sleep|stop|see|hear|blame|complain|deny|stress|miss|go\s+wrong)\b)"
    r"|\bi\s+(?:must|have\s+to|need\s+to)\s+(?:decline|refuse|pass)\b|\bi\s+(?:decline|refuse)\b|\bi(?:['’]d|\s+would)\s+(?:rather|prefer)\s+not\b|\bi\s+choose\s+not\s+to\b"
    r"|\b(?:my|our)\s+(?:guidelines|rules|policy|policies|instructions)\s+(?:rule|do|don|for|prevent|prohibit|forbid)|\bno\s+answer\s+can\s+be\s+given\b|\bnot\s+something\s+i\s+(?:can|will|am)\b"
    r"|\boutside\s+(?:of\s+)?what\s+i\s+(?:can|may)\b|\bis\s+where\s+i\s+stop\b|\bnot\s+one\s+i\s+will\b|\bi\s+am\s+going\s+to\s+leave\b.{0,60}\bunanswered\b|\bi['’]m\s+going\s+to\s+leave\b.{0,60}\bunanswered\b|\bi['’]m\s+(?:unable|not\s+able|not\s+comfortable)\b"
    r"|\bkann\s+ich\s+(?:\w+\s+){0,3}nicht\b|\bich\s+kann\s+(?:\w+\s+){0,4}nicht\b|\bnicht\s+(?:helfen|möglich|beantworten|äußern)\b|\bmuss\s+ich\s+(?:leider\s+)?(?:ablehnen|passen)\b|\bich\s+muss\s+(?:\w+\s+){0,4}ablehnen\b|\bmöchte\s+(?:ich\s+)?(?:\w+\s+){0,3}(?:lieber\s+)?nicht\b|\baußerhalb\s+dessen\b|\bschreibe\s+ich\s+nicht\b|\bdarf\s+ich\s+(?:\w+\s+){0,3}nicht\b|\bmeine\s+(?:regeln|richtlinien)\b|\bantworte\s+ich\s+(?:lieber\s+)?nicht\b"
    r"|\bno\s+(?:puedo|podemos|podré|me\s+es\s+posible|me\s+está\s+permitido|voy\s+a)\b|\bdebo\s+(?:rechazar|declinar)\b|\btengo\s+que\s+(?:rechazar|declinar)\b|\bprefiero\s+no\b|\bmis\s+(?:normas|reglas|directrices)\b|\bno\s+me\s+lo\s+permiten\b|\bfuera\s+de\s+lo\s+que\s+puedo\b|\bno\s+escribiré\b"
    r"|\bje\s+ne\s+(?:peux|pourrai|suis\s+pas\s+en\s+mesure|souhaite|veux)\b|\bje\s+(?:dois|préfère)\s+(?:décliner|refuser|ne\s+pas)\b|\bm['’]est\s+impossible\b|\bmes\s+(?:règles|consignes)\b|\bje\s+refuse\b|\bau-delà\s+de\s+ce\s+que\s+je\b|\bje\s+n['’]écrirai\s+pas\b",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_CLAUSE = re.compile(r"[,;:.!?…]+(?:\s+|$)|\s+[-–—]+\s+|\s+(?=(?:because|but|and i|weil|aber|porque|pero|parce que|mais)\b)|[\"“”«»()\[\]]+")
_LABEL = re.compile(r"^\W*(?:(?:question|prompt|task|user|q|frage|aufgabe|pregunta|tarea|question posée|tâche|you asked|the question)\s*[:\-–—]\s*)", re.I)


def opening(text: str | None) -> str:
    """The first sentence; with the second where the first has fewer than three words, or is polite and says nothing."""
    parts = [p for p in _SENTENCE.split((text or "").strip()) if p.strip()][:2]
    if not parts:
        return ""
    words = parts[0].split()
    return parts[0] if len(parts) == 1 or (len(words) >= 3 and not _POLITE.match(parts[0])) else " ".join(parts)


#: Polite first sentences, which a refusal may follow. Fixed values.
_POLITE = re.compile(r"(?:thank(?:s| you)|(?:i(?:['’]m| am) )?(?:so )?sorry|i apologi[sz]e|i (?:understand|appreciate)|good question|great question|danke|vielen dank|(?:es )?tut mir leid|entschuldig|gracias|lo siento|merci|je suis désolée?|désolée?)\b", re.I)


def clauses(text: str | None) -> list[str]:
    """The distinct clauses of an opening, as words in lower case."""
    found = (" ".join(shingle_words(x)) for x in _CLAUSE.split(opening(text).lower()))
    return list(dict.fromkeys(x for x in found if x))


def declines(text: str | None) -> bool:
    """Whether an opening declines in the speaker's own voice; quoted speech doesn't count."""
    return bool(_DECLINE.search(re.sub(r"[\"“”«»].*?[\"“”«»]", " ", opening(text))))


def _letters(text: str) -> str:
    return "".join(ch for ch in text.casefold() if ch.isalnum())


def is_echo(question: str | None, answer: str | None) -> bool:
    """Whether the answer is nothing but the question, once or repeated, whatever its case, spacing, quotes, label or marks."""
    if not question or not answer:
        return False
    q = _letters(question)
    if not q:
        return False
    a = _letters(answer)
    if len(a) >= len(q) and len(a) % len(q) == 0 and a == q * (len(a) // len(q)):
        return True
    pieces = [_LABEL.sub("", p) for p in re.split(r"\n\s*\n|\n", answer) if p.strip()]
    a = "".join(map(_letters, pieces))
    if a and len(a) % len(q) == 0 and a == q * (len(a) // len(q)):
        return True
    a = _letters(_LABEL.sub("", answer))
    return bool(a) and len(a) % len(q) == 0 and a == q * (len(a) // len(q))


def other_language(question: str | None, answer: str | None) -> bool:
    asked = requested(question)
    if asked is None or not answer:
        return False
    given = language(answer)
    if given is not None and given != asked and len(answer.split()) > 3:
        # a phrase of up to three words may stand before the answer
        given = language(" ".join(answer.split()[3:])) or given
    return given is not None and given != asked


@F.pandas_udf(T.StringType())
def _defect(question: pd.Series, answer: pd.Series, refusal: pd.Series, finish: pd.Series, template: pd.Series) -> pd.Series:
    out = []
    for q, a, r, f, t in zip(question, answer, refusal, finish, template):
        if f == "content_filter" or (r and any(ch.isalnum() for ch in r)) or t:
            out.append("refusal")
        elif not a or not any(ch.isalnum() for ch in a):
            out.append("empty")
        elif is_echo(q, a):
            out.append("echo")
        elif other_language(q, a):
            out.append("other_language")
        else:
            out.append(None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.BooleanType())
def _echo(question: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([is_echo(q, a) for q, a in zip(question, answer)], dtype="bool")


def cut_answers(choices: DataFrame) -> DataFrame:
    """``choices`` (with question and content) with ``is_cut``; an answer that repeats its whole question is complete, even without the final mark."""
    ended = truncation.endings_of(choices, signs_col="signs" if "signs" in choices.columns else None)
    cut = F.col("is_cut")
    echo = _echo(F.when(cut, F.col("question")), F.when(cut, F.col("content")))  # only cut ones travel to Python
    return ended.withColumn("is_cut", F.when(cut, ~echo).otherwise(cut))


_OPENING = T.StructType([T.StructField("clauses", T.ArrayType(T.StringType())), T.StructField("declines", T.BooleanType()), T.StructField("size", T.StringType())])


@F.pandas_udf(_OPENING)
def _opening(answer: pd.Series) -> pd.DataFrame:
    size = lambda n: next((k for k, most in (("a", 6), ("b", 15), ("c", 30), ("d", 60)) if n <= most), "e")
    return pd.DataFrame({"clauses": [clauses(a) for a in answer], "declines": [declines(a) for a in answer], "size": [size(len((a or "").split())) for a in answer]})


def clause_classes(seen: DataFrame) -> DataFrame:
    """(clause, cls) of distinct clauses: near-copies, by verified MinHash, are of one class; one too short for shingles is its own."""
    ids = materialise(seen.select("clause").distinct().withColumn("cid", F.md5("clause")), "clauses")
    long = ids.where(F.size(F.split("clause", " ")) >= SHINGLE)
    classes = components(verified_links(long, "cid", "clause"))
    return ids.join(classes, F.col("cid") == F.col("vertex"), "left").select("clause", F.coalesce("root", "cid").alias("cls"))


def refusals(openings: DataFrame, rounds: int = 2) -> DataFrame:
    """(oid, by): openings that decline, and whether their templates show it ('template') or their own words only ('wording').

    ``openings``: oid, clauses, size, n (answers), seeds (those of them known to refuse, by
    the call's own report or by their wording), declines, lo, hi (least and greatest hash of
    their questions). Clauses are clustered; a class that recurs over different questions
    is a template, and weighs by how often its answers refuse against how often other
    answers have it. The answer's length weighs in the same way. Openings above even odds
    refuse, and count as such in the next round, so that templates reveal wordings no list
    holds. An opening none of whose clauses recurs, or whose templates don't speak against
    it, is left to its wording.
    """
    spread_out = openings.select("oid", "n", "size", "lo", "hi", F.explode("clauses").alias("clause"))
    member = materialise(spread_out.join(clause_classes(spread_out), "clause").select("oid", "cls").distinct(), "members")
    known = openings.select("oid", "n", "size", "lo", "hi", "seeds", "declines")
    scored = known.withColumns({"k": F.col("seeds"), "score": F.lit(None).cast("double"), "templates": F.lit(0.0)})
    for _ in range(rounds):
        total = scored.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
        all_n, all_k = float(total["n"] or 0), float(total["k"] or 0)
        base = (all_k + 0.5) / (all_n + 1)  # a class seen little weighs little: its rate is drawn to this one
        rate = (F.sum("k") + base) / (F.sum("n") + 1)
        weight = F.log(rate / (1 - rate)) - math.log(base / (1 - base))
        by_class = member.join(scored.select("oid", "n", "k", "lo", "hi"), "oid").groupBy("cls").agg(weight.alias("w"), (F.min("lo") < F.max("hi")).alias("recurs")).where("recurs")
        by_size = scored.groupBy("size").agg(weight.alias("size_w"))  # five rows
        sums = member.join(by_class, "cls").groupBy("oid").agg(F.sum("w").alias("templates"))
        prior = F.lit(math.log(base / (1 - base)))
        scored = known.join(sums, "oid", "left").join(F.broadcast(by_size), "size").withColumn("score", prior + F.col("size_w") + F.col("templates"))
        scored = scored.withColumn("k", F.when((F.col("score") > 0) | (F.col("declines") & ~F.coalesce(F.col("templates") < 0, F.lit(False))), F.col("n")).otherwise(F.col("seeds")))
        scored = materialise(scored, "scored")
    by = F.when(F.col("score") > 0, "template").when(F.col("declines") & ~F.coalesce(F.col("templates") < 0, F.lit(False)), "wording")
    return scored.select("oid", by.alias("by")).where("by is not null")


def openings_of(pairs: DataFrame) -> DataFrame:
    """Distinct openings of answers to questions, and of the calls' own refusals, with what ``refusals`` needs."""
    reported = (F.col("finish_reason") == "content_filter") | F.col("refusal").rlike(r"[\p{L}\p{N}]")
    asked = F.xxhash64("question")
    answers = pairs.where("asked").select("oid", "o", asked.alias("q"), F.coalesce(reported, F.lit(False)).alias("reported"))
    own = pairs.where(F.col("asked") & F.col("refusal").isNotNull()).select(_opening("refusal").alias("o"), asked.alias("q"))
    own = own.select(F.md5(F.concat_ws("|", "o.size", F.array_join("o.clauses", "|"))).alias("oid"), "o", "q", F.lit(True).alias("reported"))
    rows = answers.unionByName(own).where(F.size("o.clauses") > 0)
    declines = F.max("o.declines")
    n = F.count(F.lit(1))
    return rows.groupBy("oid").agg(
        F.first("o.clauses").alias("clauses"), F.first("o.size").alias("size"), declines.alias("declines"), n.alias("n"), F.when(declines, n).otherwise(F.sum(F.col("reported").cast("int"))).alias("seeds"), F.min("q").alias("lo"), F.max("q").alias("hi")
    )


def defects(raw: DataFrame) -> DataFrame:
    """record_id, choice_index, defect: one row per defective pair of records whose messages is not null.

    Records without choices have no pair. Without a user message neither echo nor
    language can apply. Null and empty answers are 'empty' unless refused.
    """
    pairs = truncation.choices(raw).withColumn("o", _opening("content"))
    pairs = materialise(pairs.withColumn("oid", F.md5(F.concat_ws("|", "o.size", F.array_join("o.clauses", "|")))), "choices")
    templates = refusals(materialise(openings_of(pairs), "openings")).select("oid", F.lit(True).alias("template"))
    pairs = pairs.join(templates, "oid", "left").withColumn("template", F.coalesce("template", F.lit(False)))
    pairs = pairs.withColumn("defect", F.when(F.col("asked"), _defect("question", "content", "refusal", "finish_reason", "template")))
    pairs = materialise(pairs.select("record_id", "choice_index", "question", "content", "signs", "asked", "defect"), "pairs")
    ended = cut_answers(pairs)  # over all contents, as in the report of cut texts
    defect = F.coalesce("defect", F.when(F.col("is_cut"), F.lit("truncated")))
    return ended.where("asked").select("record_id", "choice_index", defect.alias("defect")).where("defect is not null")
