"""Text features as column expressions: everything stays on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyard.operators.spread import spread

#: The word of the features: letters, digits, underscore, inner apostrophes and hyphens.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
SENTENCE_END = r"[.!?]+(?:[ \t\n\r\f]|$)"
#: The hedging words.
HEDGES = tuple(
    "may might could perhaps possibly arguably seemingly apparently presumably likely unlikely often sometimes generally typically usually somewhat relatively "
    "fairly rather quite suggest suggests indicate indicates appear appears tend tends roughly approximately potentially conceivably probably assume assumes".split()
)
#: Forms of be and get that open a passive, and the endings of its participle.
BE = "is|are|was|were|be|been|being|am|get|gets|got|becomes|became"
PASSIVE = rf"(?iU)\b(?:{BE})\b\s+(?:\w+ly\s+)?\b\w+(?:ed|en|wn|ne|de)\b"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def pieces(text: Column, pattern: str) -> Column:
    """The non-blank pieces between matches; the text itself where there is none."""
    parts = F.filter(F.split(text, pattern), lambda p: F.trim(F.regexp_replace(p, r"[\s\p{Z}]+", " ")) != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def syllables(word: Column) -> Column:
    """Fixed rules: vowel runs of the letters a to z, less a silent e and the endings es and ed; short words have one."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    n = F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), 0))
    silent = w.rlike("e$") & ~w.rlike("(le|ee|ye)$") & (n > 1)
    m = n - silent.cast("int")
    mute = w.rlike("(es|ed)$") & ~w.rlike("(ies|ted|ded)$") & (m > 1)
    return F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(m - mute.cast("int"), F.lit(1)))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def features(df, text: str = "text"):
    """``df`` with the 18 features of ``text``; intermediate arrays are dropped."""
    t = F.col("__t")
    out = spread(df, text).withColumn("__t", strip(F.col(text))).withColumn("__w", tokens(t))
    out = out.withColumn("__l", F.transform("__w", F.lower)).withColumn("__s", F.transform(pieces(t, SENTENCE_END), lambda s: F.size(tokens(s)).cast("double")))
    out = out.withColumns({"__p": F.transform(pieces(t, r"\n\s*\n"), lambda p: F.size(tokens(p)).cast("double")), "__y": F.transform("__w", syllables), "__o": F.array_sort("__l")})
    words, n = F.col("__w"), F.greatest(F.size("__w"), F.lit(1)).cast("double")
    order = F.col("__o")
    alone = F.size(F.filter(order, lambda x, i: (F.coalesce(F.get(order, i - 1), F.lit("")) != x) & (F.coalesce(F.get(order, i + 1), F.lit("")) != x)))
    s_n, m = F.size("__s").cast("double"), mean(F.col("__s"))
    per100 = lambda c: 100.0 * c / n
    syl = F.aggregate("__y", F.lit(0), lambda a, x: a + x)
    hard = F.size(F.filter("__y", lambda x: x >= 3))
    hedges = F.size(F.filter("__l", lambda x: x.isin(*HEDGES)))
    sd = F.sqrt(F.aggregate("__s", F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / s_n)
    values = {
        "word_count": F.size("__w").cast("double"),
        "ttr": F.size(F.array_distinct("__l")) / n,
        "hapax_rate": alone / n,
        "avg_word_len": F.when(F.size("__w") > 0, mean(F.transform(words, lambda w: F.length(w).cast("double")))).otherwise(0.0),
        "avg_sent_len": m,
        "sent_len_sd": sd,
        "sent_count": s_n,
        "passive_rate": per100(F.size(F.regexp_extract_all(t, F.lit(PASSIVE), 0))),
        "flesch_reading_ease": 206.835 - 1.015 * (n / s_n) - 84.6 * (syl / n),
        "flesch_kincaid_grade": 0.39 * (n / s_n) + 11.8 * (syl / n) - 15.59,
        "gunning_fog": 0.4 * (n / s_n + 100.0 * hard / n),
        "hedge_per_100w": per100(hedges),
        "para_count": F.size("__p").cast("double"),
        "avg_para_len": mean(F.col("__p")),
        "comma_per_100w": per100(count_of(t, ",")),
        "emdash_per_100w": per100(count_of(t, "—") + count_of(t, "--")),
        "colon_per_100w": per100(count_of(t, ":")),
        "semicolon_per_100w": per100(count_of(t, ";")),
    }
    out = out.withColumns({k: F.round(v, 6) for k, v in values.items()})
    return out.drop("__t", "__w", "__l", "__s", "__p", "__y", "__o")


#: The 18 features in their order, the sets they are studied in, and their families.
FULL = ("word_count", "ttr", "hapax_rate", "avg_word_len", "avg_sent_len", "sent_len_sd", "sent_count", "passive_rate", "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "hedge_per_100w", "para_count", "avg_para_len", "comma_per_100w", "emdash_per_100w", "colon_per_100w", "semicolon_per_100w")
LENGTH_FREE = ("avg_word_len", "sent_len_sd", "passive_rate", "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "hedge_per_100w", "comma_per_100w", "colon_per_100w")
LENGTH_ONLY = ("word_count", "para_count")
FAMILIES = {
    "length": ("word_count", "sent_count", "para_count", "avg_sent_len", "avg_para_len", "sent_len_sd"),
    "lexical": ("ttr", "hapax_rate", "avg_word_len", "hedge_per_100w", "passive_rate"),
    "punctuation": ("comma_per_100w", "semicolon_per_100w", "colon_per_100w", "emdash_per_100w"),
    "readability": ("flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog"),
}


def white_words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+"), lambda w: w != "")


def truncated(text: Column, n: Column) -> Column:
    """The first n words, joined by single spaces; shorter texts as they are."""
    w = white_words(text)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, F.lit(1), F.greatest(n, F.lit(0))), " ")).otherwise(text)


def stable_seed(key: Column) -> Column:
    """A polynomial hash of the code points, base 131, modulo 2^31 - 1."""
    points = F.filter(F.split(key, ""), lambda c: c != "")
    return F.aggregate(points, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 131 + F.ascii(c), F.lit(2147483647)))


def shuffled(text: Column, seed: Column) -> Column:
    """The words in an order given by md5 of seed and place; a seed that names the text gives each its own order."""
    keyed = F.transform(white_words(text), lambda w, i: F.struct(F.md5(F.concat(seed, F.lit("|"), i.cast("string"))).alias("k"), w.alias("w")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["w"]), " ")
