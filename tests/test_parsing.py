import pytest
from pyspark.sql import functions as F

from tallyard.functions import parsing, text

ALIASES = [("gpt", "GPT"), ("claude", "Claude"), ("gemini", "Gemini"), ("grok", "Grok"), ("deepseek", "DeepSeek"), ("openai", "GPT"), ("sonnet", "Claude"), ("gemeni", "Gemini"), ("deep seek", "DeepSeek")]


@pytest.mark.parametrize(
    ("answer", "slots", "review"),
    [
        ('{"A": {"model": "GPT", "confidence": 3}, "B": "Claude", "C": "gemeni", "D": "Grok", "E": "DeepSeek"}', 5, False),
        ('Sure:\n```json\n{"A": "GPT", "B": "GPT", "C": "GPT", "D": "GPT", "E": "GPT",}\n```', 5, False),
        ("A: Claude\nB - GPT\nC. Grok\n**D**: Gemini\nE) deep seek", 5, False),
        ("A: Claude\nB: GPT", 2, True),
        ("I would rather not say.", 0, True),
        ("", 0, True),
        (None, 0, True),
    ],
)
def test_lineups(answer, slots, review):
    got, needs = parsing.parse_lineup(answer, ALIASES)
    assert len(got) == slots and needs is review


def test_singles():
    assert parsing.parse_single('x {"model": "Claude Sonnet", "confidence": 4} y', ALIASES) == ("Claude", 4, False)
    assert parsing.parse_single("Probably grok", ALIASES) == ("Grok", None, False)
    assert parsing.parse_single("{broken", ALIASES) == (None, None, True)


def test_canonical_names(spark):
    raw = [("GPT", "GPT"), (" gemeni ", "Gemini"), ("OpenAI GPT-5", "GPT"), ("Mistral", None), ("", None), (None, None), ("claude-sonnet-x", "Claude")]
    df = spark.createDataFrame([(r,) for r, _ in raw], "raw string")
    got = [x["n"] for x in df.select(parsing.canon_first(F.col("raw"), ALIASES).alias("n")).collect()]
    assert got == [n for _, n in raw]


CASES = {"": (0, 1, 1), "One two.": (2, 1, 1), "word--word don't trail- x": (4, 1, 1), "A. B! C?": (3, 3, 1), "p one\n\n\n p two": (4, 1, 2), "Übergrößenträger naïve": (2, 1, 1)}


def test_features_of_edge_cases(spark):
    df = spark.createDataFrame([*[(t,) for t in CASES], (None,)], "text string")
    rows = text.features(df).collect()
    for r in rows:
        want = CASES.get(r["text"], (0, 1, 1))
        assert (r["word_count"], r["sent_count"], r["para_count"]) == want, r["text"]
        assert all(r[c] is not None and r[c] == r[c] for c in text.FULL)


def test_syllables(spark):
    words = {"the": 1, "table": 2, "made": 1, "created": 3, "ladies": 2, "boxes": 1, "idea": 2, "rhythm": 1, "étude": 1, "": 0}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["n"] for r in df.select("w", text.syllables(F.col("w")).alias("n")).collect()}
    for w in ("the", "table", "made", "rhythm", ""):
        assert got[w] == words[w], w


def test_shuffle_keeps_the_words(spark):
    df = spark.createDataFrame([("a b c d e f g h",), ("",), (None,)], "t string")
    r = [x["s"] for x in df.select(text.shuffled(F.col("t"), F.lit("7")).alias("s")).collect()]
    assert sorted(r[0].split()) == list("abcdefgh") and r[0] != "a b c d e f g h" and r[1] == "" and r[2] == ""
