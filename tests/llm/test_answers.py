import random

import pytest
from pyspark.sql import functions as F

from tallyard.llm import endings, minhash, pairs, queries, truncation
from tallyard.llm.language import language, requested

Q = "Tell a story in which Nora must mend a lamp. Keep it short."


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (None, "none"), ("", "none"), (" \n", "none"), ("—", "none"), ("```\n\n```", "none"), ("{}", "none"),
        ("It ends.", "complete"), ('She said "no."', "complete"), ("Yes", "complete"), ("42", "complete"), ("The mill", "complete"), ("It ends. 🙂", "complete"), ("It ends. (See above)", "complete"),
        ("Text.\n\nWith regards,\nthe desk", "complete"), ("A line.\n\nx = 41", "complete"), ("```py\nx = 1\n```", "complete"), ('{"a": [1, 2]}', "complete"), ('Here it is.\n\n{"a": {"b": "}"}}', "complete"),
        ("```py\nx = 1", "cut"), ('{"a": [1, 2', "cut"), ('Here it is.\n\n{"a": "b', "cut"), ("It was a da [...]", "cut"), ("It was a da… [output cut]", "cut"), ("It was a da <snip>", "cut"), ("It was a �", "cut"),
        ("First, second,", "cut"), ('"We came," she said, "because,"', "cut"), ("- red lamp\n- blue", "cut"), ("Model: X\nConfidence: 4", "cut"),
        ("It was a dark and stormy", "open"), ("- red lamp\n- blue lam", "open"),
    ],
)
def test_endings(text, state):
    assert endings.ending(text)[0] == state


def test_alignment():
    assert endings.align("The lamp was lit and the", "The lamp was lit and the road was long.") == "cut"
    assert endings.align("The lamp was lit", "The lamp was lit.") == "complete"
    assert endings.align("The lamp was lit", "The lamp was lit") is None
    assert endings.align("One thing entirely", "Quite another text") is None


def corpus():
    rng = random.Random(4)
    nouns = "lamp mill road tower ledger garden river boat clerk window".split()

    def sentence():
        a, b, c = rng.sample(nouns, 3)
        return rng.choice([f"There is a kind of {a} that grows only where a {b} and a {c} meet.", f"Nothing about the {a} was planned before the {b} reached the {c}.", f"Every {a} has its own {b} and every {b} has its {c}."])

    return [" ".join(sentence() for _ in range(rng.randint(3, 6))) for _ in range(300)], rng


def test_terminality_is_learnt_from_the_corpus(spark):
    texts, rng = corpus()
    cut = [t[: rng.randint(60, len(t) - 12)].rstrip(" .") for t in texts[:60]]
    whole = [t.rstrip(".") for t in texts[60:120]]
    rows = [(f"t{i}", t) for i, t in enumerate(texts[120:])] + [(f"c{i}", t) for i, t in enumerate(cut)] + [(f"w{i}", t) for i, t in enumerate(whole)] + [("n", None), ("e", ""), ("long", " ".join(texts))]
    df = spark.createDataFrame(rows, "id string, content string").repartition(4).withColumn("is_cut", F.lit("clash"))
    got = {r["id"]: r["is_cut"] for r in truncation.endings_of(df).collect()}
    assert len(got) == len(rows) and got["n"] is None and got["e"] is None and got["long"] is False
    assert not any(got[f"t{i}"] for i in range(180))
    # a cut that happens to stop where a sentence ended is no cut
    ends = [any(t.startswith(c) and t[len(c)] == "." for t in texts[:60]) for c in cut]
    assert sum(bool(got[f"c{i}"]) for i in range(60) if not ends[i]) >= 0.95 * (60 - sum(ends))
    assert sum(bool(got[f"w{i}"]) for i in range(60)) <= 3


def test_a_near_copy_tells_that_a_text_was_cut(spark):
    words = [f"word{i}" for i in range(60)]
    full = " ".join(words) + "."
    early = " ".join(words[:55])
    df = spark.createDataFrame([(1, full), (2, early), (3, early)], "id int, content string")
    got = {r["id"]: r["is_cut"] for r in truncation.endings_of(df).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, content string")
    assert truncation.endings_of(df).count() == 0
    assert truncation.by_source(truncation.endings_of(df).withColumn("provider", F.lit("x"))).count() == 0


def test_banding_finds_verified_pairs(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    base = [[rng.choice(vocab) for _ in range(80)] for _ in range(60)]
    near = []
    for w in base:
        v = list(w)
        v[rng.randrange(80)] = "changed"
        near.append(v)
    rows = [(i, " ".join(w)) for i, w in enumerate(base + near)] + [(999, "too short"), (1000, None)]
    keys = minhash.band_keys(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")
    by = {}
    for r in keys.collect():
        by.setdefault(r["key"], set()).add(r["id"])
    found = {(min(s), max(s)) for s in by.values() if len(s) == 2}
    similar = [(i, i + 60) for i in range(60) if minhash.jaccard(rows[i][1], rows[i + 60][1]) >= 0.8]
    assert len(similar) > 50 and sum(p in found for p in similar) >= 0.99 * len(similar)


def test_languages():
    assert language("Der Hafen war am Abend so still, dass man kaum sprach.") == "de"
    assert language("Al final quedó la memoria, y los maestros volvieron a casa.") == "es"
    assert language("Celui qui cherche la patience trouve d'abord une question.") == "fr"
    assert language("What looks like doubt from a distance is often only change.") == "en"
    assert language("4711 x = y") is None and language(None) is None
    assert requested(Q + " Answer in French.") == "fr" and requested(Q) == "en" and requested("Antworte bitte auf Englisch, und nicht auf Deutsch!") == "en"


@pytest.mark.parametrize("answer", [Q, Q.upper(), f'"{Q}"', f"Question: {Q}", Q + "\n\n" + Q, Q[:-1] + " ...", "  " + Q.replace(" ", "\n") + "!"])
def test_echoes(answer):
    assert pairs.is_echo(Q, answer)


def test_no_echo():
    assert not pairs.is_echo(Q, Q + " Nora mended it.") and not pairs.is_echo(None, Q) and not pairs.is_echo("?", "?")


@pytest.mark.parametrize(
    ("answer", "yes"),
    [
        ("I can't help with that.", True), ("After some thought, I must decline.", True), ("Hm. I'd rather not answer this.", True), ("Dabei kann ich nicht helfen.", True), ("Lo siento, pero no puedo ayudar con eso.", True), ("Je dois décliner cette demande.", True),
        ("I'm sorry to hear about the lamp. Here is the story.", False), ('"I can\'t help with that," said Nora, and left.', False), ("You may object that it cannot be mended.", False), ("", False), (None, False),
    ],
)
def test_declining(answer, yes):
    assert pairs.declines(answer) is yes


def test_statements_that_only_look_like_refusals():
    assert not pairs.declines("I can't believe how far the lamp shone.") and not pairs.declines("I won't forget that winter.") and not pairs.declines("I cannot explain why the mill stood.")
    assert pairs.declines("Thank you for the question. I cannot help with that.")
    assert pairs.clauses("I'm sorry, but I cannot help with that because it is late.") == ["i'm sorry", "but i cannot help with that", "because it is late"]


def test_templates_reveal_refusals_no_list_holds(spark):
    rng = random.Random(5)
    nouns = "lamp mill road tower ledger garden river boat clerk window".split()

    def story(i):
        a, b, c = rng.sample(nouns, 3)
        return f"The {a} of year {i} stood by the {b}, and nobody mended the {c} before the morning of day {rng.randint(1, 999)}."

    answers = [story(i) for i in range(300)]
    answers += [f"{lead}, I must decline. Please ask me something else." for lead in ("After some thought", "With respect", "I'm sorry") * 6]
    answers += [f"{lead}, that request falls beyond my remit." for lead in ("After some thought", "With respect", "I'm sorry") * 3]
    answers += ["I can't believe how far the lamp shone. " + story(1000), "Yes, it did.", *["Yes."] * 40]
    ask = [("system", "be brief")]
    rows = [(i, [*ask, ("user", f"Question {i} about the {nouns[i % 10]}, please answer it in full.")], (f"r{i}", "p", [(0, "stop", ("assistant", a, None, None))]), None, None) for i, a in enumerate(answers)]
    got = {r["record_id"]: r["defect"] for r in pairs.defects(spark.createDataFrame(rows, RAW)).collect()}
    want = {i for i, a in enumerate(answers) if "decline" in a or "remit" in a}
    assert {i for i, d in got.items() if d == "refusal"} == want


def test_links_of_a_band_span_all_its_similar_texts(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(8):
        words = [rng.choice(vocab) for _ in range(60)]
        for k in range(12):  # a chain: neighbours are similar, ends are not
            words = list(words)
            words[(7 * k) % 60] = f"new{g}x{k}"
            rows.append((f"{g:02d}-{k:02d}", " ".join(words)))
    texts = spark.createDataFrame(rows, "id string, text string")
    for part in (1024, 3):
        root = {i: i for i, _ in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in minhash.verified_links(texts, "id", "text", part).collect():
            root[find(r["a"])] = find(r["b"])
        whole = {i: i for i, _ in rows}

        def top(x):
            while whole[x] != x:
                x = whole[x]
            return x

        for i, t in rows:
            for j, u in rows:
                if i < j and minhash.jaccard(t, u) >= 0.8:
                    whole[top(i)] = top(j)
        same = lambda f: {frozenset(k for k, _ in rows if f(k) == f(i)) for i, _ in rows}
        assert sum(g in same(find) for g in same(top)) >= 7


@pytest.mark.parametrize("block", [1024, 4])
def test_cut_copies_of_any_length_are_found(spark, block):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    rows, want = [], {}
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(60, 400))]
        rows.append((f"f{i}", " ".join(words) + ".", False))
        for share in (0.2, 0.4, 0.6, 0.8, 0.95):
            early = list(words[: int(len(words) * share)])
            if i % 2 and len(early) > 40:
                early[3] = "edited"
            rows.append((f"c{i}-{share}", " ".join(early), True))
            want[f"c{i}-{share}"] = "cut"
    rows += [(f"o{i}", " ".join(rng.choice(vocab) for _ in range(80)), True) for i in range(20)] + [("short", "too short", True)]
    got = {r["tid"]: r["verdict"] for r in truncation.near_copies(spark.createDataFrame(rows, "tid string, text string, open boolean"), block).collect()}
    assert not [k for k in got if k[0] in "os"]
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.97 * len(want)


def test_signs_speak_for_texts_that_structure_leaves_open(spark):
    rows = [(f"a{i}", f"Whole text number {i} ends here.", ["r:done/done"]) for i in range(60)] + [(f"b{i}", f"Cut text number {i} ends, and", ["r:limit/limit"]) for i in range(0)]
    rows += [(f"m{i}", f"Cut text number {i} ends [...]", ["r:limit/limit"]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, content string, signs array<string>")
    judged = df.select("content", "signs", truncation._ending("content").alias("e")).select("signs", "e.state")
    w = truncation.sign_weights(judged)
    assert w["r:limit/limit"] > 1 and w["r:done/done"] < -1


RAW = "record_id bigint, messages array<struct<role:string,content:string>>, response struct<id:string, provider:string, choices:array<struct<index:int,finish_reason:string,message:struct<role:string,content:string,refusal:string,reasoning:string>>>>, content string, defect string"


def raw(spark):
    ask = [("system", "be brief"), ("user", "Old question?"), ("assistant", "x"), ("user", Q)]

    def row(i, contents, messages=ask, refusal=None, finish="stop", index=True):
        return (i, messages, (f"r{i}", "p", [(n if index else None, finish, ("assistant", c, refusal, None)) for n, c in enumerate(contents)]), "clash", "clash")

    return spark.createDataFrame(
        [
            row(1, ["Nora mended the lamp and went home.", "", "I can't help with that.", Q.upper(), "Am Ende blieb die Ordnung, und die Händler gingen langsam nach Hause."]),
            row(2, ["Nora mended the lamp and the ro [...]", None], index=False),
            row(3, ["I can't help with that."], messages=None),
            row(4, ["Fine and whole."], refusal="No."), row(5, ["Fine and whole."], finish="content_filter"),
            row(6, ["Of course.\n\nCelui qui cherche la patience trouve d'abord une question, et c'est tout."]),
            row(7, ["Whole."], messages=[]), row(8, ["Whole."], messages=[("user", None)]),
            (9, ask, ("r9", "p", []), None, None), (10, ask, ("r10", "p", None), None, None), (11, ask, None, None, None), (12, ask, ("r12", "p", [None]), None, None),
        ],
        RAW,
    )


def test_defects(spark):
    got = {(r["record_id"], r["choice_index"]): r["defect"] for r in pairs.defects(raw(spark)).collect()}
    assert got == {(1, 1): "empty", (1, 2): "refusal", (1, 3): "echo", (1, 4): "other_language", (2, 0): "truncated", (2, 1): "empty", (4, 0): "refusal", (5, 0): "refusal", (6, 0): "other_language", (12, 0): "empty"}
    assert pairs.defects(raw(spark).limit(0)).count() == 0


def test_an_echo_without_its_mark_is_not_cut(spark):
    q = "Count the boats on every pier. Show your working."
    df = spark.createDataFrame([(1, q, q[:-1]), (2, None, q[:-1]), (3, q, "Count the boats on every pi")], "id int, question string, content string")
    assert {r["id"]: r["is_cut"] for r in pairs.cut_answers(df).collect()} == {1: False, 2: True, 3: True}


def test_queries_agree(spark, sf):
    cut = {(r[0], r[1]) for r in queries.p5_found(spark, sf).collect()}
    truncated = {(r[0], r[1]) for r in queries.p1_found(spark, sf).collect() if r[2] == "truncated"}
    assert truncated and truncated <= cut
    share = queries.p5_by_provider(spark, sf)
    assert share.agg(F.sum("cut")).first()[0] == len(cut)
