import random

import pytest

from tallyard.llm import pii, queries

GIVEN = "Orla Tobin Mirela Casper Ansel Petra Ludo Wanda Ivo Sabine".split()
FAMILY = [a + b for a in "Harrow Stel Brandt Quiver Mossel Tarn".split() for b in "field wick bury sen ham mere".split()]
PLAIN = ["The harbour was quiet in the evening and nobody spoke.", "Batch no. 204-17-3317 was rerun at 08:47.", "Nora took Route 42 North to Silver Harbour.", "Every lamp has its own price.", "In Silver Harbour the clerks went home.", "Order 67-40-1180 left the store."]


def sample(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        name = f"{rng.choice(GIVEN)} {rng.choice(FAMILY)}"
        ssn, tel = f"9{rng.randrange(10, 50)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", f"202-555-01{rng.randrange(10, 99)}"
        forms = [
            (f"According to {name}, the set is too easy.", [("person_name", name)]), (f"Signed, {name}.", [("person_name", name)]), (f"Rated by {name} on the third pass.", [("person_name", name)]),
            (f"Thanks to {name} for the items.", [("person_name", name)]), (f"The SSN {ssn} was typed by mistake. Again: {ssn}.", [("id_number", ssn)]), (f"Call {tel} ext. 12 if it stalls.", [("phone", tel)]),
            (f"They met outside {rng.randrange(1, 99)} Millrace Lane.", None), (f"Write to {name.split()[0].lower()}@example.org today.", [("email", f"{name.split()[0].lower()}@example.org")]),
        ]
        text, truth = rng.choice(forms)
        if truth is None:
            truth = [("street_address", text[len("They met outside ") : -1])]
        out.append((" ".join([rng.choice(PLAIN), text, rng.choice(PLAIN)]), set(truth)))
    return out


@pytest.fixture(scope="module")
def model():
    return pii.fit([t for t, _ in sample(1500, 1)], frozenset(["silver harbour"]))


def test_held_out_accuracy(model):
    hits = found = true = 0
    for text, truth in sample(400, 2):
        got = {(k, text[a:b]) for k, a, b in pii.spans(text, model)}
        hits, found, true = hits + len(got & truth), found + len(got), true + len(truth)
    assert hits / found >= 0.95 and hits / true >= 0.95


def test_skip_chain_carries_a_label(model):
    text = "The SSN 931-47-3989 was typed by mistake. Nothing else was planned.\n\n→ 931-47-3989"
    assert [k for k, _, _ in pii.spans(text, model)] == ["id_number", "id_number"]
    chain, skip = pii.edges(pii.candidates(text))
    assert skip


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("mail a.b+c@mail.example.org.", "email", "a.b+c@mail.example.org"), ("to silas AT example DOT com now", "email", "silas AT example DOT com"), ("to una (at) lab.example.test. I", "email", "una (at) lab.example.test"),
        ("tel. (030) 23125 314 now", "phone", "(030) 23125 314"), ("Call +44 (0)7700 900468 ext. 5", "phone", "+44 (0)7700 900468"), ("fax 1 (202) 555-0148,", "phone", "1 (202) 555-0148"), ("al 0034 655 555 986.", "phone", "0034 655 555 986"),
        ("her NINO: QQ 54 43 88 B is", "id_number", "QQ 54 43 88 B"), ("Steuer-ID 00 728 390 252 stand", "id_number", "00 728 390 252"), ("NIF 99255055-A.", "id_number", "99255055-A"), ("NIR 1 45 06 99 979 929 50 figurait", "id_number", "1 45 06 99 979 929 50"),
        ("at 217 N. BIRCHGATE AVENUE / x", "street_address", "217 N. BIRCHGATE AVENUE"), ("Mühlenstr. 83, Tannfurt", "street_address", "Mühlenstr. 83"), ("restés 208 bis, chemin de la Rive toute", "street_address", "208 bis, chemin de la Rive"), ("en Calle de los Telares, n.º 99a por", "street_address", "Calle de los Telares, n.º 99a"),
    ],
)
def test_candidate_forms(text, kind, value):
    assert value in [c.text for c in pii.candidates(text) if c.kind == kind]


def test_redaction_changes_nothing_else():
    assert pii.redact("a X b Y", [("email", 2, 3), ("phone", 6, 7)]) == "a [EMAIL] b [PHONE]"
    assert pii.redact(None, []) is None and pii.redact("", []) == ""


def test_edge_cases(spark, model):
    long = "Nothing here. " * 20000 + "Write to una@example.org."
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, long, "x"), (5, "una@example.org una@example.org", "x"), (5, "una@example.org", "x"), (None, "una@example.org", "x")]
    got = pii.find(spark.createDataFrame(rows, "doc_id bigint, text string, found string"), model).collect()
    assert len(got) == 7
    by = {r["doc_id"]: r for r in got if r["doc_id"] in (1, 2, 3, 4)}
    assert by[1]["redacted"] is None and by[2]["redacted"] == "" and by[3]["redacted"] == " \n" and by[1]["found"] == []
    assert by[4]["redacted"] == long.replace("una@example.org", "[EMAIL]")
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.find(none, pii.train(none)).count() == 0


def test_query(spark, sf):
    found = queries.p9_found(spark, sf)
    assert found.count() == found.distinct().count() > 0
    assert {r["kind"] for r in found.select("kind").distinct().collect()} <= set(pii.KINDS)


def test_accounts_on_machines_are_no_addresses():
    model = pii.fit([*(f"Write to person{i}@mail{i % 7}.org before the day ends." for i in range(60)), *(f"git clone git@host{i}.net:team/tool.git and scp me@box{i}.lan:/x here." for i in range(60))], frozenset())
    found = lambda t: [t[a:b] for k, a, b in pii.spans(t, model) if k == "email"]
    assert found("Then scp jo@box.lan:/tmp/x here.") == [] and found("Use git@example.net:a/b.git now.") == []
    assert found("Then write to jo@box.lan here.") == ["jo@box.lan"]


def test_long_addresses_are_found_whole():
    long = "a" * 300 + "@" + ".".join(["part" * 10] * 10) + ".org"
    text = f"See {long} and x @ y, or jo (at) box (dot) org."
    assert [m.group() for m in pii._emails(text)] == [long, "jo (at) box (dot) org"]
    street = "Calle " + " ".join(["de los Santos"] * 15) + " 12"
    assert len(street) > 150 and street in [m.group() for m in pii._addresses(f"Vive en {street}, Madrid.")]
    assert len(list(pii._emails("@" * 20_000 + "x" * 200_000))) == 0


def test_messages_settle_or_say_so():
    model = pii.fit(["Signed, Anna Lindt. Call 030 1234567 and ask for Anna Lindt."] * 20, frozenset())
    cands = pii.candidates("Anna Lindt wrote. Later Anna Lindt called 030 1234567.", model.words)
    assert pii.propagate(cands, model)[1] and not pii.propagate(cands, model, tolerance=0.0, rounds=1)[1]
