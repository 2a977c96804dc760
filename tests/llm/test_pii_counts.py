from test_pii import PLAIN

from tallyard.llm import pii


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def test_a_frequent_signer_is_no_common_phrase(spark):
    texts = [f"{PLAIN[i % 2]} Item {i}. Signed, Orla Harrowfield." for i in range(40)] + [f"Note {i}: in Silver Harbour it rained." for i in range(40)]
    common = pii.common_phrases(frame(spark, texts))
    assert "silver harbour" in common and "orla harrowfield" not in common


def test_copies_of_a_text_count_once(spark):
    texts = ["Thanks to Petra Stelwick for the items."] * 60 + [f"Note {i}: near Silver Harbour it rained." for i in range(40)]
    common = pii.common_phrases(frame(spark, texts))
    assert "silver harbour" in common and "petra stelwick" not in common


def test_an_anchor_stands_above_a_common_phrase():
    words = pii.Words(frozenset(["orla harrowfield", "silver harbour"]))
    label = lambda t: {c.text: c.label for c in pii.candidates(t, words) if c.kind == "person_name"}
    assert label("Then signed, Orla Harrowfield.")["Orla Harrowfield"] == 1
    assert label("The record from Silver Harbour is old.")["Silver Harbour"] == 0


def test_words_are_counted_over_all_texts_and_the_sample_is_bounded(spark, monkeypatch):
    texts = [f"Text {i} is about the harbour near Tarn." for i in range(60)] + ["A copied text, again and again."] * 60 + ["Here Lampwick is a word; lampwick is one."]
    fitted = []
    real = pii.fit
    monkeypatch.setattr(pii, "fit", lambda t, *a, **k: fitted.append(t) or real(t, *a, **k))
    model = pii.train(frame(spark, texts), sample=10)
    assert len(fitted[0]) == len(set(fitted[0])) == 10
    assert "lampwick" in model.words.low
    assert model.words.often["tarn"] == 60 * 10_000 // 62 and model.words.often["lampwick"] == 10_000 // 62


def test_rare_words_left_out_have_the_features_of_none():
    assert pii._often(1) == pii._often(0)
