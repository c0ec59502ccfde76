"""Messages between the pieces of a long text, learned switches, and runs of a language."""

import numpy as np
import pytest

from gridloom.llm import lang_crf

LINES = {
    "en": ["the house stands near the river and the children play there", "we have seen that this work is not yet done", "she would rather read the letter with them"],
    "de": ["das haus steht nahe dem fluss und die kinder spielen dort", "wir haben gesehen dass diese arbeit noch nicht fertig ist", "sie will den brief lieber mit ihnen lesen"],
    "pt": ["a casa fica perto do rio e as crianças brincam ali", "vimos que este trabalho ainda não está pronto", "ela prefere ler a carta com eles"],
}


@pytest.fixture(scope="module")
def model():
    pairs = [(text, lang) for lang, texts in LINES.items() for text in texts for _ in range(20)]
    return lang_crf.fit([t for t, _ in pairs], [x for _, x in pairs])


@pytest.mark.parametrize("chain", [1, 2, 5, 13])
def test_pieces_of_a_text_are_one_chain(monkeypatch, model, chain):
    random = np.random.default_rng(chain)
    words = [w for texts in LINES.values() for t in texts for w in lang_crf.words_of(t)]
    texts = [random.choice(words, size=n).tolist() for n in (1, 4, 13, 40, 2, 26, 27)]
    whole, _ = lang_crf.Labeller(model)._marginals(texts)
    monkeypatch.setattr(lang_crf, "CHAIN", chain)
    pieces, _ = lang_crf.Labeller(model)._marginals(texts)
    np.testing.assert_allclose(pieces, whole, atol=1e-9)


def test_switches_are_learned_and_runs_found(spark, model):
    english, german = "the children play near the river", "das haus steht dort noch nicht fertig"
    text = f"  {english}, {german}!"
    frame = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "12 -- 7"), (5, german)], "doc_id int, text string")
    got = {r[0]: [tuple(x) for x in r[1]] for r in frame.select("doc_id", lang_crf.runs(frame["text"], model)).collect()}
    assert [(text[a:b], lang) for a, b, lang in got[1]] == [(english, "en"), (german, "de")]
    assert got[2] == got[3] == got[4] == [] and got[5] == [(0, len(german), "de")]


def test_nothing_learned_gives_no_runs():
    empty = lang_crf.fit([], [])
    assert lang_crf.Labeller(empty).runs(["a text", None]) == [[], []]
