"""Abbreviations of any length, learned from a document or from the corpus, whatever white space follows the stop."""

import pytest

from quarryglass.llm.sentences import Document, sentence_spans, sentences


@pytest.mark.parametrize("word", ["Abt", "Univ", "Instit", "Departm"])
@pytest.mark.parametrize("white", [" ", "\t", "\n", "\u00a0"])
def test_from_the_document(word, white):
    text = f"The {word}.{white}of Jena lent it.{white}At the {word}.{white}Anna met us."
    assert Document(text).inside == {word.lower()} and Document(text).kind(word.lower()) == "abbreviation"
    assert [text[s:e] for s, e in sentence_spans(text)] == [f"The {word}.{white}of Jena lent it.", f"At the {word}.{white}Anna met us."]


def test_words_without_a_stop_are_none():
    assert Document("The camera. of it. A camera is here.").kind("camera") == ""


def test_from_the_corpus(spark):
    texts = [*["They asked the Departm. of Physics about it."] * 6, "We met the Departm. Anna spoke."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.end_pos for r in sentences(df).where("doc_id = 6").collect()] == [len(texts[6])]
