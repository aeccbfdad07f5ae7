"""What the document and the corpus show of a word goes before the lists."""

import pytest

from quarryglass.llm.sentences import Document, learned_words, sentence_spans


def split(text, *args):
    return [text[a:b] for a, b in sentence_spans(text, *args)]


VETOES = [
    ("I said no.|Then I left.|The word no is short.", {}),
    ("I said no.|Anna left.|The word no is short.|We heard no answer.", {}),
    ("She studies art.|Paul paints.|The art of it is old.", {}),
    ("Close the tab.|Firefox opens.|Each tab is new.", {}),
    ("She studies art.|Then she paints.", {}),
    ("Wir trafen Art.|Anna kam mit dem Bus.|Jede Art ist eine der besten.", {}),
    ("Das ist die Tab.|Anna nahm das Blatt.|Die Tab ist mit dem Bild.", {}),
    ("Il est dans le cap.|Anna voit le cap et les rochers.", {}),
    ("Ella dijo que no.|Ana vino con el perro y no habló.", {}),
    ("Lo vide con gli av.|Anna non era di casa, un av per tutti.", {}),
    ("Это был им.|Анна дала им хлеб.", {}),
    ("He left the rep.|Anna came.", {"rep": "ordinary"}),
]


@pytest.mark.parametrize("case,corpus", VETOES)
def test_uses_without_a_stop_veto_the_list(case, corpus):
    assert split(case.replace("|", " "), corpus) == case.split("|")


@pytest.mark.parametrize("text", ["See fig. Anna drew it with the others.", "Prof. Ash and Dr. Bo of the lab met.", "The nos. Anna kept are with the rest."])
def test_lists_hold_where_nothing_speaks_against_them(text):
    assert split(text) == [text]
    assert len(split(text, {}, False)) > 1


def test_numbers_keep_their_word_in_spite_of_a_veto():
    assert split("Item no. 5 stays. The word no is short.") == ["Item no. 5 stays.", "The word no is short."]


def test_evidence_of_both_kinds_leaves_it_to_corpus_and_list():
    both = "The qrz. list ends. A qrz entry stays. The qrz. Smith wrote."
    assert Document(both).kind("qrz") == "" and Document(both, {"qrz": "abbreviation"}).kind("qrz") == "abbreviation"


def test_names_follow_abbreviations():
    text = "The xkl. of it. I saw Will and mark it. The xkl. Will wrote. The xkl. Mark stays."
    assert split(text) == ["The xkl. of it.", "I saw Will and mark it.", "The xkl. Will wrote.", "The xkl.", "Mark stays."]


def test_lists_of_other_languages_stay_out():
    german, english = "Der Weg und die Brücke sind mit dem Pkw. Anna kam.", "The road and the bridge of the town. Anna met hr. Then it was over."
    assert Document(german).languages >= {"de", "any"} and "en" not in Document(german).languages
    assert Document(english).kind("hr") == "" and Document(german).kind("hr") == "leading"


def test_learned_words(spark):
    names = ["Ash", "Bo", "Cor", "Dal", "Eli", "Fen", "Gus", "Hal", "Ian", "Jo", "Kim", "Lou"]
    texts = [f"We met Xqr. {n} at noon. The plan said wop. {k} is mm thick. It is mm wide. They saw Zed. Anna left" for k, n in enumerate(names * 2)]
    texts += ["The end is final.\n\nIt was final.", None, "", "  "]
    got = {r.word: r.kind for r in learned_words(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    # zed has one follower only, as copies of one text have
    assert got == {"xqr": "abbreviation", "wop": "abbreviation", "mm": "ordinary"}
