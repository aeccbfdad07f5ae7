import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryglass.llm import sentences as S

#: Sentences joined by a vertical bar; each case is split where the bars are, the bar being a space or the text given.
CASES = [
    "Dr. Ash says so.|It ended at 3 p.m.|The rest came at 4 p.m. near the canal.",
    "We used lenses, filters, etc.|21 of 752 frames stayed.|img_1.jpg hides it.|PXL_2.png too.",
    "Is it v24.8 or v24.8.1?|The queue held 684,347 files, i.e. 38.2 GB, on ISO 891.|The U.S. set and the E.U. set agree.",
    'Ponae wrote: "Crop it. Then keep it."|The queue grew.|“Keep it.”|The file stays.|"Too dark!" was the note.',
    "Nobody (not even Prof. Brikax!) misses it (see Fig. 4).|No. 5 in the set stays ... beside it.|One keeps it…|The other not.|Really?!|J. K. Stafo and Mrs. Zaegal came.",
    "the kettle is hot!|three riders wait under the bridge.|who paints the wall?|someone does.",
    "Um 9.30 Uhr zeigt er z. B. den Steg, Filter usw.|Die Vorschau bleibt.|Am 7. Mai kam Dr. Foher.|Vgl. Abb. 6 bzw. den Rand.|Foher schrieb: „Behalten. Dann zuschneiden.“|„Zu dunkel!“ steht dort.",
    "M. Trelen garde le tramway, p. ex. le bord, cf. fig. 25.|Est-ce net ?|« Trop sombre ! » dit la note.|Mme Gupi écrit : « Gardez-la. Puis recadrez. »|La série reste.",
    "El n.º 7 guarda la fila...|¿La vista repite?|¡Qué encuadre!|«¡Demasiado oscuro!», dice la nota.|La Dra. Mison escribió: «Guárdala. Luego recorta».|El Sr. Bo vino.",
    "А. В. Дореса хранит фильтры и т. д.|См. стр. 7, там кадр.|«Слишком темно!» — гласит пометка.|Это правда резко?|На рис. 8 пакет.",
    "बाज़ार के पीछे यह है।|डॉ. सीकतो सं. 24 में रखते हैं।|“बहुत अँधेरा!” यह लिखा था।|कितनी अच्छी रोशनी!|क्या यह है?|हाँ।",
    "ارتفعت الدرجة من 70.8 إلى 38.13.|د. سيفا تحفظ.|انظر ص. 18 حيث المجلد.|«مظلمة جدا!» هكذا كتب.|هل هي؟|نعم.",
    "ภาพเบลอทำซ้ำรถราง|ชุดที่สองเก็บแถวโคมไฟ 26.5 เมตร|จริงหรือไม่?|ดร.มิราเก็บคน",
]
UNSPACED = [
    "备注写着：“太暗了！”然后重复了旧码头。|“先裁剪。再保留。”这是备注。|得分从75.2升到85.92。|漏掉了摊位……没有变化。|真的吗？！|光圈为f/21.1。",
    "二番目の束は残した…。|メモには「切り抜く。それから残す。」とあった。|強調した（図6を参照。）。|本当ですか？|IMG_1.JPGは隠した。",
    "It is beside the loading bay.|The copy is lost.",
]


@pytest.mark.parametrize("case,joint", [(c, " ") for c in CASES] + [(c, "\n") for c in CASES] + [(c, "") for c in UNSPACED])
def test_cases(case, joint):
    text = case.replace("|", joint)
    assert [text[a:b] for a, b in S.sentence_spans(text)] == case.split("|")


def test_blank_lines_end_sentences():
    text = "﻿Notes 26\n\nOne line\nruns on\n \t\nand ends\r\n\r\nA heading\n﻿\nLast"
    assert [text[a:b] for a, b in S.sentence_spans(text)] == ["Notes 26", "One line\nruns on", "and ends", "A heading", "Last"]


def test_document_and_corpus_show_abbreviations():
    text = "See the qrz. list here. It has a qrz. entry. The qrz. Smith wrote."
    assert len(S.sentence_spans(text)) == 3
    other = "The xkl. Smith wrote it."
    assert len(S.sentence_spans(other)) == 2 and len(S.sentence_spans(other, {"xkl": "abbreviation"})) == 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB. !?\n\r\"“”«»()。「」…1ก็ ।﻿Д-", max_size=80))
def test_spans_cover_every_character_once(text):
    spans = S.sentence_spans(text)
    white = lambda c: c.isspace() or c == "﻿"
    assert all(a < b and not white(text[a]) and not white(text[b - 1]) for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    covered = {k for a, b in spans for k in range(a, b)}
    assert all(k in covered for k, c in enumerate(text) if not white(c))


DOC = "doc_id bigint, text string, start_pos string"


def test_tables(spark, rows, monkeypatch):
    long = "A word goes on. " * 20_000
    docs = [(1, "One. Two."), (1, "One. Two."), (2, None), (3, ""), (4, " \n﻿"), (None, "Three."), (5, long), (6, "The xkl. Smith wrote it.")]
    docs += [(k, "we see the xkl. list and the Xkl. one") for k in range(10, 20)]
    df = spark.createDataFrame([(*d, "x") for d in docs], DOC)
    got = S.sentences(df)
    assert got.columns == ["doc_id", "start_pos", "end_pos"]
    all_ = [tuple(r) for r in got.collect()]
    assert sorted(r for r in all_ if r[0] == 1) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)] and (None, 0, 6) in all_
    assert sum(r[0] == 5 for r in all_) == 20_000 and {r[0] for r in all_} == {1, None, 5, 6, *range(10, 20)}
    assert sum(r[0] == 6 for r in all_) == 1
    monkeypatch.setattr(S, "LEARNED_BROADCAST", -1)
    assert rows(S.sentences(df.where("doc_id <> 1"))) == {r for r in all_ if r[0] not in (1, None)}
    assert S.sentences(df.limit(0)).count() == 0
