"""Wrongly decoded text: whole strings must come back, correct ones must stay."""

import pytest

from loomcell.llm import garbled as G

CLEAN = ["Où la réserve manque, « X » désigne une entité à côté de l’été.", "Für „Größe“ gilt die übliche Überprüfung – 5° ± 2 §.", "ATENÇÃO: A CÓPIA NÃO É ÚLTIMA; À CÔTÉ DE L’ÂGE", "В партии 75 система «Ёж» ставит узел рядом с меткой.", "請先用budget登記水位，再處理「力矩」。", "tree/\n├── a.json\n└── b.csv", "√6 ≤ Ω(β) ± 68°, § 7", "plain ascii", "", "naïve façade, Ångström, piñata", "país política difícil", "“It’s” – fine…"]
PAIRS = [("utf-8", "cp1252", "Für die Größe é"), ("utf-8", "latin-1", "l’été à côté"), ("utf-8", "cp1250", "Überprüfung für"), ("utf-8", "cp1251", "une entité à côté"), ("utf-8", "cp437", "“Größe” é"), ("utf-8", "mac_roman", "vérifiée à l’été"), ("utf-8", "cp1252", "В партии система"), ("utf-8", "latin-1", "請先用登記水位"),
         ("cp1252", "mac_roman", "la réserve vérifiée"), ("cp1252", "cp437", "die größte Fläche"), ("cp1251", "cp1252", "система ставит узел рядом"), ("gb18030", "latin-1", "請先用登記水位，再處理"), ("big5", "latin-1", "請先用登記水位，再處理"), ("big5", "gb18030", "請先用登記水位，再處理"), ("utf-8", "gb18030", "請先用登記水位，再處理")]


def wrongly(text, writer, reader):
    return "".join(c for c in text.encode(writer).decode(reader, "replace")) if reader in ("gb18030", "latin-1", "mac_roman", "cp437") else "".join(G._byte(b, reader) for b in text.encode(writer))


@pytest.mark.parametrize("text", CLEAN)
def test_correct_text_is_left_alone(text):
    assert G.spans(text) == [] and G.restore(text)[0] == text


@pytest.mark.parametrize(("writer", "reader", "text"), PAIRS)
def test_wrong_reading_is_found(writer, reader, text):
    bad = wrongly(text, writer, reader)
    assert G.spans(bad) and G.spans(f"Correct début à gauche. {bad} und Schluß.")


@pytest.mark.parametrize(("writer", "reader", "text"), [p for p in PAIRS if "\ufffd" not in wrongly(p[2], p[0], p[1])])
def test_restored(writer, reader, text):
    assert G.restore(wrongly(text, writer, reader))[0] == text


LATIN, RUSSIAN = "la réserve vérifiée à côté; Ärger über Größe", "Если оценка ниже порога, прежняя область остаётся в силе."
HAN = "我们比较这个数据的结构和历史，并把结果写入登记表。"


@pytest.mark.parametrize("reader", ["mac_roman", "cp437", "cp850", "cp1251", "koi8_r"])
def test_single_byte_pairs_go_through_the_whole_sentence(reader):
    assert G.restore(wrongly(LATIN, "cp1252", reader))[0] == LATIN


@pytest.mark.parametrize(("writer", "reader"), [("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("koi8_r", "cp1252"), ("cp1251", "cp1252"), ("cp1251", "mac_roman"), ("cp1251", "cp437"), ("cp1251", "cp866"), ("iso8859_5", "cp1251")])
def test_cyrillic_pairs(writer, reader):
    assert G.restore(wrongly(RUSSIAN, writer, reader))[0] == RUSSIAN
    assert G.restore(RUSSIAN + " " + wrongly(RUSSIAN, writer, reader))[0] == RUSSIAN + " " + RUSSIAN


@pytest.mark.parametrize("reader", ["cp1252", "latin_1", "iso8859_2", "cp866", "mac_roman", "cp437", "cp1251", "cp1250", "koi8_r", "cp850", "mac_cyrillic"])
@pytest.mark.parametrize("text", [LATIN, RUSSIAN, HAN])
def test_utf8_pairs(reader, text):
    assert G.restore(G._read(text.encode(), reader))[0] == text


@pytest.mark.parametrize("text", [LATIN, RUSSIAN, HAN[:24]])
def test_utf8_read_as_gbk(text):
    assert G.restore(text.encode().decode("gbk"))[0] == text


def test_correct_text_beside_a_garbled_stretch():
    bad, correct = HAN[:24].encode().decode("gbk"), "。正确的文字保持不变"
    assert G.restore(bad + correct)[0] == HAN[:24] + correct
    assert G.restore(correct[1:] + "，" + bad + correct)[0].endswith(HAN[:24] + correct)
    cut = HAN.encode().decode("gbk", "replace")  # the last character has lost a byte
    assert G.restore(cut + correct)[0] == HAN[:-1] + "\ufffd" + correct


@pytest.mark.parametrize("times", [1, 2, 3, 5])
def test_garbled_several_times(times):
    text = bad = "größer “é” à"
    for _ in range(times):
        bad = G._read(bad.encode(), "cp1252")
    assert G.restore(bad)[0] == text


def test_lossy_readings_are_found():
    for reader in ("cp932", "cp949"):
        assert G.spans(HAN.encode().decode(reader, "replace"))
    assert G.restore("caf\ufffd")[3] == 1 and G.spans("caf\ufffd")


def test_the_corpus_decides_what_the_built_in_letters_do_not(spark):
    text = "zwölf Żółw ŕ łódź"
    bad = "w ŕ tym"
    assert G.spans(bad, G.Likelihood(G.pairs_in(["a ŕ b"] * 500))) == [] and text
    many = spark.createDataFrame([(i, "voilà, ici à gauche") for i in range(2000)] + [(9000, "toujours ŕ droite")], "id int, t string")
    assert [(r.id, r.restored) for r in G.garbled(many, "id", "t").collect()] == [(9000, "toujours à droite")]


def test_only_the_spans_change():
    text = f"Où « {wrongly('é', 'utf-8', 'cp1252')} » où É"
    assert G.restore(text)[0] == "Où « é » où É"


def test_garbled_table(spark):
    df = spark.createDataFrame([(1, "cafÃ©"), (2, "café"), (3, None), (4, ""), (1, "cafÃ©"), (5, "x" * 200_000 + "â€œ")], "id int, t string").selectExpr("*", "1 as restored")
    assert sorted(r.id for r in G.garbled(df, "id", "t").collect()) == [1, 1, 5]
    assert sorted(r.id for r in G.garbled_keys(df, "id", "t").collect()) == [1, 1, 5]
    assert G.garbled(df.limit(0), "id", "t").count() == 0
