import pytest

from lexmill.llm import p06_sentences as p6

CASES = {
    "en": ["Background\n\n", "The rate rose from 3.9 per cent, i.e. by less than expected. ", "Mr J. K. Moyo paid USD 1,075.50 on 8 Apr. 2015 at 163B Falcon St. ", "The office closes at 4.30 p.m. ", "See s. 91 of the Lands Act, para. 52, p. 41, for the rule. ", 'The clerk wrote, "The file is closed. Do not send it back." and left. ', '"This cannot be right!" said the magistrate. ', "The lease ended... and nobody noticed. ", "They were sold to Granite (Pvt.) Ltd. ", "The goods (see annex no. 11. and the note below it) were lost. ", "Write to a.b@c.example.com."],
    "gap": ["The order was made.", "The court agreed.\n\n", "Order\n\n", "He paid. ", "noperim bengoreva, holder of a card, signed."],
    "fr": ["Le plaignant a dit : « Je n'ai rien reçu. Je veux mon argent. » avant de sortir. ", "M. le juge, c.-à-d. plus que prévu. ", "Qui a signé ? ", "Selon l'art. 88(5) de la loi, il paie."],
    "zh": ["“这不公平！”房东说。", "利率从4.3%上升到25.4%。", "被告沉默了很久……然后承认了债务。", "谁签署了这份协议？", "原告说:“我没有收到货。我要退款。”随后离开了法庭。"],
    "ja": ["原告は「品物は届いていない。返金してほしい。」と述べた。", "誰が署名したのか？", "利率は2.7%だ。"],
    "ar": ["قال د. الشاهد إن السجل غير كامل. ", "هل تم الاستئناف خلال 77 يوما؟ ", "يجب وقف البناء فورا!"],
    "hi": ["डॉ. और श्री के नाम पत्र में नहीं थे। ", "क्या आप अपील करेंगे? ", "ब्याज दर 39.5 से बढ़कर 14.3 प्रतिशत हो गई।"],
    "am": ["ይህን ውል ማን ፈረመ፧ ", "ወለዱ ከ24.6 ወደ 13.5 በመቶ ከፍ አለ።"],
    "th": ["ค่าเช่าเพิ่มขึ้น 80 ครั้ง ", "ตามมาตรา 27 ของกฎหมาย ", "จำเลยต้องหยุดก่อสร้าง"],
}


@pytest.mark.parametrize("name", CASES)
def test_units(spark, name):
    parts = CASES[name]
    got = p6.units(spark.createDataFrame([(7, "".join(parts))], "id long, t string"), "id", "t").orderBy("sentence_no").collect()
    assert [r.sentence for r in got] == [p.strip() for p in parts]
    text = "".join(parts)
    assert all(text[r.start_pos - 1 : r.end_pos] == r.sentence for r in got)


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n "), (4, "One. Two."), (4, "One. Two."), (5, "." * 50_000), (6, "No stop")], "id long, t string").selectExpr("*", "'x' as piece", "1 as i")
    got = [tuple(r) for r in p6.units(df, "id", "t", with_text=False).orderBy("document_id", "start_pos").collect()]
    assert [g for g in got if g[0] == 4] == [(4, 1, 4), (4, 1, 4), (4, 6, 9), (4, 6, 9)] and [g for g in got if g[0] == 6] == [(6, 1, 7)] and not [g for g in got if g[0] < 4]
    legal = spark.createDataFrame([(1, "text/plain", "x" * 20), (2, "application/pdf", "y" * 40), (3, None, "z" * 40)], "id long, mime_type string, extracted_text string")
    assert p6.found(legal).count() == 0


def test_long_and_nested_quotations(spark):
    inside = "It was said again. " * 60
    parts = [f"The clerk wrote: “{inside.strip()}” and left. ", "He said “she told me “go now. Go.” and I went. So did they.” to the court. ", "Then it rained."]
    text = "".join(parts)
    got = p6.units(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("sentence_no").collect()
    assert [r.sentence for r in got] == [p.strip() for p in parts]


def test_characters_that_no_text_may_hold(spark):
    got = p6.units(spark.createDataFrame([(1, "Odd \ufdd0 sign. Next \ue000\ue00e one.")], "id long, t string"), "id", "t").orderBy("sentence_no").collect()
    assert [r.sentence for r in got] == ["Odd \ufffd sign.", "Next \ue000\ue00e one."]
