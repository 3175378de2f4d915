import random

from lexmill.llm import p02_pairs as p2
from lexmill.llm.language import detect, train

SCHEMA = "dataset_id string, input_text string, target_summary string"
IN = "The tenant paid the rent on time. The landlord did not repair the roof of the house. " * 6


def defects(spark, rows):
    return {tuple(r) for r in p2.defects(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_types(spark):
    rows = [
        ("ok", IN, "The tenant won the case and the landlord must repair the roof."),
        ("null", IN, None), ("blank", IN, " ​\n"), ("tag", IN, "<summary></summary>"), ("word", IN, "N/A"),
        ("cut", IN, "The tenant won the case and the landl"), ("comma", IN, "The court held, in particular,"), ("abbr", IN, "It was decided in terms of s."),
        ("no", IN, "> I'm sorry, but I can't help with that request."), ("told", IN, "The board said that it was unable to comply with the order in time."),
        ("copy", IN, "Summary: " + IN.upper()), ("quote", IN, "The judge noted: The tenant paid the rent on time. That was enough."),
        ("fr", IN, "Le locataire doit payer le loyer dans un délai de dix jours."), ("both", "被告必须立即停止施工。仲裁员认为证据不足。", "I cannot summarise this document."),
        ("zh", "被告必须立即停止施工。", "仲裁员认为证据不足。"), ("zh2", "被告必须立即停止施工。", "仲裁员认为证据不足。被告沉默了。"),
    ]
    assert defects(spark, rows) == {
        ("null", "empty_answer"), ("blank", "empty_answer"), ("tag", "empty_answer"), ("word", "empty_answer"), ("cut", "truncated_answer"), ("comma", "truncated_answer"), ("abbr", "truncated_answer"),
        ("no", "refusal"), ("copy", "copied_question"), ("fr", "wrong_language"), ("both", "refusal"), ("both", "wrong_language"),
    }


def test_neighbours_match_brute_force(spark):
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice("ab€c") for _ in range(rng.randint(1, 7))) for _ in range(300)}, key=lambda s: s.encode())
    df = spark.createDataFrame([(t,) for t in texts + texts[:40]], "t string")
    got = {r.t: r.after for r in p2.next_neighbours(df, range_rows=40).collect()}
    assert got == dict(zip(texts, [*texts[1:], None], strict=True))


def test_shortened_version_is_found(spark):
    full = "The claim of USD 12.50 was paid."
    assert ("s", "truncated_answer") in defects(spark, [("s", IN, full[: full.index("50")]), ("f", IN, full)])


def test_length_limit(spark):
    rows = [(f"x{i}",) for i in range(40)]
    texts = spark.createDataFrame([("w" * 60,)] * 200 + [("v" * (30 + i),) for i in range(60)], "t string")
    assert [r.n for r in p2.length_limits(texts).collect()] == [60] and rows


def test_edges(spark):
    assert defects(spark, []) == set()
    assert defects(spark, [(None, IN, ""), ("a", None, "The court said so."), ("a", None, "The court said so."), ("b", None, None)]) == {("b", "empty_answer")}


def test_language():
    assert [detect(t) for t in ("the court and the tenant", "le tribunal et la loi", "o tribunal não foi para a casa", "これは判決である", "被告必须停止", "คู่สัญญา", None, "", "12 34")] == ["en", "fr", "pt", "ja", "zh", "th", None, None, None]
    assert [detect(t) for t in ("Der Vertrag wurde gestern von beiden Parteien unterschrieben und ist gültig.", "El contrato fue firmado ayer por las dos partes y es válido.", "Il contratto è stato firmato ieri dalle parti.")] == ["de", "es", "it"]


def test_trigrams_tell_texts_without_function_words():
    shona = ["Munhu wese ane kodzero yekutaurirwa nyaya yake uye haana mhosva kusvika zvino", "Vanhu vane mari muna Harare uye vakatenga zvinhu zvavo kwete zvedu", "Ndiani akasaina chibvumirano ichi kana asi haina kusaina"]
    english = ["The witness was not there and the court heard it", "It is for the tenant to pay and for the owner to mend", "The clerk of the court and the judge were in the room"]
    model = train(shona + english)
    assert set(model) == {"sn", "en"} and detect("Vakatenga chibvumirano zvinhu", model) == "sn" and detect("witness clerk tenant heard", model) == "en"


def test_ellipsis_leaves_an_answer_open(spark):
    rows = [
        ("dots", IN, "The tenant won the case. The court said the clerk..."), ("mark", IN, "The tenant won the case and the employer regist…"), ("apart", IN, "The tenant won the case and the landlord [...]"),
        ("digit", IN, "The claim of USD 12..."), ("num", IN, "The claim of USD 12."), ("full", IN, "The claim of USD 12.50 was paid."),
        ("th", "คู่สัญญาต้องชำระเงิน", "ผู้เช่าต้องชำระค่าเช่าทุกเดือน…"), ("th2", "คู่สัญญาต้องชำระเงิน", "ผู้ให้เช่าต้องซ่อมหลังคาบ้าน"),
        ("stop", IN, "The tenant won. The clerk of the court recorded the order...."), ("quote", IN, "The judge asked for more and said that the clerk was late."),
    ]
    assert {i for i, k in defects(spark, rows) if k == "truncated_answer"} == {"dots", "mark", "apart", "digit", "num", "th"}


def truncated(spark, rows):
    return {(r.dataset_id, r.evidence) for r in p2.explained(spark.createDataFrame(rows, SCHEMA)).collect() if r.defect_type == "truncated_answer"}


def test_a_stop_that_a_neighbour_carries_on(spark):
    rows = [
        ("day", IN, "The tenant came. The contract was signed on 3 Jan."), ("full", IN, "The contract was signed on 9 Jan. 2015 by both parties. Nobody came."),
        ("sum", IN, "The rent is late. The court awarded USD 12."), ("sums", IN, "The court awarded USD 800 to the tenant. Nobody came."),
        ("known", IN, "The clerk spoke on 4 May 2001."), ("whole", IN, "The clerk spoke on 5 May 2002. Then the court rose."), ("more", IN, "The clerk spoke on 6 May 2003 at length. Then the court rose."),
    ]
    assert truncated(spark, rows) == {("day", "neighbour"), ("sum", "neighbour")}


def test_a_length_limit_decides(spark):
    def at(n, i, end):
        return ("The court heard the tenant " + "abcdefghij"[i % 10] * 300)[: n - len(end) - 1] + " " + end

    loose = [(f"l{i}", IN, at(120, i, f"sum of {i % 10}.")) for i in range(24)]
    others = [(f"o{i}", IN, at(60 + 3 * i, i, "and nothing more.")) for i in range(30)]
    assert truncated(spark, loose[:3] + others) == set()
    assert truncated(spark, loose + others) == {(f"l{i}", "limit") for i in range(24)}
