import math

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions import vectors as vx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokenize_keeps_marks_and_drops_single_letters(spark):
    assert one(spark, tx.tokenize(F.lit("How Do a Refunds-work? कैसे"))) == ["how", "do", "refunds", "work", "कैसे"]
    assert one(spark, tx.tokenize(F.lit(""))) == []


@pytest.mark.parametrize("text,locale", [("धनवापसी कैसे करें", "hi"), ("how do refunds work", "en"), ("how do refunds work कै", "en"), ("", "en")])
def test_query_locale(spark, text, locale):
    assert one(spark, tx.detect_locale(F.lit(text))) == locale


def test_any_devanagari_decides_for_uploads(spark):
    assert one(spark, tx.upload_locale(F.lit("mostly english कै"))) == "hi"


def test_runaway_turns_are_cut(spark):
    assert one(spark, tx.truncate_runaway(F.lit("Yes. \n  User: more"))) == "Yes."
    assert one(spark, tx.truncate_runaway(F.lit("the user: said "))) == "the user: said "


def test_templates_and_markup_go(spark):
    assert one(spark, tx.strip_templates(F.lit("a {% if\nx %}b{{ v }} <b class='x'>c</b>\n\n\n\nd "))) == "a  b   c \n\nd"


def test_ocr_lines_join(spark):
    assert one(spark, tx.normalize_ocr(F.lit("re-\nfund  of\n(ten) days.\nNext\n\n\n\nPart "))) == "refund of (ten) days.\nNext\n\nPart"


def test_cites_words_and_kinds(spark):
    assert one(spark, tx.cites(F.lit("a [1], b [12][1]"))) == [1, 12, 1]
    assert one(spark, tx.word_count(F.lit(" a b "))) == 4 and one(spark, tx.word_count(F.lit(""))) == 1
    assert [one(spark, tx.block_kind(F.lit(x))) for x in ("# h", "- a", "1. a", "| a |", "a")] == ["heading", "list", "list", "table", "para"]


def test_prompts(spark):
    passages = F.array(F.struct(F.lit("T").alias("title"), F.lit("H").alias("heading"), F.lit("x" * 1000).alias("text")))
    assert one(spark, tx.grounded_prompt(F.lit("why?"), passages, "Do.")) == "Do.\n\n[1] T — H\n" + "x" * 900 + "\n\nQuestion: why?\nAnswer:"
    history = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("text")))
    assert "Conversation so far:\nUser: hi\n\nUser: why?\nAssistant:" in one(spark, tx.chat_prompt(F.lit("why?"), passages, history, "Do."))
    assert one(spark, tx.premise(passages)) == "H. " + "x" * 1000


def test_norms_and_zero_vectors(spark):
    assert one(spark, vx.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, vx.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_quantised_halves_round_up(spark):
    q = one(spark, vx.quantize(F.array(F.lit(127.0), F.lit(-2.5), F.lit(2.5))))
    assert q["codes"] == [127, -2, 3] and q["scale"] == 127.0
    assert one(spark, vx.quantize(F.array(F.lit(0.0), F.lit(0.0)))).asDict() == {"codes": [0, 0], "scale": 0.0}


def test_fnv_softmax_and_verdict(spark):
    assert one(spark, vx.fnv1a(F.lit("refund"))) == 854262879
    p = one(spark, vx.softmax(F.array(F.lit(1000.0), F.lit(1001.0))))
    assert math.isclose(sum(p), 1) and math.isclose(p[1], 1 / (1 + math.exp(-1)))
    say = lambda e, c, t: one(spark, vx.verdict(F.lit(e), F.lit(c), F.lit(t)))
    assert [say(0.5, 0.1, "long enough one"), say(0.2, 0.6, "long enough one"), say(0.2, 0.5, "long enough one"), say(0.9, 0.0, "short")] == ["supported", "contradicted", "uncertain", "unverified"]


def test_functions_by_name_in_sql(spark):
    from quillstone.functions.registry import register

    register(spark)
    got = spark.sql("SELECT fnv1a('refund') h, dot(array(1D, 2D), array(3D, 4D)) d, split_claims('A is so. B is.') c, chunk_document('T', 'body') k").first()
    assert got["h"] == 854262879 and got["d"] == 11.0 and [x["text"] for x in got["c"]] == ["A is so.", "B is."] and got["k"][0]["heading"] == "T"


def test_one_decimal_is_rounded_from_ten(spark):
    numbers = [7423.999999999999 / 1024, 16.95, 0.05, 0.04, 99.95, 1234567.85, 12.25, 1e6, 3e15]
    got = [one(spark, tx.tenth(F.lit(x))) for x in numbers]
    assert got == ["7.3", "17.0", "0.1", "0.0", "100.0", "1234567.9", "12.3", "1000000.0", "3000000000000000.0"]
    assert one(spark, tx.format_bytes(F.lit(7423.999999999999))) == "7.3 KB" and one(spark, tx.format_ms(F.lit(7249.9999999999991))) == "7.3 s"
