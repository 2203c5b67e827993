import pytest
from pyspark.sql import functions as F

from scriptorium.functions import numerals, rules, text


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if not isinstance(v, (int, float, list)) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int'}" for n, v in values.items())) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, want", [("", "", 1.0), ("abc", "abd", 2 / 3), ("甲乙", "甲", 0.5), ("x", "", 0.0)])
def test_similarity(spark, a, b, want):
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


@pytest.mark.parametrize("r, want", [(1.0, "agree"), (0.95, "agree"), (0.8, "variant"), (0.7999, "mismatch"), (0.4, "missing")])
def test_verdict(spark, r, want):
    assert one(spark, text.verdict(F.col("r"), floor=True), r=r) == want


def test_verdict_out_of_range(spark):
    with pytest.raises(Exception, match="out of range"):
        one(spark, text.verdict(F.col("r")), r=1.5)


def test_variants():
    assert text.resolve_variants([("a", "b"), ("b", "c")]) == {"a": "c", "b": "c"}
    for bad in ([("a", "a")], [("a", "b"), ("a", "c")], [("a", "b"), ("b", "a")], [("ab", "c")]):
        with pytest.raises(ValueError):
            text.resolve_variants(bad)


def test_text_helpers(spark):
    assert one(spark, text.fold_variants(F.col("t"), [("裏", "里"), ("祕", "秘")]), t="裏祕x") == "里秘x"
    assert one(spark, text.grams(F.col("t")), t="abcab") == ["abc", "bca", "cab"]
    assert one(spark, text.grams(F.col("t")), t="ab") == ["ab"] and one(spark, text.grams(F.col("t")), t="") == [""]
    assert one(spark, text.han_and_digits(F.col("t")), t="a甲,1 乙") == "甲1乙"
    assert one(spark, text.quote_segments(F.col("t")), t="一二……三 ... 四") == ["一二", "三", "四"]
    assert one(spark, text.readable_title(F.col("t")), t="12. Title (3)") == "Title"
    assert [tuple(x) for x in one(spark, text.highlight(F.col("t"), ["ab", "abc"]), t="xabcab.")] == [("x", False), ("abc", True), ("ab", True), (".", False)]
    assert tuple(one(spark, text.parse_concept(F.col("t"), ["kind"]), t="kind.a.b")) == ("kind", "a.b")
    assert one(spark, text.parse_concept(F.col("t"), ["kind"]), t="other.a") is None
    assert one(spark, text.mask_gaps(F.col("t")), t="甲□乙 丙 x") == "甲\ue000乙\ue001丙 x"
    assert one(spark, text.base_name(F.col("t"), "加|去", "?"), t="某汤加一") == "某汤"
    assert one(spark, text.contains_loosely(F.col("a"), F.col("b")), a="a b\nc", b="bc") is True
    assert one(spark, text.contains_loosely(F.col("a"), F.col("b")), a="abc", b=" ") is False
    assert len(one(spark, text.content_key(F.col("a"), F.col("b")), a="x", b="y")) == 16


@pytest.mark.parametrize("t, want", [("三", 3), ("十", 10), ("十二", 12), ("二十五", 25), ("一百二十", 120), ("半", 0.5), ("一半", 1.5), ("15", 15), ("1.5", 1.5), ("几", None), ("", None)])
def test_numerals(spark, t, want):
    assert one(spark, numerals.numeral(F.col("t")), t=t) == want


def test_financial_numerals(spark):
    assert one(spark, numerals.numeral(F.col("t"), True), t="叁拾伍") == 35
    assert one(spark, numerals.numeral(F.col("t")), t="叁") is None


def test_doses(spark):
    d = one(spark, numerals.early_dose(F.col("t")), t="三两")
    assert (d["liang"], d["sheng"], d["count"], d["grams_high"], d["grams_low"]) == (3.0, None, None, 46.88, 9.0)
    assert one(spark, numerals.early_dose(F.col("t")), t="一斤")["liang"] == 16
    assert one(spark, numerals.early_dose(F.col("t")), t="一两半")["liang"] == 1.5
    assert one(spark, numerals.early_dose(F.col("t")), t="半升")["sheng"] == 0.5
    assert one(spark, numerals.early_dose(F.col("t")), t="十二枚")["count"] == 12
    assert one(spark, numerals.late_dose(F.col("t")), t="一两二钱")["qian"] == 12
    assert one(spark, numerals.late_dose(F.col("t")), t="五分")["qian"] == 0.5
    assert one(spark, numerals.late_dose(F.col("t")), t="适量")["qian"] is None
    assert one(spark, numerals.comparable_ratio(F.col("a"), F.col("b"), F.lit(True)), a=2.0, b=4.0) == 0.5
    assert one(spark, numerals.comparable_ratio(F.col("a"), F.col("b"), F.lit(False)), a=2.0, b=4.0) is None


def test_rules(spark):
    junk = lambda c: rules.junk_item(c, ["葱"], ["汤$"])
    assert one(spark, rules.clean_items(F.col("t"), {"旧": "新名"}, junk), t=["旧", "12", "葱", "酒", "某汤", "好名", "一二三四五六七"]) == ["新名", "葱", "好名"]
    assert one(spark, rules.negated_before(F.col("t"), F.lit(4), ["不可"]), t="不可与某") is True
    assert one(spark, rules.negated_before(F.col("t"), F.lit(1), ["不可"]), t="某") is False
    assert one(spark, rules.shortened(F.col("t"), 3), t="abcd") == "abc…"
    assert one(spark, rules.visible(F.col("t"), F.lit("draft")), t="x") is None
    assert one(spark, rules.gated(F.col("t"), F.lit("g"), ["g"], True), t="x") == "x"
