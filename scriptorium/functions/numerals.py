"""Written numerals and doses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals.
DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
FINANCIAL = {"壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9}
TENS = {"十": 10, "百": 100}
FINANCIAL_TENS = {"拾": 10, "佰": 100}
HALF = "半"

# Units of dose. One liang is 10 qian, one jin 16 liang, one dou 10 sheng, one sheng 10 ge.
LIANG = {"斤": 16.0, "两": 1.0, "分": 0.25, "铢": 1 / 24}
SHENG = {"斗": 10.0, "升": 1.0, "合": 0.1}
COUNTS = ["枚", "个", "片", "茎", "把", "粒", "条", "只"]
QIAN = {"斤": 160.0, "两": 10.0, "钱": 1.0, "分": 0.1, "厘": 0.01}
GRAMS_PER_LIANG = (15.625, 3.0)
GRAMS_PER_LATE_LIANG = 37.3


def numeral(text: Column, financial: bool = False) -> Column:
    """The value of a written numeral, or of ASCII digits; null if a sign isn't known.

    Tens multiply the digit before them (one if there is none), a half adds 0.5.
    """
    digits = DIGITS | (FINANCIAL if financial else {})
    tens = TENS | (FINANCIAL_TENS if financial else {})
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    known = F.create_map(*[x for k, v in digits.items() for x in (F.lit(k), F.lit(float(v)))])
    power = F.create_map(*[x for k, v in tens.items() for x in (F.lit(k), F.lit(float(v)))])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("digit"), F.lit(True).alias("ok"))

    def step(a: Column, c: Column) -> Column:
        as_digit, as_power = known[c], power[c]
        held = F.greatest(a["digit"], F.lit(0.0))
        return (
            F.when(as_digit.isNotNull(), F.struct(a["sum"].alias("sum"), (held * F.when(a["digit"] > 0, 10.0).otherwise(0.0) + as_digit).alias("digit"), a["ok"].alias("ok")))
            .when(as_power.isNotNull(), F.struct((a["sum"] + F.when(a["digit"] < 0, 1.0).otherwise(a["digit"]) * as_power).alias("sum"), F.lit(-1.0).alias("digit"), a["ok"].alias("ok")))
            .when(c == HALF, F.struct((a["sum"] + held + 0.5).alias("sum"), F.lit(-1.0).alias("digit"), a["ok"].alias("ok")))
            .otherwise(F.struct(a["sum"].alias("sum"), a["digit"].alias("digit"), F.lit(False).alias("ok")))
        )

    value = F.aggregate(signs, start, step, lambda a: F.when(a["ok"], a["sum"] + F.greatest(a["digit"], F.lit(0.0))))
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast("double")).when(F.length(text) > 0, value)


def _signs(financial: bool) -> str:
    # The liang's own sign is a unit here, not the number two.
    return "".join([*(d for d in DIGITS if d != "两"), *TENS, HALF, *(FINANCIAL if financial else ()), *(FINANCIAL_TENS if financial else ())])


def _sum_of_units(text: Column, units: dict[str, float], financial: bool) -> Column:
    """The sum over unit of the number before it, with a half after it; null if no unit has one."""
    total, found = F.lit(0.0), F.lit(False)
    number = rf"([0-9.]+|[{_signs(financial)}]+?)"
    for unit, value in units.items():
        before = F.regexp_extract(text, f"{number}{unit}", 1)
        has = before != ""
        half = F.when(F.regexp_extract(text, f"{number}{unit}{HALF}", 1) != "", 0.5).otherwise(0.0)
        total = total + F.when(has, (numeral(before, financial) + half) * value).otherwise(0.0)
        found = found | has
    return F.when(found, total)


def early_dose(text: Column) -> Column:
    """liang, sheng, count and two weights in grams of an early dose."""
    liang = F.round(_sum_of_units(text, LIANG, False), 4)
    sheng = F.round(_sum_of_units(text, SHENG, False), 4)
    count = numeral(F.regexp_extract(text, rf"([0-9.]+|[{_signs(False)}]+)(?:{'|'.join(COUNTS)})", 1))
    grams = [F.round(liang * g, 2).alias(n) for g, n in zip(GRAMS_PER_LIANG, ("grams_high", "grams_low"), strict=True)]
    return F.struct(liang.alias("liang"), sheng.alias("sheng"), count.alias("count"), *grams)


def late_dose(text: Column) -> Column:
    """qian and grams of a late dose."""
    qian = F.round(_sum_of_units(text, QIAN, True), 3)
    return F.struct(qian.alias("qian"), F.round(qian * GRAMS_PER_LATE_LIANG / 10, 2).alias("grams"))


def comparable_ratio(a: Column, b: Column, same_unit: Column) -> Column:
    """The smaller over the larger of two doses of the same unit, else null."""
    return F.when(same_unit & (F.greatest(a, b) > 0), F.least(a, b) / F.greatest(a, b))


def grams_shown(grams: Column) -> Column:
    return F.when(grams.isNotNull(), F.concat(F.format_number(grams, 1), F.lit(" g")))
