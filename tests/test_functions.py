import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import tails
from millrace.functions.cadence import TooShort, choose_look_back, clamp_horizon, period_number, period_start, shift_period
from millrace.functions.values import log_ratio, quote_formula, strip_formula, whole_label
from millrace.operators.documents import decode_text, has_table, page_count, section_count
from millrace.operators.roles import read_date


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("cell, kept", [
    ("=1+1", "'=1+1"), ("@x", "'@x"), ("+1", "'+1"), ("-1", "'-1"), ("\tx", "'\tx"), ("\rx", "'\rx"), ("\nx", "'\nx"), ("＝x", "'＝x"),
    ("  =x", "'  =x"), (" =x", "' =x"), ("plain", "plain"), ("a=b", "a=b"), ("", ""), ("'=x", "'=x"),
    ("line\n=second", "line\n=second"), (None, None),
])
def test_quote_formula(spark, cell, kept):
    assert one(spark, quote_formula, cell) == kept


@pytest.mark.parametrize("cell, kept", [("=+-@x", "x"), ("  =x", "x"), ("\t=x", "x"), ("  plain", "  plain"), ("==", ""), (None, None)])
def test_strip_formula(spark, cell, kept):
    assert one(spark, strip_formula, cell) == kept


def test_labels_and_ratios(spark):
    df = spark.createDataFrame([(2.0, True, 0.0)], "a double, b boolean, c double")
    labels = df.select(whole_label(F.col("a"), df.schema["a"]), whole_label(F.col("b"), df.schema["b"]), log_ratio(F.col("a"), F.col("c"))).first()
    assert labels[0] == "2" and labels[1] == "True" and labels[2] == pytest.approx(math.log(3 / 2))


@pytest.mark.parametrize("text, day_first, day", [
    ("2011-03-04", False, "2011-03-04"), ("2011/3/4", False, "2011-03-04"), ("1949-01", False, "1949-01-01"), ("12/1/2010 8:26", False, "2010-12-01"),
    ("01-02-2011", True, "2011-02-01"), ("01-02-2011", False, "2011-01-02"), ("25.12.99", True, "1999-12-25"), ("31/31/2011", False, None), ("x", False, None),
    ("25/01/2011", False, "2011-01-25"), ("2024-02-29", False, "2024-02-29"),
])
def test_read_date(spark, text, day_first, day):
    got = one(spark, lambda c: read_date(c, day_first).cast("string"), text)
    assert got == day


def test_periods(spark):
    row = spark.createDataFrame([("2024-01-31",)], "d string").select(
        *[period_start(F.to_date("d"), c).cast("string") for c in "DWMQ"], shift_period(F.to_date("d"), 2, "Q").cast("string"),
        *[(period_number(shift_period(period_start(F.to_date("d"), c), 3, c), c) - period_number(period_start(F.to_date("d"), c), c)) for c in "DWMQ"],
    ).first()
    assert list(row)[:4] == ["2024-01-31", "2024-01-29", "2024-01-01", "2024-01-01"] and list(row)[4] == "2024-07-31"
    assert list(row)[5:] == [3, 3, 3, 3]


def test_look_back_shrinks():
    full = choose_look_back("D", 730)
    assert full.lags == (1, 7, 14, 21, 28) and full.windows == (7, 30) and full.holdout == 42
    assert choose_look_back("M", 144).lags == (1, 2, 3, 6, 12)
    short = choose_look_back("D", 50)
    assert short.windows == (7,) and max(short.lags) <= 21
    with pytest.raises(TooShort):
        choose_look_back("D", 20)
    assert clamp_horizon("D", 90) == 90 and clamp_horizon("W", None) == 8 and clamp_horizon("Q", -3) == 1
    with pytest.raises(ValueError):
        clamp_horizon("D", 500)


@pytest.mark.parametrize("got, want", [
    (tails.normal_two_sided(1.959963984540054), 0.05),
    (tails.student_two_sided(2.228138852, 10), 0.05),
    (tails.student_two_sided(12.706204736, 1), 0.05),
    (tails.fisher_upper(3.885293835, 2, 12), 0.05),
    (tails.fisher_upper(4.964602744, 1, 10), 0.05),
    (tails.chi_square_upper(5.991464547, 2), 0.05),
    (tails.chi_square_upper(18.307038053, 10), 0.05),
    (tails.chi_square_upper(0.103, 2), math.exp(-0.0515)),
])
def test_tail_probabilities(got, want):
    assert got == pytest.approx(want, rel=1e-7)


def test_exact_rank_test_by_enumeration():
    from itertools import combinations

    n1, n2 = 5, 6
    us = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
    for u in (0, 3, 9, 15):
        top = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(v >= top for v in us) / len(us))
        assert tails.exact_rank_two_sided(u, n1, n2) == pytest.approx(want)


PIPES = "| a | b |\n| c | d |"


@pytest.mark.parametrize("text, table", [
    ("<TABLE border=1>", True), ("x\n| a | b |\n|---|:-:|\n", True), (PIPES, True), ("| a |\nx\n| b |", False), ("+---+---+\n| x |", True), ("┌─┬─┐", True),
    ("a\tb\nc\td", True), ("a\tb\n\nc\td", False), ("x   y   z\np   q   r", True), ("x   y\np   q", False), ("plain words only.", False), ("", False), (None, False),
])
def test_table_detection(spark, text, table):
    assert one(spark, has_table, text) is table


@pytest.mark.parametrize("text, pages, sections", [
    ("a\fb\f c", 3, 1), ("a\f \f", 1, 1), ("\f", 1, 0), ("", 0, 0), ("  \n", 0, 0), ("# a\ntext\n## b\n####### no\n#no", 1, 2),
])
def test_pages_and_sections(spark, text, pages, sections):
    assert one(spark, page_count, text) == pages
    assert one(spark, section_count, text) == sections


def test_decoding(spark):
    for stored in ("Zürich €".encode(), "Zürich".encode("latin-1")):
        want = "Zürich" if len(stored) == 6 else "Zürich €"
        assert one(spark, decode_text, bytearray(stored), "binary") == want
