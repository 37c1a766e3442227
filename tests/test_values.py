import datetime as dt

import pytest
from pyspark.sql import functions as F

from groundline.functions import text as T


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text",
    ["Mar. 5, 2011", "Mar 5 2011", "March 5 2011", "March\u00a05,\n2011", "5 March 2011", "05 Mar., 2011", "3/5/2011", "03/05/2011", "2011-03-05", "March 5, 2011"],
)
def test_every_form_of_a_date(spark, text):
    assert [tuple(r) for r in one(spark, f"due {text}.", T.dates)] == [(4, dt.date(2011, 3, 5), 4 + len(text))]


def test_months_and_order(spark):
    names = "Jan Feb Mar Apr May Jun Jul Aug Sept Sep Oct Nov Dec June July".split()
    want = [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12, 6, 7]
    assert [r["date"].month for r in one(spark, "; ".join(f"{x}. 1, 2020" for x in names), T.dates)] == want
    assert one(spark, "march 5, 2011, 31 Feb 2020, 13/1/2020, 0/1/2020, 2/30/2020, March 5, 20111, 5 May 0000", T.dates) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [("1,234.50 dollars", [123450]), ("5 Dollars or $6", [500, 600]), ("$1500 and $ 7", [150000, 700]), ("( $3,000 )", [-300000]), ("1,50 dollars, 1.234 dollars", []), ("$" + "9" * 30, []), ("5 dollarsworth", [])],
)
def test_more_forms_of_money(spark, text, want):
    assert one(spark, text, T.money) == want
