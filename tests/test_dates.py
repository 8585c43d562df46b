"""Dates as people write them, against pandas."""

import datetime as dt
import random
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens import roles
from ledgerlens.functions import dates
from ledgerlens.operators import cleaning

WRITTEN = [
    "3/4/2024", "3-4-2024", "2024/3/4", "03/04/2024 10:15", "03/04/2024 10:15:30 PM", "3/4/24", "4-Mar-2024", "04-Mar-24", "Mar 4 2024",
    "Mon, 4 Mar 2024", "1001", "1234", "2024", "1999", "12", "2024-03", "2024/03", "03/2024", "3-2024", "Mar 2024", "March 2024", "Mar-24",
    "2024 Mar 4", "2024-Mar-04", "20240304", "20240304T101530", "20240304 101530", "20240304101530", "240304", "13/4/2024", "13/14/2024",
    "31/12/24", "2024-13-04", "2024-04-13", "2024.3.4", "3.4.2024", "13.4.2024", "2024-03-04 10:15:30.123456", "2024-3-4 7:05",
    "3/4/2024 7:05 am", "3/4/2024 7pm", "Monday, March 4, 2024", "March 4th, 2024", "4th of March 2024", "4 March 2024 10:15", "Sept 4 2024",
    "4/Mar/2024", "2024-03-04 24:00", "2024-02-30", "2/30/2024", "0/4/2024", "2024-03-04 ", "nan", "None", "", "NaT", "1e3", "3.5", "12.5",
    "2024-W10", "2024-1", "99-3-4", "3 4 2024", "2024 03 04", "4 Mar", "Mar 4", "monday", "a", "T", "1677-01-01", "1600-01-01", "2300-01-01",
    "2262-05-01", "9999-12-31", "3/4/1500", "12/31/1999 23:59:59", "2024-03-04 10:15:30 AM", "2024-03-04T10", "2024-03-04 10",
    "Mar 4, 2024 10:15 PM", "Mar. 4, 2024", "MAR 4 2024", "4MAR2024", "2024-03-04-05", "00/01/2024", "31-12-2024", "1/2/3", "01/02/03", "5", "50",
    "100", "311224", "99", "0", "-5", "1,234", "12:30 am", "3/4/2024 12:30 am", "3/4/2024 12:30 pm", "3/4/2024 13:30 pm", "Tue 5 Mar 2024",
    "Thursday 7 March 2024", "2024-03-04T10:15:30", "2024-03-04T10:15", "ABC-123", "12345", "SKU 2024", "x2024-01-01", "may", "May 2024", "1000",
]


def pandas_reads(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = pd.to_datetime(pd.Series([text], dtype=object), errors="coerce", format="mixed").iloc[0]
    return None if pd.isna(found) else found.to_pydatetime()


#: Read by pandas from the clock, or as something that no table means by it.
CLOCK = {"12:30 am"}


def spark_reads(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    return {r.i: r.d for r in df.select("i", dates.parse(F.col("s")).alias("d")).collect()}


def test_forms_are_read_as_pandas_reads_them(spark):
    got = spark_reads(spark, WRITTEN)
    wrong = {s: (got[i], pandas_reads(s)) for i, s in enumerate(WRITTEN) if s not in CLOCK and got[i] != pandas_reads(s)}
    assert not wrong
    assert spark_reads(spark, [None, "12:30 am", "2024-03-04T10:15:30Z", "2024-03-04T10:15:30+02:00"]) == {
        0: None, 1: None, 2: dt.datetime(2024, 3, 4, 10, 15, 30), 3: dt.datetime(2024, 3, 4, 8, 15, 30)}


def test_random_dates_in_every_form(spark):
    rng = random.Random(1)
    forms = ["%m/%d/%Y", "%d-%b-%Y", "%b %d, %Y", "%Y.%m.%d", "%A, %B %d, %Y %I:%M %p", "%d/%m/%y", "%m/%d/%y %H:%M:%S", "%d %B %Y", "%Y%m%d",
             "%Y-%m-%dT%H:%M:%S", "%d.%m.%Y %H:%M", "%d%b%y", "%a %d %b %Y", "%m-%Y"]
    texts = [(dt.datetime(1980, 1, 1) + dt.timedelta(minutes=rng.randrange(30_000_000))).strftime(rng.choice(forms)) for _ in range(600)]
    got = spark_reads(spark, texts)
    assert not {s: (got[i], pandas_reads(s)) for i, s in enumerate(texts) if got[i] != pandas_reads(s)}


def test_store_codes_are_no_dates(spark):
    df = spark.createDataFrame([(str(1000 + i), float(i)) for i in range(50)], "store string, sales double")
    mapping = roles.auto_map(df)
    assert mapping["date"] is None and mapping["revenue"] == "sales"


def test_shapes_of_a_column(spark):
    df = spark.createDataFrame([("3/4/2024",), ("13/14/2024",), ("Mar 4 2024",), ("junk",), (None,)], "d string")
    got = {(r.column, r.shape): (r.rows, r.parsed) for r in cleaning.date_shapes(df, ["d"]).collect()}
    assert got == {("d", "9/9/9999"): (1, 1), ("d", "99/99/9999"): (1, 0), ("d", "a 9 9999"): (1, 1), ("d", "a"): (1, 0)}


@pytest.mark.parametrize("formats,want", [(None, dt.datetime(2024, 3, 4)), (["dd/MM/yyyy"], dt.datetime(2024, 4, 3))])
def test_own_formats_come_first(spark, formats, want):
    df = spark.createDataFrame([("03/04/2024",)], "d string")
    assert cleaning.standardize_dates(df, ["d"], formats=formats).first().d == want
