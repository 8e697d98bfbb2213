"""Scalar functions called from SQL give what the column expressions give."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import sql, technical, text
from barloom.operators import sessions
from barloom.streaming import latch


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    bounds = [b for _, steps, _ in sql.BANDS.values() for b, _ in steps]
    xs = [float(b) for b in bounds] + [rng.uniform(-50, 120) for _ in range(50)] + [1234.5678, 0.0000098, 0.33665, -3.14159, None]
    df = spark.createDataFrame([(x, i % 24) for i, x in enumerate(xs)], "x double, hour int")
    df.createOrReplaceTempView("numbers")
    sql.register(spark)
    return df


def test_bands(spark, numbers):
    names = list(sql.BANDS)
    got = spark.sql("SELECT " + ", ".join(f"barloom_{n}_score(x) AS {n}" for n in names) + " FROM numbers").collect()
    assert got == numbers.select(*[technical.bands(F.col("x"), sql.BANDS[n]).alias(n) for n in names]).collect()
    plan = spark.sql("SELECT barloom_rsi_score(x) FROM numbers")._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_prices_follow_their_size(spark, numbers):
    rows = spark.sql("SELECT x, barloom_fit(x) AS f, barloom_price_text(x) AS p FROM numbers").collect()
    assert rows == numbers.select("x", sql.fitted("x").alias("f"), sql.price_text("x").alias("p")).collect()
    assert all(r.f == latch.fit(r.x) for r in rows if r.x is not None)
    texts = {r.x: r.p for r in rows}
    assert texts[1234.5678] == "$1,234.57" and texts[0.0000098] == "$0.000009800" and texts[None] == "—"


def test_others(spark, numbers):
    row = spark.sql("SELECT barloom_grade(78) AS a, barloom_grade(47.9) AS b, barloom_bonferroni(10, 0.05) AS c, barloom_headline_score('Profit beat, strong growth; lawsuit risk') AS d").first()
    assert (row.a, row.b, row.c) == ("A+", "D", 0.005)
    one = spark.createDataFrame([("Profit beat, strong growth; lawsuit risk",)], "t string").select(text.headline_score(F.col("t"))).first()[0]
    assert row.d == one
    a = spark.sql("SELECT barloom_expected_move(x, hour) FROM numbers").collect()
    b = numbers.select(sessions.expected_move(F.col("x"), F.col("hour"))).collect()
    assert [r[0] for r in a] == pytest.approx([r[0] for r in b], nan_ok=True) or all(x[0] == y[0] for x, y in zip(a, b))
