"""Numbers in prompts and headlines are rounded as C, Python and DuckDB round them."""

import random
import struct

from pyspark.sql import functions as F

from netsift.functions import text as T


def test_rounding_goes_by_the_exact_value(spark):
    random.seed(3)
    ties = [80.15625, 81.71875, 80.03125, -0.3828125, -0.3996875, 1234.565, 1234.575, 100.0625, 0.00001234565, 9999995.0, 999999.5, 999998.5, 9.9999995, 0.000099999995, 1.000005e300, 0.0, 1e6, 123456.0]
    ties += [random.randrange(10**6, 10**7) * 10 + 5 for _ in range(300)] + [(random.randrange(10**5, 10**6) * 10 + 5) * 10.0 ** random.randrange(-30, 30) for _ in range(2000)]
    ties += [random.randrange(1, 10**6) / 2 ** random.randrange(1, 24) for _ in range(2000)]
    ties += [x for x in (struct.unpack("d", random.randbytes(8))[0] for _ in range(2000)) if abs(x) < 1e308]
    rows = spark.createDataFrame([(float(x),) for x in ties], "x double").select("x", T.general_value(F.col("x")).alias("six")).collect()
    assert [(r.x, r.six) for r in rows if r.six != f"{r.x:.6g}"] == []
    assert spark.range(1).select(T.general_value(F.lit(None).cast("double"))).first()[0] == "N/A"


def test_shares_in_percent(spark):
    shares = [k / 32 for k in range(33)] + [k / 20000 for k in range(20001)]
    rows = spark.createDataFrame([(x,) for x in shares], "x double").select("x", T.percent(F.col("x")).alias("said")).collect()
    assert [(r.x, r.said) for r in rows if r.said != f"{r.x * 100:.2f}%"] == []
