"""Integers of any length, and prompts that include each other to any depth."""

import duckdb
import pytest
from pyspark.sql import functions as F

from treeline.functions import datatypes as dt
from treeline.operators import output
from treeline.registry import registry

BOUNDS = dt.RANGES
VALUES = ["0", "-0", "+0", "00", "1", "-1", "+007", "127", "128", "-128", "-129", "255", "256", "32767", "32768", "2147483647", "2147483648", "-2147483648", "-2147483649", "9223372036854775807", "9223372036854775808", "18446744073709551615", "18446744073709551616", "1" * 40, "-" + "9" * 45, "0" * 50 + "5", "", "x", "1.0"]


@pytest.mark.parametrize("name", sorted(BOUNDS))
def test_ranges_hold_for_integers_of_any_length(spark, name):
    low, high = BOUNDS[name]
    df = spark.createDataFrame([(v,) for v in VALUES], "v string").select("v", dt.valid(F.col("v"), name).alias("ok"), dt.canonical(F.col("v"), name).alias("c"))
    for r in df.collect():
        number = int(r.v) if r.v.lstrip("+-").isdigit() else None
        assert r.ok == (number is not None and (low is None or number >= low) and (high is None or number <= high)), r
        assert r.c == (None if number is None else str(number)), r


def test_prompts_of_any_depth(spark):
    library = [(f"c{k}", f"[{k}{{{{include: c{k + 1}}}}}]" if k < 26 else "end") for k in range(27)] + [("x", "{{include:y}}"), ("y", "{{include: x}}"), ("m", "{{include: gone}}"), ("two", "{{include: leaf}}{{ include }}{{include:leaf }}"), ("leaf", "l")]
    prompts = [("deep", "a{{include: c0}}b"), ("loop", "{{include: x}}"), ("missing", "{{include: m}}"), ("both", "{{include: two}}"), ("plain", "text"), ("nil", None)]
    got = {r.name: (r.text, r.error) for r in output.expanded(spark.createDataFrame(prompts, "name string, text string"), spark.createDataFrame(library, "name string, text string")).collect()}
    want = "end"
    for k in range(26, -1, -1):
        want = f'<file name="c{k}">\n{want}\n</file>' if k == 26 else f'<file name="c{k}">\n[{k}{want}]\n</file>'
    assert got["deep"] == (f"a{want}b", None)
    assert got["loop"] == (None, "includes itself") and got["missing"] == (None, "gone is missing") and got["plain"] == ("text", None) and got["nil"] == (None, None)
    assert got["both"][0] == '<file name="two">\n<file name="leaf">\nl\n</file>{{ include }}<file name="leaf">\nl\n</file>\n</file>'


def test_arithmetic_of_odd_quantities(spark, tmp_path):
    """Null, zero, negative, broken and large quantities as in the SQL, with the sign of zero."""
    odd = [None, 0.0, -0.0, -3.0, -7.0, 7.0, 14.0, 50.0, 0.5, 1.5, 2.5, -0.5, -2.5, 6.5, 7.5, 13.7, -6.9, 2147483646.0, -2147483647.0]
    spark.createDataFrame([(k, k, k, q) for k, q in enumerate(odd)], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["x18_arithmetic"](spark, str(tmp_path)).select("k", "q", "m", "inf").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = db.sql(f"SELECT k, q, m, inf FROM ({registry.oracle_sql()['x18_arithmetic']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
