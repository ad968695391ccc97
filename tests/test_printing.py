"""Numbers as a browser prints them, against the shortest digits and exact expansions of plain Python."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from assayframe.functions import text as t
from pyspark.sql import functions as F


def js(x):
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "-Infinity" if x < 0 else "Infinity"
    if x == 0:
        return "0"
    sign, digits, power = Decimal(repr(abs(x))).as_tuple()
    d = "".join(map(str, digits)).lstrip("0")
    n = len(d) + power
    d = d.rstrip("0")
    k = len(d)
    if k <= n <= 21:
        out = d + "0" * (n - k)
    elif 0 < n <= 21:
        out = d[:n] + "." + d[n:]
    elif -6 < n <= 0:
        out = "0." + "0" * -n + d
    else:
        out = d[0] + ("." + d[1:] if k > 1 else "") + "e" + ("+" if n > 0 else "-") + str(abs(n - 1))
    return ("-" if x < 0 else "") + out


def shown(x):
    if not math.isfinite(x):
        return "—"
    if abs(x) >= 100 and x == math.floor(x) or abs(x) >= 2**52:
        return js(x)
    return js(float(Decimal(x).quantize(Decimal("0.001"), ROUND_HALF_UP)))


#: By hand: what a browser prints, and what the charts show.
FIXED = [
    (0.0625, "0.0625", "0.063"), (0.3125, "0.3125", "0.313"), (-0.0625, "-0.0625", "-0.063"), (1.0005, "1.0005", "1"), (0.0005, "0.0005", "0.001"), (99.9995, "99.9995", "99.999"), (0.9995, "0.9995", "1"),
    (1e-20, "1e-20", "0"), (1e-7, "1e-7", "0"), (1.5e-7, "1.5e-7", "0"), (1e-6, "0.000001", "0"), (123456789012345680000.0, "123456789012345680000", "123456789012345680000"), (1e21, "1e+21", "1e+21"), (1e22, "1e+22", "1e+22"), (1.25e22, "1.25e+22", "1.25e+22"),
    (-0.0, "0", "0"), (-0.0001, "-0.0001", "0"), (100.0, "100", "100"), (100.5, "100.5", "100.5"), (0.1 + 0.2, "0.30000000000000004", "0.3"), (2e-3, "0.002", "0.002"), (5e-324, "5e-324", "0"), (1.7976931348623157e308, "1.7976931348623157e+308", "1.7976931348623157e+308"),
    (float("nan"), "NaN", "—"), (float("inf"), "Infinity", "—"), (float("-inf"), "-Infinity", "—"), (2e23, "2e+23", "2e+23"), (8.41e21, "8.41e+21", "8.41e+21"), (9007199254740993.0, "9007199254740992", "9007199254740992"),
]


@pytest.mark.parametrize("name", ["fixed", "random"])
def test_numbers(spark, name):
    if name == "fixed":
        rows = FIXED
    else:
        rng = random.Random(9)
        xs = [rng.uniform(-1, 1) * 10 ** rng.randrange(-25, 25) for _ in range(1500)] + [rng.randrange(-(10**6), 10**6) / 2 ** rng.randrange(14) for _ in range(1000)]
        xs += [round(rng.uniform(-200, 200), rng.randrange(6)) for _ in range(1500)] + [rng.randrange(10**17) / 10**4 for _ in range(300)]
        rows = [(x, js(x), shown(x)) for x in xs]
    df = spark.createDataFrame([(None, None, None), *rows], "x double, js string, shown string")
    got = df.select("x", "js", "shown", t.js_number(F.col("x")).alias("a"), t.format_value(F.col("x")).alias("b")).collect()
    wrong = [(r["x"], r["js"], r["a"], r["shown"], r["b"]) for r in got if (r["a"], r["b"]) != (r["js"], r["shown"])]
    print(wrong)
    assert not wrong
