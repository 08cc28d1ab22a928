"""Tails against published values of the distributions."""

import hashlib
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skerry.functions import digest, special
from skerry.operators import resampling
from skerry.plans import inference

#: (function, arguments, value): closed forms, and quantiles of printed tables with their tail.
KNOWN = [
    ("chi_square_tail", (2.0, 2), math.exp(-1)), ("chi_square_tail", (5.0, 4), math.exp(-2.5) * 3.5), ("chi_square_tail", (3.0, 1), math.erfc(math.sqrt(1.5))),
    ("chi_square_tail", (60.0, 2), math.exp(-30)), ("chi_square_tail", (0.0, 7), 1.0), ("chi_square_tail", (7.0, 3), math.erfc(math.sqrt(3.5)) + math.sqrt(14 / math.pi) * math.exp(-3.5)),
    ("chi_square_tail", (200.0, 100), sum(math.exp(-100 + k * math.log(100) - math.lgamma(k + 1)) for k in range(50))),
    ("student_two_sided", (1.0, 1), 0.5), ("student_two_sided", (2.0, 2), 1 - 2 / math.sqrt(6)), ("student_two_sided", (12.706204736432095, 1), 0.05),
    ("student_two_sided", (2.2281388519649385, 10), 0.05), ("student_two_sided", (0.0, 9), 1.0), ("student_two_sided", (1.9623390808264078, 1000), 0.05),
    ("f_tail", (4.0, 2, 2), 0.2), ("f_tail", (4.102821015303716, 2, 10), 0.05),
]


@pytest.mark.parametrize(("name", "args", "value"), KNOWN)
def test_tails(spark, name, args, value):
    got = spark.range(1).select(getattr(special, name)(*[F.lit(float(a)) for a in args])).first()[0]
    assert got == pytest.approx(value, abs=1e-9, rel=1e-9)


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 3.0, 10.25, 171.0, 1e6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(special.log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], abs=1e-11, rel=1e-13)


def test_md5_of_whole_arrays():
    for seed, first, end, tail in ((42, 1, 1203, b"0"), (7, 9_990, 10_020, b"123456789:1"), (42, 199_990, 200_001, b"-5")):
        got = digest.md5_words(digest.starts(b"%d:" % seed, first, end, b":"), tail)
        assert got.tolist() == [int(hashlib.md5(b"%d:%d:%s" % (seed, i, tail)).hexdigest()[:8], 16) for i in range(first, end)]


def test_drawn_signs_of_many_keys(spark):
    rows = [(k, i, (k + 1) * (i * 37 % 23 - 9) * 2**40) for k in range(3) for i in range(k, 100, k + 1)]
    got = {r.k: r for r in inference.drawn_sign_flip(spark.createDataFrame(rows, "k long, id long, d long"), "k", "id", "d", draws=200).collect()}
    for k in range(3):
        own = [(i, d) for key, i, d in rows if key == k]
        word = lambda draw, i: int(hashlib.md5(f"42:{draw}:{i // 32}".encode()).hexdigest()[:8], 16)
        far = sum(abs(sum(d * (1 - 2 * (word(draw, i) >> i % 32 & 1)) for i, d in own)) >= abs(sum(d for _, d in own)) for draw in range(1, 201))
        assert (got[k].n, got[k].sum, got[k].p) == (len(own), sum(d for _, d in own), (far + 1) / 201)


def test_flips_give_sums_not_a_row_a_draw_and_set(spark):
    work = pd.DataFrame({"chunk": [0] * 50, "set": range(50), "of": [[1, 2]] * 50, "at": [[0, 31]] * 50, "d": [[5, 7]] * 50})
    assert sum(len(f) for f in inference._flipped(42, 300)(iter([work]))) == 2 * 300


def test_random_orders_are_a_row_a_draw(spark):
    sizes = spark.createDataFrame([(3, 120)], "n_pos long, n long")
    got = resampling.random_precision(sizes, 40, 5)
    word = lambda draw, i: int(hashlib.md5(f"5:{draw}:{i}".encode()).hexdigest()[:8], 16)
    want = {}
    for draw in range(1, 41):
        order = sorted(range(1, 121), key=lambda i: (word(draw, i), i))
        ranks = [r for r, i in enumerate(order, 1) if i <= 3]
        want[draw] = sum(k / r for k, r in enumerate(ranks, 1)) / 3
    assert {r.draw: r.ap for r in got.collect()} == pytest.approx(want, abs=1e-12)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert resampling.random_precision(spark.createDataFrame([(0, 5)], "n_pos long, n long"), 3).count() == 0
