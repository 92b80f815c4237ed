"""All scores of a bootstrap share its draws, which are those of the plain rule."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.operators import metrics, resampling


def auc(rows):
    pos, neg = ([(s, w) for y, s, w in rows if y == k] for k in (1, 0))
    wins = sum(w * v * ((s > t) + (s == t) / 2) for s, w in pos for t, v in neg)
    total = sum(w for _, w in pos) * sum(v for _, v in neg)
    return wins / total if total else None


@pytest.mark.parametrize("strata", [None, "s"])
def test_bootstraps_equal_plain_draws(spark, strata):
    draw = random.Random(7)
    rows = [(g, "ab"[g % 2], draw.randrange(2), draw.randrange(5) / 4 if draw.random() < 0.9 else None, draw.randrange(3)) for g in range(30) for _ in range(draw.randint(1, 3))]
    df = spark.createDataFrame(rows, "g long, s string, y int, one double, two int")
    least = lambda v: -1 if v is None else v
    expected = {}
    for d in range(12):
        times = {}
        for part in ("ab" if strata else [None]):
            names = sorted({g for g, s, *_ in rows if part in (None, s)})
            for place in range(len(names)):
                said = "|".join(["x", *([part] if part else []), str(d), str(place)])
                g = names[int(hashlib.md5(said.encode()).hexdigest()[:13], 16) % len(names)]
                times[g] = times.get(g, 0) + 1
        for which, at in ((0, 3), (1, 4)):
            expected[d, which] = auc([(r[2], least(r[at]), times.get(r[0], 0)) for r in rows])
    got = {(r.draw, r.which): r.auc for r in resampling.bootstraps(df, "g", 12, "x", "y", ["one", "two"], strata).collect()}
    assert got == {k: pytest.approx(v) for k, v in expected.items() if v is not None}


def test_half_areas_over_ranges(spark):
    """Few values a range, with ties, nulls and NaN, give what ranking each draw's exploded rows gives."""
    rnd = random.Random(6)
    odd = [None, float("nan"), -0.0, 0.0, float("-inf")]
    rows = [(i, [1, 0, 0, None][i % 4], [rnd.choice([*odd, rnd.randint(-3, 3) / 2]) for _ in range(3)] + [rnd.gauss(i % 4 == 0, 1)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>")
    half = resampling.hash_number(F.lit("half"), F.col("draw"), F.col("id")) % 2 == 0
    drawn = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(10)))).where(half | (F.col("draw") == 10))
    expected = metrics.ranking(drawn.where("y is not null").select("draw", "y", F.posexplode("v").alias("latent", "score")), ["draw", "latent"]).where("auc is not null")
    expected = {(r.draw, r.latent): r.auc for r in expected.collect()}
    packed = resampling.half_areas(df, "id", "v", "y", 10, ranked=20)
    assert len(expected) == 44 and {(r.draw, r.latent): r.auc for r in packed.collect()} == expected
    assert {(r.draw, r.latent): r.auc for r in resampling.half_areas(df, "id", "v", "y", 10).collect()} == expected


def test_one_generator_gives_the_draws_of_many():
    """A state that is set anew leaves nothing of the last one's, and words are shuffled as bytes are."""
    drawn, letters = resampling.Generators(), np.frombuffer(b"ACDEFGHIKLMNPQRSTVWY" * 7, np.uint8)
    for i in range(50):
        some = letters[: 3 * i + 1]
        assert drawn("shuffle", i, 3).permutation(some.astype(np.intp)).tolist() == resampling.generator("shuffle", i, 3).permutation(some).tolist()


def test_paired_hits_over_parts(spark):
    """Few hashes a part and few sequences a block give what sorting whole strata gives."""
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "b", None]), "".join(rnd.choice("RSTA") for _ in range(rnd.randint(1, 30))), rnd.randint(-3, 30)) for i in range(150)] + [(999, "c", "R", -2)]
    df, expected = spark.createDataFrame(rows, "id long, g string, s string, at int"), {}
    for draw in range(7):
        for g in "abc":
            own = sorted(r for r in rows if r[1] == g)
            other = sorted(own, key=lambda r: (int(hashlib.md5(f"pairing|{draw}|{r[0]}".encode()).hexdigest()[:13], 16), r[0]))
            expected[draw, g] = (len(own), sum(0 <= q[3] + 2 < len(r[2]) and r[2][q[3] + 2] in "RS" for r, q in zip(own, other, strict=True)))
    for parts in ({"sorted_": 8, "met": 5}, {}):
        got = resampling.paired_hits(df, "id", "g", "s", "at", 2, "RS", 7, "pairing", **parts).collect()
        assert {(r.draw, r.g): (r.n, r.hits) for r in got} == expected
