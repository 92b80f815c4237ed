"""Formats by ranges, wide sparse codes, nearest places, nested validation and resumed scoring against plain versions."""

import gzip
import io
import math
import random
import threading

import numpy as np
import pytest
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from loomlake.functions import sequences as sq
from loomlake.operators import sparse_coding as sc
from loomlake.operators.probe import nested_groups
from loomlake.operators.structures import nearest_place
from loomlake.plans.positions import _letter_shares
from loomlake.sources import ranged_files as ranged
from loomlake.sources import sequence_files as files
from loomlake.streaming.incremental import resume_scores


def test_records_at_borders(monkeypatch):
    """Whatever the bytes, the range and the read size, every record is found once and whole."""
    rnd = random.Random(3)
    for _ in range(300):
        raw = "".join(rnd.choice([">", "\n", "\n>", "a", "bc\n"]) for _ in range(rnd.randint(0, 60))).encode()
        starts = [i for i in range(len(raw)) if raw[i : i + 1] == b">" and (i == 0 or raw[i - 1 : i] == b"\n")]
        expected = [(a, raw[a + 1 : len(raw) if b is None else b - 1]) for a, b in zip(starts, [*starts[1:], None], strict=False)]
        monkeypatch.setattr(ranged, "CHUNK", rnd.randint(1, 9))
        step, got = rnd.randint(1, 20), []
        for lo in range(0, len(raw), step):
            stream = io.BytesIO(raw)
            stream.seek(max(lo - 1, 0))
            got += ranged._records(stream, lo, min(lo + step, len(raw)))
        assert got == expected


def test_fasta_format(spark, tmp_path):
    ranged.register(spark)
    plain = tmp_path / "in"
    plain.mkdir()
    (plain / "a.fa").write_text("lost\n" + "".join(f">s{i} x # y\r\n{'ACDE' * (i % 50)}\r\nFG\n" for i in range(500)))
    (plain / "long.fa").write_text(">long\n" + "AC\n" * 40_000)
    (plain / "empty.fa").write_text("")
    (plain / "_hidden").write_text(">no\nA\n")
    with gzip.open(plain / "b.fa.gz", "wt") as f:
        f.write(">z\nAB\n>bare")
    read = spark.read.format("fasta").option("splitBytes", 999).load(str(plain))
    got = {r.name: r.sequence for r in read.collect()}
    assert read.rdd.getNumPartitions() > 100 and read.count() == 503
    assert got == {f"s{i} x": "ACDE" * (i % 50) + "FG" for i in range(500)} | {"long": "AC" * 40_000, "z": "AB", "bare": ""}
    (tmp_path / "none").mkdir()
    assert spark.read.format("fasta").load(str(tmp_path / "none")).count() == 0


def test_arrays_format(spark, tmp_path):
    n = 1000
    held = {"id": np.arange(n), "v": np.arange(3.0 * n, dtype=np.float32).reshape(n, 3), "s": np.array([f"x{i}" for i in range(n)])}
    np.savez(tmp_path / "plain.npz", **held)
    np.savez_compressed(tmp_path / "packed.npz", **held)
    ranged.register(spark)
    for name, tasks in (("plain", 10), ("packed", 1)):
        read = spark.read.format("arrays").option("splitBytes", 1000 if tasks > 1 else 1 << 20).load(str(tmp_path / f"{name}.npz"))
        assert read.rdd.getNumPartitions() >= tasks
        rows = read.orderBy("id").collect()
        assert [(r.id, list(r.v), r.s) for r in rows] == [(i, [3.0 * i, 3.0 * i + 1, 3.0 * i + 2], f"x{i}") for i in range(n)]
    df = spark.range(100).select("id", F.array(F.col("id") * 0.5, F.lit(1.0)).alias("v"), (F.col("id") % 2 == 0).alias("b"))
    for _ in range(2):  # a second write in this mode takes the place of the first
        df.write.format("arrays").option("splitBytes", 200).mode("overwrite").save(str(tmp_path / "out"))
    read = spark.read.format("arrays").load(str(tmp_path / "out"))
    assert read.count() == 100 and read.select("id", "v", "b").exceptAll(df).count() == 0
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")] and len(list((tmp_path / "out").iterdir())) > 4
    files.write_arrays(df.where("false"), str(tmp_path / "empty"))
    for bad in (df.withColumn("id", F.nullif("id", F.lit(3))), df.withColumn("v", F.slice("v", 1, (F.col("id") % 2 + 1).cast("int")))):
        with pytest.raises(Exception, match="null values|one length"):
            files.write_arrays(bad, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="has no absent"):
        files.read_arrays(spark, str(tmp_path / "plain.npz"), "absent int").count()


def test_structures(spark, tmp_path):
    line = lambda kind, chain, n, x: f"ATOM  {n:5d}  CA  {kind} {chain}{n:4}    {x:8.3f}{2:8.3f}{-3.5:8.3f}"
    body = [line("ALA", "A", 7, 1), line("GLY", "A", 7, 9), line("UNK", "A", 8, 1), line("ALA", "A", 8, 1), line("gly", "B", 7, 4), line("ALA", "B", 1, 0).replace("   1    ", "   x    "), "HETATM"]
    (tmp_path / "s.pdb").write_text("\n".join(body) + "\n")
    got = {tuple(r)[1:] for r in files.read_structure(spark, str(tmp_path / "s.pdb"), {"ALA": "A", "GLY": "G"}, places=True).collect()}
    assert got == {("A", 7, "A", 1.0, 2.0, -3.5), ("B", 7, "G", 4.0, 2.0, -3.5)}


@pytest.mark.parametrize(("block", "most"), [(1 << 20, 1 << 24), (8 * 6 * 4, 8 * 6 * 4), (8 * 6 * 4, 8 * 6 * 12)])
def test_codes(spark, block, most):
    rnd = np.random.default_rng(1)
    w, b, x = rnd.normal(size=(23, 6)), rnd.normal(size=6), rnd.normal(size=(40, 6))
    w[5] = 0
    dictionary = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w) if i != 5], "latent int, weights array<double>")
    odd = [(100, None), (101, [1.0]), (102, [float("nan")] * 6), (103, [None] * 6)]
    rows = spark.createDataFrame([*((i, r.tolist()) for i, r in enumerate(x)), *odd], "id int, v array<double>")
    codes = sc.encoded(rows, "id", "v", dictionary, b.tolist(), block=block, most=most)
    got, back = {r.id: r for r in codes.collect()}, {r.id: r.y for r in sc.decoded(codes, "id", dictionary, b.tolist(), block=block, most=most).collect()}
    z = np.maximum((x - b) @ w.T, 0)
    for i in range(40):
        assert got[i].latents == np.flatnonzero(z[i]).tolist() and np.allclose(got[i]["values"], z[i][z[i] > 0])
        assert np.allclose(back[i], z[i] @ w + b)
    assert all(got[i].latents is None and back[i] is None for i, _ in odd)
    none = sc.encoded(rows, "id", "v", dictionary.where("false"), b.tolist())
    assert {r.id: r.latents for r in none.collect()}[0] == []


def test_codes_of_a_wide_dictionary(spark):
    """10,240 latents of 1,280 weights from a table, in several passes, equal the plain product."""
    d, n = 1280, 10_240
    made = lambda i: np.random.default_rng(i).normal(size=d).astype(np.float32)

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"latent": batch["id"].astype("int32"), "weights": [np.random.default_rng(i).normal(size=d).astype(np.float32) for i in batch["id"]]})

    dictionary = spark.range(n).mapInPandas(run, "latent int, weights array<float>").cache()
    x = np.random.default_rng(-1 % 2**32).normal(size=(6, d))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    w = np.stack([made(i) for i in range(n)]).astype(np.float64)
    codes = sc.encoded(rows, "id", "v", dictionary, [0.0] * d, most=64 << 20)
    z = np.maximum(x @ w.T, 0)
    for r in codes.collect():
        assert r.latents == np.flatnonzero(z[r.id]).tolist() and np.allclose(r["values"], z[r.id][z[r.id] > 0])
    for r in sc.decoded(codes, "id", dictionary, [0.0] * d, most=64 << 20).collect():
        assert np.allclose(r.y, z[r.id] @ w)
    dictionary.unpersist()


def test_nearest_place(spark):
    rnd = random.Random(5)
    place = lambda s: tuple(round(rnd.uniform(-s, s) * 8) / 8 for _ in "xyz")  # noqa: E731  (eighths: equal distances are equal to the last bit)
    crowd = [("d", i, *place(0.5)) for i in range(40)]  # more than a first cell may hold, and a point far from all of them
    points = [(p, i, *place(30)) for p in "ab" for i in range(60)] + crowd + [("d", 90, 70.0, 0.0, 0.0)] + [("a", 900, 4000.0, 0.0, 0.0), ("c", 1, 0.0, 0.0, 0.0), ("a", 901, None, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0)]
    sites = [("a", i, *place(30)) for i in range(25)] + [("b", 1, 2.0, 2.0, 2.0), ("b", 0, 2.0, 2.0, 2.0), ("b", 5, None, 1.0, 1.0)] + [("a", 50, *points[3][2:])] * 2 + [("d", i, *place(0.5)) for i in range(60)]
    schema = "part string, id int, x double, y double, z double"
    got = nearest_place(spark.createDataFrame(points, schema), spark.createDataFrame(sites, schema), "part", "id", size=2.0)
    expected = []
    for part, i, *at in points:
        near = [(math.dist(at, s[2:]), s[1]) for s in sites if s[0] == part and None not in s and None not in at]
        expected.append((part, i, *((min(near)[1], round(min(near)[0], 9)) if near else (None, None))))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.part, r.id, r.site, None if r.d3 is None else round(r.d3, 9)) for r in got.collect()), key=key) == sorted(expected, key=key)
    assert nearest_place(spark.createDataFrame([], schema), spark.createDataFrame(sites, schema), "part", "id").count() == 0


def test_nested_groups(spark):
    """A large group of positives lands in one fold, which has no metric; groups are never split, and the rest is scored."""
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(1.5 * (i % 2), 1), rnd.random()], i % 2, f"g{i // 3}") for i in range(180)]
    rows += [(1000 + i, [2.0, 0.5], 1, "large") for i in range(60)] + [(2000, None, 1, "g1"), (2001, [0.0, 0.0], None, "g1"), (2002, [0.0, 0.0], 1, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int, g string")
    got = nested_groups(df, "id", "v", "y", "g", outer=3, inner=3).collect()
    top = [r for r in got if r.inner_fold is None]
    assert len(got) == 12 and sum(r.n for r in top) == 240 and sum(r.n_groups for r in top) == 61
    assert all((r.auc is None) == (r.reason is not None) for r in top) and all(r.auc > 0.7 and r.strength in (0.01, 0.1) for r in top if r.reason is None)
    for r in top:
        assert sum(i.n for i in got if i.outer_fold == r.outer_fold and i.inner_fold is not None) == 240 - r.n
    alone = nested_groups(df.where("g = 'large'"), "id", "v", "y", "g", outer=2, inner=2).collect()
    assert {r.reason for r in alone if r.inner_fold is None} == {"no rows", "no negatives"} and all(r.auc is None for r in alone)


def test_resume_after_a_failure_between_write_and_commit(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).withColumn("v", F.col("id") * 2).coalesce(1).write.parquet(source)
    scored = lambda rows: rows.select("id", (F.col("v") + 1).alias("score"))

    def fails(number):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        resume_scores(spark, source, target, scored, "id", written=fails)
    seen = []
    out = resume_scores(spark, source, target, scored, "id", written=seen.append)
    assert seen == [0] and sorted(map(tuple, out.collect())) == [(i, 2 * i + 1) for i in range(10)]
    spark.createDataFrame([(9, 0), (10, 5), (10, 4), (None, 1), (None, 2)], "id long, v long").coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        resume_scores(spark, source, target, scored, "id", written=fails)
    out = resume_scores(spark, source, target, scored, "id")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([*((i, 2 * i + 1) for i in range(10)), (10, 5), (None, 2)], key=str)
    assert resume_scores(spark, source, target, scored, "id", written=seen.append).count() == 12 and seen == [0]


def test_letter_shares_are_the_fractions(spark):
    texts = ["Abc, aYé1y", "", None, "...", "é日", "ACDEFGHIKLMNPQRSTVWYBJOUXZ" * 3 + "aa", "kKſs"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.shares for r in df.select("doc_id", F.coalesce("text", F.lit(""))).mapInArrow(_letter_shares, "doc_id long, shares array<double>").collect()}
    plain = F.array(*[sq.fraction(F.col("seq"), x) for x in "ACDEFGHIKLMNPQRSTVWY"])
    assert got == {r.doc_id: r.s for r in df.select("doc_id", sq.normalise(F.col("text")).alias("seq")).select("doc_id", plain.alias("s")).collect()}


def test_fits_of_nested_groups_run_at_once(spark, monkeypatch):
    """Three outer folds with three inner ones: nine cells with a scaler each and three last fits, no more, and some of them at the same time."""
    rnd, now, most, fits = random.Random(4), [0], [0], []
    plain, lock = StandardScaler.fit, threading.Lock()

    def fit(self, *given):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            fits.append(1)
        try:
            return plain(self, *given)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(StandardScaler, "fit", fit)
    rows = [(i, [rnd.gauss(1.5 * (i % 2), 1), rnd.random()], i % 2, f"g{i // 3}") for i in range(180)]
    got = nested_groups(spark.createDataFrame(rows, "id int, v array<double>, y int, g string"), "id", "v", "y", "g", outer=3, inner=3).collect()
    assert len(got) == 12 and all(r.auc > 0.7 for r in got if r.inner_fold is None)
    assert len(fits) == 12 and most[0] > 1
