"""Micro-cases of the library's own operators, and agreement of the registered queries with DuckDB."""

import glob
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.functions import alignment
from loomlake.functions import sequences as sq
from loomlake.functions.alignment import align, best_shift
from loomlake.operators import dedup, metrics, ordering, pairs, resampling, splits, structures
from loomlake.operators.graph import connected
from loomlake.plans import catalog, controls, families, positions, relatives  # noqa: F401  (these register their queries with the catalog)
from loomlake.scratch import Scratch, swept
from loomlake.sources import reports
from loomlake.sources import sequence_files as files
from loomlake.streaming.incremental import append_new

SF = "/root/testdata/sf0.001"


def test_metric_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.05), (0, 0.05)], "y int, score double")
    r = metrics.ranking(df).first()
    assert math.isclose(r.auc, 2 / 3) and math.isclose(r.ap, 0.7222, abs_tol=1e-4)
    assert metrics.ranking(df.where("y = 1")).first().auc is None


def test_containment_chain(spark):
    a = "ACDEFGHIKL" * 20
    rows = [("A", a), ("B", a[20:170]), ("C", a[30:130]), ("D", "x" * 60)]
    got = {r.id: r.host for r in dedup.greedy_containment(spark.createDataFrame(rows, "id string, s string"), "id", "s").collect()}
    assert got == {"A": None, "B": "A", "C": None, "D": None}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (50, 51), (51, 52), (60, 60)]
    got = {}
    for r in connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, got.values())) == [3, 42]


def test_motifs_and_alignment(spark):
    row = spark.range(1).select(sq.motif_positions(sq.normalise(F.lit("g gs-GSG")), "G.G", 3, 1).alias("p")).first()
    assert list(row.p) == [2, 4]
    assert align("ACDE", "ACDE", lambda x, y: 4 if x == y else -2) == (4, 4)
    assert align("ACDEFG", "CDE", lambda x, y: 4 if x == y else -2)[0] == 3
    assert align("", "A", lambda x, y: 1) == (0, 0)


def test_splits_keep_components_whole(spark):
    rows = [(c, c % 2) for c in range(30) for _ in range(c % 5 + 1)]
    members = spark.createDataFrame(rows, "component long, label int")
    out = splits.assign(members)
    assert out.count() == out.select("component").distinct().count() == 30
    assert {r.split for r in out.collect()} == {"train", "val", "test"}


def test_bootstrap_skips_draws_of_one_class(spark):
    df = spark.createDataFrame([(1, 0.9, "p"), (0, 0.1, "n")], "y int, score double, g string")
    draws = resampling.bootstrap(df, "g", 30)
    assert 0 < draws.count() < 30 and {r.auc for r in draws.collect()} == {1.0}


def test_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">s1 one # x\nACDE\nFG\n>s2\nKL\n")
    got = {r.name: r.sequence for r in files.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"s1 one": "ACDEFG", "s2": "KL"}
    df = spark.createDataFrame([("b", "A" * 70), ("a", "")], "h string, s string")
    files.write_fasta(df, str(tmp_path / "out"), "h", "s", ["h"])
    assert open(glob.glob(str(tmp_path / "out" / "part*"))[0]).read() == ">a\n\n>b\n" + "A" * 60 + "\n" + "A" * 10 + "\n"
    files.write_table(df, str(tmp_path / "t"), ["h", "s"])
    assert {tuple(r) for r in files.read_table(spark, str(tmp_path / "t"), "h string, s string").collect()} == {("b", "A" * 70), ("a", "")}
    (tmp_path / "x.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert sorted(r.id for r in files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "id long").collect()) == [1, 2]
    assert files.manifest(spark, str(tmp_path / "a.fasta")).first().length == os.path.getsize(tmp_path / "a.fasta")
    atom = "ATOM      2  CA  ALA A   7      11.000  12.000  13.000"
    (tmp_path / "p.pdb").write_text(f"{atom}\n{atom}\n{atom.replace('ALA', 'UNK').replace('   7', '   8')}\n")
    assert [tuple(r)[1:] for r in files.read_structure(spark, str(tmp_path / "p.pdb"), {"ALA": "A"}).collect()] == [("A", 7, "A")]


def test_append_new(spark, tmp_path):
    target = str(tmp_path / "scores")
    assert append_new(lambda d: d, spark.range(5), target, "id") == 5
    assert append_new(lambda d: d, spark.range(8), target, "id") == 3
    assert spark.read.parquet(target).count() == 8


def _plain(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(catalog.ORACLES[name])
    at = [[c[0] for c in result.description].index(c) for c in columns]
    expected = sorted(tuple(str(_plain(r[i])) for i in at) for r in result.fetchall())
    assert sorted(tuple(str(_plain(r[c])) for c in columns) for r in df.collect()) == expected


def test_best_chain(spark):
    rows = [("a", "B", 3, 30, True), ("a", "A", 4, 40, True), ("a", "B", 5, 50, False), ("b", "X", 1, 1, None), ("b", "Y", 0, 2, False), ("c", "P", 1, 7, False), ("c", "Q", 2, 8, True), ("c", "Q", 3, 9, True)]
    df = spark.createDataFrame(rows, "id string, chain string, at int, number int, same boolean")
    got = {r.id: (r.chain, r.coverage, r.numbers) for r in structures.best_chain(df, "id", "chain", "at", "number", F.col("same")).collect()}
    assert got == {"a": ("B", 0.5, {3: 30}), "b": ("Y", 0.0, {}), "c": ("Q", 1.0, {2: 8, 3: 9})}


def test_probe_sweep_marks_the_best(spark):
    rows = catalog.QUERIES["probe_key_sweep"](spark, SF).collect()
    assert len(rows) == 6 and [r.log_loss for r in rows if r.best] == [min(r.log_loss for r in rows)]


def _sequences(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    return [(r.doc_id, r.lang, re.sub("[^A-Za-z]", "", r.text or "").upper()) for r in rows]


def test_motif_positions_of_whole_sequences(spark):
    expected = {i: ",".join(str(m.start() + 2) for m in re.finditer("(?=E.[ST].E)", s)) for i, _, s in _sequences(spark)}
    assert any(len(s) > 1000 and expected[i] for i, _, s in _sequences(spark))
    assert {r.doc_id: r.positions for r in catalog.QUERIES["motif_positions"](spark, SF).collect()} == expected


def test_overlapping_motifs_of_their_size_only(spark):
    """A motif that could also match fewer letters counts where it takes all of them, and marks in the text are letters."""
    rows = [("EESEESEESE",), ("A\u0001BAB",), ("ABBB",), ("AB",), ("",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    got = df.select(sq.motif_positions(F.col("s"), "E.[ST].E", 5, 2).alias("p"), sq.motif_positions(F.col("s"), "AB?B|B..", 3).alias("q")).collect()
    assert [r.p for r in got][:5] == [[2 + i for i in range(6) if re.match("E.[ST].E", rows[0][0][i:])], [], [], [], []]
    assert [r.q for r in got][:5] == [[], [2], [0, 1], [], []]
    assert "regexp_replace" in df.select(sq.motif_positions(F.col("s"), "E.[ST].E", 5))._jdf.queryExecution().toString()


def test_transforms_of_the_second_sequence_are_kept():
    rng, known = random.Random(9), {}
    for b in ("ACDEA" * 9, "", "CA"):
        for _ in range(40):
            a = "".join(rng.choice("ABC") for _ in range(rng.choice([0, 1, 5, 40])))
            assert best_shift(a, b, known) == _first_best_shift(a, b)
    assert known["b"] == "CA" and len(known) > 2


def test_shuffled_null_takes_every_sequence_whole(spark):
    rows = [(lang, bool(re.search("E[STN]H", s))) for _, lang, s in _sequences(spark) if s]
    assert sum(len(s) > 500 for _, _, s in _sequences(spark)) > len(rows) // 2
    for r in catalog.QUERIES["shuffled_null"](spark, SF).collect():
        own = [hit for lang, hit in rows if lang == r.lang]
        assert math.isclose(r.observed, sum(own) / len(own)) and 0 < r.null_rate <= 1 and math.isclose(r.enrichment, r.observed / r.null_rate)


def test_shuffles_keep_letters_and_draws(spark):
    df = spark.createDataFrame([(1, "a", "ESH"), (2, "a", "SSSS"), (3, "b", "EH" + "S" * 300)], "i long, g string, s string")
    got = {r.g: r for r in resampling.shuffled_hits(df.where("i <> 2"), "i", "s", "E[STN]H", 600, ["g"]).collect()}
    # of three letters one order in six has the motif; of 302 one ordered pair of places in about 303
    assert got["a"].observed and got["a"].draws == 600 and 70 <= got["a"].hits <= 130
    assert not got["b"].observed and got["b"].hits <= 12
    assert resampling.shuffled_hits(df.where("i = 2"), "i", "s", "E[STN]H", 20, ["g"]).first().hits == 0


def _first_best_shift(a, b):
    best = (0, -1)
    for k in range(-len(a), len(b)):
        n = sum(x == y for x, y in zip(a[max(0, -k) :], b[max(0, k) :]))
        if n > best[1]:
            best = (k, n)
    return best


def test_best_shift():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("ABC"[: rng.randint(1, 3)]) for _ in range(rng.choice([0, 1, 2, 7, 40]))) for _ in range(2))
        assert best_shift(a, b) == _first_best_shift(a, b)
    long = "".join(rng.choice("ACDE") for _ in range(90000))
    assert best_shift(long[70000:], long) == (70000, 20000) and best_shift(long, long[70000:]) == (-70000, 20000)


def test_shift_alignment_of_whole_sequences(spark):
    seqs = [(i, s) for i, _, s in sorted(_sequences(spark))]
    got = {r.doc_id: (r.shift, r.matches) for r in catalog.QUERIES["shift_alignment"](spark, SF).collect()}
    assert len(got) == len(seqs)
    for i, s in [seqs[0], *[x for x in seqs if len(x[1]) < 700][:15]]:
        assert got[i] == ((0, len(s)) if i == seqs[0][0] else _first_best_shift(s, seqs[0][1]))


def _table_score(a, b, score, gap_open, gap_extend):
    """The best score from the whole table."""
    low = -1e9
    M, X, Y = ([[0.0 if k == 0 and not (i and j) else low for j in range(len(b) + 1)] for i in range(len(a) + 1)] for k in range(3))
    best = low
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            M[i][j] = max(t[i - 1][j - 1] for t in (M, X, Y)) + score(a[i - 1], b[j - 1])
            X[i][j] = max(M[i - 1][j] + gap_open, X[i - 1][j] + gap_extend)
            Y[i][j] = max(M[i][j - 1] + gap_open, Y[i][j - 1] + gap_extend)
            if i == len(a) or j == len(b):
                best = max(best, M[i][j], X[i][j], Y[i][j])
    return best


@pytest.mark.parametrize("band", [0, 2, 64])
def test_banded_alignment_is_exact(monkeypatch, band):
    monkeypatch.setattr(alignment, "_BAND", band)
    rng, score = random.Random(band), lambda x, y: 4 if x == y else -2
    found, banded = [], alignment._banded
    monkeypatch.setattr(alignment, "_banded", lambda *a: found.append(banded(*a)) or found[-1])
    for _ in range(150):
        a, b = ("".join(rng.choice("ABC") for _ in range(rng.randint(1, 25))) for _ in range(2))
        b = b if rng.random() < 0.5 else a[rng.randrange(len(a)) :] + b[:3]
        same, columns = align(a, b, score, -3.0, -1.0)
        assert same <= columns <= len(a) + len(b)
        if a != b:
            assert found[-1][0] == _table_score(a, b, score, -3.0, -1.0)


def test_pair_identity_of_whole_sequences(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    head, tail, other = words(40), words(40), words(40)
    texts = [head + tail, head + other, head + tail, tail + words(5), words(30)]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.a, r.b): r.ident_min for r in catalog.QUERIES["pair_identity"](spark, str(tmp_path)).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2), (0, 3), (2, 3)}
    # the first 120 letters of 0 and 1 are equal, half of the whole sequences is
    assert got[0, 2] == 1 and 0.5 <= got[0, 1] < 0.8 and got[0, 1] == got[1, 2] and got[0, 3] > 0.85


def test_permutation_floor_follows_the_data(spark):
    r, seen = catalog.QUERIES["permutation_floor"](spark, SF).first(), metrics.ranking(catalog.hub(spark, SF)).first()
    assert (r.n_pos, r.n_neg, r.observed) == (seen.n_pos, seen.n_neg, seen.ap)
    share = seen.n_pos / (seen.n_pos + seen.n_neg)
    assert share < r.mean < share + 0.05 and r.mean < r.p99 <= 1 and 0 <= r.p_value <= 1
    draws = resampling.permutation_floor(1, 2, spark.range(900).withColumnRenamed("id", "draw"))
    assert {round(x["ap"], 6) for x in draws.collect()} == {1.0, 0.5, 0.333333} and math.isclose(draws.agg(F.avg("ap")).first()[0], 11 / 18, abs_tol=0.04)
    assert resampling.permutation_floor(0, 5, spark.range(9).withColumnRenamed("id", "draw")).count() == 0


def test_whole_resampling_takes_the_draws_of_the_reference(spark):
    n = lambda name: catalog.QUERIES[name](spark, SF).first()["n"]
    assert n("paired_bootstrap") > 3900 and n("size_matched_control") == 500
    assert {n(q) > 1900 for q in ("stratified_bootstrap", "group_bootstrap_ci", "mean_and_error")} == {True}
    assert catalog.QUERIES["shuffled_pairing"](spark, SF).select("draw").distinct().count() == 200


def test_stable_needs_a_strong_effect(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, i % 2, [float(i % 2 == 0) + rng.random() / 9] + [rng.random() + 0.3 * (i % 2 == 0) for _ in range(4)]) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.latent: r for r in catalog.QUERIES["stability_selection"](spark, str(tmp_path)).collect()}
    assert len(got) == 5 and all(r.n_top == 200 for r in got.values())
    assert [k for k in sorted(got) if got[k].stable] == [0] and got[0].delta == 1


def test_saved_and_refitted_probes(spark):
    rows = catalog.QUERIES["probe_saved"](spark, SF).collect()
    assert len(rows) == 500 and all(math.isclose(r.score, r.loaded) for r in rows)
    refit = catalog.QUERIES["subset_refit"](spark, SF).groupBy("part").count().collect()
    assert sum(r["count"] for r in refit) == 500 and len(refit) == 3
    folds = catalog.QUERIES["cv_oof_scores"](spark, SF)
    assert folds.count() == folds.select("vec_id").distinct().count() == 500


def test_places_and_tiles(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(50), rng.random()) for i in range(401)]
    df = spark.createDataFrame(rows, "i long, v int, x double").repartition(7)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r.i: (r.place, r.total) for r in ordering.running(df, ["v", "i"], {"place": F.lit(1), "total": "v"}).collect()}
    assert got == {r[0]: (n, sum(o[1] for o in ordered[:n])) for n, r in enumerate(ordered)}
    assert sorted(r["count"] for r in ordering.tiles(df, ["v", "i"], 4).groupBy("ntile").count().collect()) == [100, 100, 100, 101]
    assert ordering.placed(df.where("false"), ["v"]).count() == 0


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a|", 1)], "k string, n int")
    assert reports.markdown(df) == "| k | n |\n| --- | --- |\n| a\\| | 1 |\n| b | 2 |\n"
    reports.write_markdown(df, str(tmp_path / "r.md"), "Title")
    assert (tmp_path / "r.md").read_text().startswith("# Title\n\n| k | n |")
    path = str(tmp_path / "t")
    assert reports.cached(spark, path, lambda: df).count() == 2
    assert reports.cached(spark, path, lambda: df.limit(1)).count() == 2
    assert reports.cached(spark, path, lambda: df.limit(1), refresh=True).count() == 1


def test_splits_must_be_separate(spark):
    pairs_, split = spark.createDataFrame([(1, 2, 0.5)], "a long, b long, s double"), spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    splits.require_separate(pairs.cross_splits(pairs_, split, "s", 0.6))
    with pytest.raises(ValueError, match="test.train: 1"):
        splits.require_separate(pairs.cross_splits(pairs_, split, "s", 0.4))


def test_splits_do_not_depend_on_parts(spark):
    members = spark.createDataFrame([(c, "xyz"[c * k % 3]) for c in range(25) for k in range(c % 4 + 1)], "component long, label string")
    whole = sorted(map(tuple, splits.assign(members).collect()))
    assert sorted(map(tuple, splits.assign(members, part=3).collect())) == whole and len(whole) == 25


def test_similar_pairs_finds_all(spark):
    rng = random.Random(9)
    sets = {i: {rng.randrange(40) if rng.random() < 0.8 else 1000 * i + k for k in range(rng.randint(1, 12))} for i in range(60)}
    sets |= {100 + i: set(sets[i]) for i in range(10)}
    df = spark.createDataFrame([(i, str(s)) for i, own in sets.items() for s in own], "id long, s string")
    for floor in (0.15, 0.5, 1.0):
        expected = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= floor}
        assert {(r.a, r.b) for r in pairs.similar_pairs(df, floor).collect()} == expected


def test_unknown_key_raises(spark):
    with pytest.raises(Exception, match="unknown key: x"):
        spark.range(1).select(sq.recode(F.lit("x"), {"a": "b"})).collect()


def test_tables_are_swept(spark, tmp_path):
    with swept(spark):
        inner = Scratch(spark, "inner")
        inner.write(spark.range(3)).write.parquet(str(tmp_path / "out"))
        assert os.path.isdir(inner.root.removeprefix("file:"))
    assert not os.path.isdir(inner.root.removeprefix("file:")) and spark.read.parquet(str(tmp_path / "out")).count() == 3
    outer = Scratch(spark, "outer")
    one, two = outer.write(spark.range(3)), outer.write(spark.range(4))
    outer.drop(one)
    assert two.count() == 4 and not os.path.isdir(one._loomlake_path.removeprefix("file:"))


def test_lost_rows(spark):
    before = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), ("c", 4)], "source string, v int")
    after = spark.createDataFrame([("a", 1), ("a", 2), ("b", 7)], "source string, v int")
    assert {tuple(r) for r in dedup.lost_rows(before, after, "source").collect()} == {("a", 3, 2, 1), ("b", 1, 1, 1), ("c", 1, 0, 1)}


def test_substitution_matrix(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# a comment\n   A  C  D\nA  4 -1 -2\nC -1  9 -3\nD -2 -3  6\n")
    matrix = files.read_substitutions(spark, str(tmp_path / "m.txt"))
    assert matrix["A", "A"] == 4 and matrix["C", "D"] == -3 and len(matrix) == 9
    rows = spark.createDataFrame([("ACDA", "ACDA"), ("ACD", "AAD"), ("", "A")], "x string, y string")
    got = rows.select(alignment.identity(F.col("x"), F.col("y"), matrix).alias("i")).select("i.ident_min", "i.ident_aln").collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (2 / 3, 2 / 3), (0.0, 0.0)]


def test_packed_alignment_equals_the_plain_one(monkeypatch):
    draw = random.Random(9)
    packed, cases = alignment._packed, []
    for _ in range(60):
        of = "ACDEFGHIKL"[: draw.choice([1, 2, 9])]
        a, b = ("".join(draw.choice(of) for _ in range(draw.choice([1, 4, 40]))) for _ in range(2))
        table = np.array([[float(draw.randint(-4, 5)) for _ in of] for _ in of]) if draw.random() < 0.4 else np.where(np.eye(len(of)), 4.0, -2.0)
        cases.append((*(np.array([of.index(c) for c in s]) for s in (a, b)), table, *draw.choice([(-11.0, -1.0), (-2.0, -1.0), (-1.0, -1.0)]), draw.choice([0, 2, 50])))
    fast = [packed(*c) for c in cases]
    monkeypatch.setattr(alignment, "_packed", lambda *c: None)
    assert fast == [alignment._banded(*c) for c in cases]
    # shares of a score are left to the plain one
    assert packed(*cases[0][:2], cases[0][2] + 0.5, *cases[0][3:]) is None
