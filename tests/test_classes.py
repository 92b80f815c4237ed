"""Classes of equal sets stand for their members, and greedy clusters take few rounds."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from loomlake.operators import dedup, pairs
from loomlake.scratch import Scratch


def in_order(n, linked, rank):
    """Going through all ids in order, each joins the first kept one that it is linked to."""
    kept, host = [], {}
    for i in sorted(range(n), key=rank):
        near = [k for k in kept if linked(i, k)]
        host[i] = near[0] if near else None
        kept += [] if near else [i]
    return host


def test_absorbed_of_a_family_takes_few_rounds(spark, monkeypatch):
    written = []
    plain = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, label="t": written.append(label) or plain(self, df, label))
    n = 24
    edges = spark.createDataFrame([(i, j) for i in range(n) for j in range(i)], "id long, host long").withColumn("place", F.col("host"))
    got = {r.id: r.host for r in dedup.absorbed(spark.range(n), edges).collect()}
    assert got == in_order(n, lambda i, k: True, lambda i: i)
    assert len(written) < 12


def test_absorbed_is_the_outcome_of_going_in_order(spark):
    draw = random.Random(3)
    n = 40
    links = {(i, j) for i in range(n) for j in range(i) if draw.random() < 0.15}
    edges = spark.createDataFrame(sorted(links), "id long, host long").withColumn("place", F.col("host"))
    got = {r.id: r.host for r in dedup.absorbed(spark.range(n), edges).collect()}
    assert got == in_order(n, lambda i, k: (i, k) in links, lambda i: i)


def _texts(spark):
    draw = random.Random(5)
    words = [draw.choice("abcdefghij") * draw.randint(1, 4) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [draw.choice(words) for _ in range(30)]
        for _ in range(3):
            some = list(base)
            for _ in range(draw.randint(0, 2)):
                some[draw.randrange(30)] = draw.choice(words)
            texts += [" ".join(some)] * draw.randint(1, 3)
    return spark.createDataFrame([(i, t, draw.randint(1, 9)) for i, t in enumerate(texts)], "id long, text string, size long")


def test_classes_give_what_their_members_pairs_give(spark):
    df = _texts(spark)
    sets, scratch = pairs.shingle_sets(df, "id", "text"), Scratch(spark, "test")
    members, found = pairs.similar_classes(sets, 0.3, scratch)
    every = {(r.a, r.b): r.jaccard for r in pairs.expanded(members, found).collect()}
    grams = {r.id: {tuple(r.text.split()[i : i + 5]) for i in range(26)} for r in df.collect()}
    whole = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in grams for b in grams if a < b}
    assert every == {p: j for p, j in whole.items() if j >= 0.3} and found.count() < len(every)

    size = {r.id: r["size"] for r in df.collect()}
    host = in_order(len(size), lambda i, k: (min(i, k), max(i, k)) in every, lambda i: (-size[i], i))
    reps = dedup.representatives(df.select("id", "size"), found, members)
    assert {r.id: r.representative for r in reps.collect()} == {i: i if h is None else h for i, h in host.items()}

    kinds = df.select("id", (F.col("id") % 3).alias("kind"))
    counted = {}
    for (a, b), j in every.items():
        x, y = sorted((a % 3, b % 3))
        n, least = counted.get((x, y, j), (0, (a, b)))
        counted[x, y, j] = (n + 1, min(least, (a, b)))
    got = {(r.x, r.y, r.jaccard): (r.n, tuple(r.least)) for r in pairs.pair_kinds(members, found, kinds).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in counted.items()}
    assert {k: v for k, v in got.items() if k[0] != k[1]} == {k: v for k, v in counted.items() if k[0] != k[1]}

    best = pairs.best_to_class(members, found, kinds.withColumnRenamed("kind", "label"), 0, 1)
    near = lambda i: max([j for (a, b), j in every.items() if i in (a, b) and (a + b - i) % 3 == 1] or [0.0])
    assert {r.id: r.best for r in best.collect()} == {i: near(i) for i in size if i % 3 == 0}


def test_copies_are_aligned_once(spark):
    """30 copies of each of two sequences: 1,770 pairs, of four kinds."""
    items = spark.createDataFrame([(i, "AB" if i % 2 else "AC") for i in range(60)], "id long, s string")
    near = items.select(F.col("id").alias("a")).join(items.select(F.col("id").alias("b"))).where("a < b")
    every, once = pairs.by_value(near, items, "id", "s", Scratch(spark, "test"))
    assert every.count() == 1770 and {tuple(r) for r in once.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert all((r.va, r.vb) == (r.a % 2, r.b % 2) for r in every.collect())


def test_containment_of_all_sizes(spark):
    """Beginnings in common, copies, and every size from none to several heads give what plain comparison gives, and few candidates."""
    draw = random.Random(11)
    base = "".join(draw.choice("AB") for _ in range(400))
    texts = [base[draw.randrange(8) : draw.choice([0, 1, 5, 23, 24, 25, 59, 60, 61, 83, 84, 120, 180, 181, 300, 390])] for _ in range(120)]
    texts += ["AB" * 30 + "".join(draw.choice("ABC") for _ in range(draw.randint(0, 70))) for _ in range(60)] + ["", "A", "\u00e9A\u00e9", "\u00e9", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    got = [tuple(r) for r in dedup.containment_candidates(df, "id", "s").collect()]
    known = [(i, t) for i, t in enumerate(texts) if t is not None]
    expected = {(i, k, len(t)) for i, s in known for k, t in known if 0 < len(t) - len(s) <= 60 and s in t}
    assert len(got) == len(set(got)) and set(got) == expected


def test_only_classes_and_pairs_stay_written(spark):
    scratch = Scratch(spark, "test")
    members, found = pairs.similar_classes(pairs.shingle_sets(_texts(spark), "id", "text"), 0.3, scratch)
    assert sorted(p.name[4:] for p in Path(scratch.root.removeprefix("file:")).iterdir()) == ["classes", "pairs"]
    assert members.count() and found.count()


def test_shingles_that_one_set_has_are_never_written(spark, monkeypatch):
    """Texts without anything in common leave a few numbers each, not their sets."""
    draw, sizes = random.Random(7), []
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(8))
    df = spark.createDataFrame([(i, " ".join(word() for _ in range(400))) for i in range(100)], "id long, text string").repartition(2)
    plain = Scratch.write

    def write(self, frame, label="t"):
        out = plain(self, frame, label)
        sizes.append(sum(p.stat().st_size for p in Path(out._loomlake_path.removeprefix("file:")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(Scratch, "write", write)
    members, found = pairs.similar_classes(pairs.shingle_sets(df, "id", "text"), 0.15, Scratch(spark, "test"))
    assert members.count() == 100 and found.count() == 0
    assert sum(sizes) < 100 * 396 * 8 / 3


def test_sets_of_odd_texts(spark):
    """Sizes of the sets, and which texts have equal ones, are those of the words between anything but letters."""
    texts = ["a b c d e", "A-BéCééD1E", "", None, " a b c d", "a b c d e a b c d e a b c d e", "K a b c d e", "k a b c d e ", "..a b c d e\n", "abcde", "日 a b c d ef", "a b c d ef", "e"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: tuple(r.h) for r in pairs.shingle_sets(df, "id", "text").collect()}
    grams = {r.id: r.s for r in pairs.shingles(df, "id", "text").groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("s")).collect()}
    assert {i: len(h) for i, h in got.items()} == {i: len(s) for i, s in grams.items()}
    assert all((got[i] == got[j]) == (grams[i] == grams[j]) for i in got for j in got)


def test_pairs_are_compared_in_rounds(spark, monkeypatch):
    """60 variants of one text make far more pairs than texts; rounds find them all, and slices of any number the same."""
    draw = random.Random(9)
    base = [draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)]
    texts = [" ".join(w if draw.random() > 0.04 else draw.choice("xyz") for w in base) for _ in range(60)]
    df, rounds = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), []
    plain = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, frame, label="t": rounds.append(label) or plain(self, frame, label))
    got = {(r.a, r.b): r.jaccard for r in pairs.expanded(*pairs.similar_classes(pairs.shingle_sets(df, "id", "text"), 0.3, Scratch(spark, "test"), 3)).collect()}
    grams = [{tuple(t.split()[i : i + 5]) for i in range(36)} for t in texts]
    whole = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in range(60) for b in range(a + 1, 60)}
    assert got == {p: j for p, j in whole.items() if j >= 0.3} and rounds.count("found") > 3


def test_candidates_are_never_on_disk_at_once(spark, monkeypatch):
    """60 variants of one text, with copies: turns and rounds of any size give the same pairs and counts, and one turn's candidates and one round's pairs are there at a time."""
    draw = random.Random(10)
    base = [draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)]
    texts = [" ".join(w if draw.random() > 0.04 else draw.choice("xyz") for w in base) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:9])), "id long, text string")
    sets, kinds = pairs.shingle_sets(df, "id", "text"), df.select("id", (F.col("id") % 3).alias("kind"))
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    members, found = pairs.similar_classes(sets, 0.3, Scratch(spark, "test"), meetings=1e9, sent=1e9)
    counts, seen, plain = rows(pairs.pair_kinds(members, found, kinds)), [], Scratch.write

    def write(self, frame, label="t"):
        out = plain(self, frame, label)
        if label in ("likely", "found"):
            seen.append((label, sum(p.name.endswith(label) for p in Path(self.root.removeprefix("file:")).iterdir()), out.count()))
        return out

    monkeypatch.setattr(Scratch, "write", write)
    assert rows(pairs.similar_classes(sets, 0.3, Scratch(spark, "test"), meetings=2, sent=4)[1]) == rows(found)
    few = [n for label, _, n in seen if label == "likely"]
    assert len(few) > 3 and max(few) < sum(few) / 2 and {at for label, at, _ in seen if label == "likely"} == {1}
    seen.clear()
    assert rows(pairs.similar_kinds(sets, 0.3, Scratch(spark, "test"), kinds, meetings=2, sent=4)) == counts
    assert len(seen) > 6 and {at for _, at, _ in seen} == {1}
