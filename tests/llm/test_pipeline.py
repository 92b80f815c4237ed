"""The pipeline against plain versions of its stages, each on the rows that the one before it kept."""

import random

import corpus_pipeline

from . import brute


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    sentence = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n)) + "."
    shared, items = [sentence(14) for _ in range(4)], [sentence(25) for _ in range(5)]
    docs = []
    for d in range(160):
        if docs and rng.random() < 0.2:
            w = rng.choice(docs)[1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        else:
            text = "\n".join(sentence(rng.randint(5, 60)) for _ in range(rng.randint(1, 4)))
            text += "\n" + rng.choice(shared) if rng.random() < 0.3 else ""
            text += "\nsee " + rng.choice(items) + " end." if rng.random() < 0.2 else ""
        docs.append((d, text, "en", rng.choice(["a", "a", "b", None]), len(text)))
    docs += [(200, "too short", "en", "a", 9), (201, None, "en", "b", None), (202, "BIG!! " * 30, "fr", "b", 180)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    source = {d: s for d, _, _, s, _ in docs}
    rows = [(r[0], r[6]) for r in brute.judged([(d[0], d[1]) for d in docs]) if r[8]]
    rows = [(d, t) for d, t, n, gone in brute.lines(rows) if gone == 0 or gone < n]
    keep = {r[0] for r in brute.near(rows) if r[3]}
    rows = [r for r in rows if r[0] in keep]
    hit = {r[0] for r in brute.leaks(rows, list(enumerate(items))) if r[2]}
    text = {r.doc_id: r.text for r in got}
    assert hit and not any(r[2] for r in brute.leaks([(r.doc_id, r.text) for r in got], list(enumerate(items))))
    # what decontamination left is taken from the result; all other texts must be those of the plain stages
    rows = [(d, text[d] if d in hit and d in text else t) for d, t in rows]
    taken = {d: (n, t) for d, n, _, t in brute.mixed([(d, source[d], t) for d, t in rows])}
    known = [d for d in taken if d not in hit]
    assert {r.doc_id for r in got} <= set(taken) and len(known) > 50
    assert {d: t for d, t in text.items() if d not in hit} == {d: t for d, t in rows if d in text and d not in hit}
    if all(d in text for d in hit):
        assert {r.doc_id: (r.size, r.taken) for r in got} == {d: v for d, v in taken.items() if v[1] > 0}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "minhash near-dedup", "benchmark decontamination", "mixing"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _stages():
    return dict(corpus_pipeline.STAGES)


def _benchmark(spark, tmp_path, items):
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_tell_rows_apart(spark, tmp_path):
    rng = random.Random(1)
    sentence = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n)) + "."
    folder = _benchmark(spark, tmp_path, [sentence(20)])
    one, two, three = sentence(60), sentence(60), sentence(60)
    rows = [(1, one), (5, one), (5, two), (None, three), (None, three), (None, three), (None, two + " more"), (7, None), (None, None), (8, ""), (9, "x" * 100000)]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "k", 2, 3) for r in rows], SCHEMA + ", k string, th int, turn int").repartition(4)
    kept = sorted(str(tuple(r)[:2]) for r in _stages()["minhash near-dedup"](spark, docs, folder).collect())
    # of the copies of document 1 and of the three rows without an id one stays each; words are wanting in three rows
    assert kept == sorted(map(str, [(1, one), (5, two), (None, three), (7, None), (None, None), (8, ""), (9, "x" * 100000)]))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[:5] == corpus_pipeline.COLUMNS
        assert out.count() <= len(rows)
        assert stage(spark, docs.where("false"), folder).count() == 0, name
        empty = docs.where("text is null or text = ''")
        assert stage(spark, empty, folder).count() == (0 if name in ("quality rules", "mixing") else 3)


def test_mixture_of_equal_rows(spark, tmp_path):
    folder = _benchmark(spark, tmp_path, ["a b c"])
    rng = random.Random(2)
    equal = [(5, "ten words of one text that comes back every time", "en", s, 1) for s in ("a", "b", None) for _ in range(40)]
    others = [(d, "w " * rng.randint(1, 30), "en", rng.choice(["a", "b", None]), 1) for d in [*range(100, 160), None, None, 5, 5]]
    docs = spark.createDataFrame(equal + others, SCHEMA).repartition(3)
    out = _stages()["mixing"](spark, docs, folder).collect()
    words = lambda t: len(brute.WORD.findall(t))
    size = {s: sum(words(r[1]) for r in equal + others if r[3] == s) for s in ("a", "b", None)}
    expected = {s: 0 for s in size}
    for r in brute.mixed([(d, s, t) for d, t, _, s, _ in equal + others]):
        expected[next(s for s in size if size[s] == r[2])] += r[3]
    got = {s: sum(r.taken for r in out if r.source == s) for s in size}
    assert len(set(size.values())) == 3 and got == expected and all(0 < r.taken <= 2 * r.size for r in out)
