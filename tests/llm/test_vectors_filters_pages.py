"""Centroid clustering, the filter audit and main-text extraction against plain versions, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import html
import math
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from loomlake.llm import centroids, filter_audit, main_text, queries
from loomlake.llm import html_blocks as hb
from loomlake.session import table


def plain_lloyd(rows, k=40, rounds=5, width=64):
    kept = [(i, [math.floor(max(-(2**27), min(2**27 - 1, 256 * x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return sorted((str(i), c, d, sum(e for _, e, o in found if o == c), total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in found)


def shown(df, *columns):
    return sorted((str(r[0]), *r[1:]) for r in df.select(*columns).collect())


VECTOR = "vec_id long, embedding array<double>, v int, cluster string, key string, total int"
CLUSTERED = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    of = lambda width=64: [rng.choice([rng.gauss(0, 1), rng.choice([0.0, 0.5, -0.25])]) for _ in range(width)]
    rows = [(i, of()) for i in range(150)] + [(i % 3, [0.5] * 64) for i in range(30)]
    rows += [(None, of()), (None, [0.0] * 64), (500, None), (501, of(63)), (502, of(65)), (503, [*of(63), None]), (504, [*of(63), math.nan]), (505, [*of(63), -math.inf]), (506, []), (507, [1e300, -1e300, *of(62)])]
    return rows + rows[:5]


@pytest.mark.parametrize("parts", [1, 7])
def test_clusters_equal_plain_rounds(spark, vectors, parts):
    df = spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in vectors], VECTOR).repartition(parts)
    assert shown(centroids.cluster(df), *CLUSTERED) == plain_lloyd(vectors)


def test_fewer_vectors_than_centroids_and_none(spark, vectors):
    few = vectors[:9] + vectors[150:156]
    df = spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in few], VECTOR)
    assert shown(centroids.cluster(df), *CLUSTERED) == plain_lloyd(few)
    assert centroids.cluster(df.where("vec_id > 10000")).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None, 1, "x", "y", 2)], VECTOR)).collect() == []


def plain_audit(docs, labels):
    good, toxic = ({i for i, *f in labels if f[n] == 1 and i is not None} for n in (0, 1))
    judged = []
    for i, part, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        first = min((j for j, _, t in docs if (t or "") == text and j is not None), default=None)
        copy = first is not None and (i is None or i > first)
        fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), copy)
        judged.append((part or "", {c for c, f in zip("ABCDE", fails, strict=True) if f}, i in good, i in toxic))
    out, shapley = {}, {}
    for order in permutations("ABCDE"):
        for part in {j[0] for j in judged}:
            left, gone = [j for j in judged if j[0] == part], []
            for step, c in enumerate(order, 1):
                here = [j for j in left if c in j[1]]
                redundant = sum(c in j[1] for j in gone)
                left, gone = [j for j in left if c not in j[1]], gone + here
                alone = sum(j[1] == {c} for j in judged if j[0] == part)
                out[part, "".join(order), step] = (len(left), len(here), redundant, alone, sum(j[2] for j in here), sum(j[3] for j in here))
                shapley[part, c] = shapley.get((part, c), 0) + len(here)
    return sorted((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items())


DOC = "doc_id long, source string, text string, k string, part int, c int, m int, row int, bits string, name string, copy string, mask int, n int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4, "b", "n", "c", 5, 6) for r in rows], DOC).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "Epsilon", "ZETA", "eta", "thetaé", "iota", "#"]) + str(rng.randrange(rng.choice([3, 60])))
    base = [" ".join(word() for _ in range(rng.choice([3, 49, 50, 51, 120, 700]))) for _ in range(25)]
    long = " ".join(f"w{i}" for i in range(6000))
    base += [long, long[:-1] + "x", "y" + long[1:], long[:20000] + "z" + long[20001:], "", " \n\t ", "a b", "a  b"]
    rows = [(rng.randrange(120), rng.choice(["s", "s", "s", "t", None, ""]), rng.choice(base)) for _ in range(140)]
    return rows + rows[:4] + [(None, "s", base[0]), (None, "t", base[0]), (None, None, None), (7000, "u", None), (7001, "u", "only one \x0b text")]


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1), (6, None, None)]


def test_audit_equals_plain(spark, texts):
    labels = spark.createDataFrame([(*r, "k") for r in LABELS], "doc_id long, quality int, toxic int, k string")
    df = filter_audit.audit(documents(spark, texts), labels)
    assert sorted(tuple(r) for r in df.collect()) == plain_audit(texts, LABELS)
    assert filter_audit.audit(documents(spark, texts[:0]), labels).collect() == []
    none = filter_audit.audit(documents(spark, texts[:12]), labels.where("doc_id < 0"))
    assert sorted(tuple(r) for r in none.collect()) == plain_audit(texts[:12], [])


@pytest.mark.parametrize(("named", "block"), [(lambda *c: F.pmod(F.xxhash64(*c), F.lit(3)), 4), (lambda *c: F.lit(1).cast("bigint"), 256), (F.xxhash64, 1)])
def test_copies_do_not_rest_on_names(spark, texts, named, block):
    """With names that most texts share, and blocks of any size, the same rows are copies."""
    from loomlake.scratch import Scratch

    some = [(n, i, t or "") for n, (i, _, t) in enumerate(texts[-70:]) if i is not None]
    rows = spark.createDataFrame(some, "n int, k long, text string").repartition(3)
    alone, grouped = filter_audit.later_copies(rows, Scratch(spark, "t"), named, block)
    found = sorted((r["n"], r["copy"]) for r in alone.unionByName(grouped).collect())
    assert found == [(n, any(u == t and j < i for _, j, u in some)) for n, i, t in some]


def test_lone_texts_are_judged_once(spark):
    """Of 400 texts two are copies: the other 398 are looked at once, not again as the copies are gathered."""
    from loomlake.scratch import Scratch

    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def judge(text):
        seen.add(1)
        return len(text)

    rows = spark.createDataFrame([(i, f"text {min(i, 398)} " * 30) for i in range(400)], "k long, text string")
    alone, grouped = filter_audit.later_copies(rows, Scratch(spark, "t"), judged={"size": judge("text")})
    assert 400 <= seen.value < 440
    assert sorted((r["k"], r["size"], r["copy"]) for r in alone.unionByName(grouped).collect()) == [(i, len(f"text {min(i, 398)} ") * 30, i == 399) for i in range(400)]


def article(page):
    """The blocks of the one article element of a page of the tables."""
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1].replace("<br>", " ")
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in parts if b)


def test_main_text_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").collect()}
    got = queries.QUERIES["op13_html_extraction"](spark, sf).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: article(h) for i, h in pages.items()} and len(got) == len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.fixture(scope="module")
def tree(spark):
    return main_text.fit(spark)


PAGE = "page_id long, url string, html string, id int, text string, blocks int, words int"


def extracted(spark, tree, *pages):
    rows = [(i, f"u{i}", h, 1, "t", 2, 3) for i, h in enumerate(pages)]
    return [r["text"] for r in main_text.extract(spark.createDataFrame(rows, PAGE), tree=tree).orderBy("page_id").collect()]


def test_main_text_on_held_out_pages(spark, tree):
    held = main_text.labelled(200, seed=4711)
    got = extracted(spark, tree, *(h for h, _ in held))
    right = wrong = missed = 0
    for text, (page, labels) in zip(got, held, strict=True):
        blocks = [b[0] for b in hb.blocks(page)]
        assert len(blocks) == len(labels)
        expected, found = [b for b, y in zip(blocks, labels, strict=True) if y], text.split("\n\n") if text else []
        right += len(set(found) & set(expected))
        wrong, missed = wrong + len(set(found) - set(expected)), missed + len(set(expected) - set(found))
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.98


BODY = "".join(f"<p>{'The river rose slowly in the night and nobody in the village had heard it come. ' * n}</p>" for n in (2, 1, 4, 3))
SITE = f"""<html><body class="single-post has-sidebar"><div id="page"><div class="site-header"><a href="/">The Paper</a><p>News since 1901</p></div>
<div class="main-menu"><ul><li><a href=/a>World</a><li><a href=/b>Sport</a><li><a href=/c>Money</a></ul></div>
<div class="cookie-banner"><p>We use cookies to make this site better. By reading on you agree to our use of them.</p><button>OK</button></div>
<div class="entry-content"><h1>A flood &amp; its end</h1>{BODY}<p>Nobody&nbsp;was
hurt &#8212; so far.</p><form class="newsletter"><p>Get our letter every day, free of charge, in your box.</p><input name="q"></form><p>The end.</p></div>
<div class="comments"><h3>3 comments</h3><p>I was there and I can say that it was worse than the paper writes, much worse, as usual.</p><p>Not true.</p></div>
<div class="widget-area"><h4>Most read</h4><ul><li><a href=/d>Ten things about rain that you did not know</a></ul></div>
<div class="footer-links"><p>Copyright 2020 The Paper. All rights reserved. No part may be copied without the leave of the publisher.</p></div></div></body></html>"""


def test_main_text_of_a_page_with_class_names(spark, tree):
    body = [" ".join(p.split()) for p in re.findall(r"<p>(.*?)</p>", BODY)]
    assert extracted(spark, tree, SITE)[0].split("\n\n") == ["A flood & its end", *body, "Nobody was hurt — so far.", "The end."]


def test_blocks_of_odd_markup():
    text = lambda page: [b[0] for b in hb.blocks(page)]
    assert text("a < b &lt; c<!-- <p>no</p> --><p>d<script>if (a</p>) '<p>'</script> e</P><br/>f") == ["a < b < c", "d e", "f"]
    assert text("<p title='a > b'>x<p>y<li>z</ul></b>w<!-- open <p>never") == ["x", "y", "z", "w"]
    assert text("<style>p{}") == [] == text("") and text("plain &amp;amp; &copy text") == ["plain &amp; © text"]
    assert text('<a href="/x>q<p>r</p>') == ["q", "r"]
    assert text("<table><tr><td>1<td>2<tr><td>3</table>4") == ["1", "2", "3", "4"]
    linked = [(b[0], b[1], b[2]) for b in hb.blocks("<p>one <a href=x>two three</a> four<p><a>five<p>six")]
    assert linked == [("one two three four", 4, 2), ("five", 1, 1), ("six", 1, 0)]


def test_main_text_of_nothing_and_of_very_long_pages(spark, tree):
    long = "<article>" + "".join(f"<p>Sentence {i} of a page that is longer than any other, by far.</p>" for i in range(40_000)) + "</article>"
    got = extracted(spark, tree, None, "", "<html><body></body></html>", long, "<b>" * 3000 + "x" * 500_000)
    assert got[:3] == ["", "", ""] and got[3].count("\n\n") == 39_999
    rows = spark.createDataFrame([(1, "u", SITE, 1, "t", 2, 3)] * 2 + [(None, None, SITE, 1, "t", 2, 3)], PAGE)
    twice = main_text.extract(rows, tree=tree).collect()
    assert len({r["text"] for r in twice}) == 1 and sorted(str(r["page_id"]) for r in twice) == ["1", "1", "None"]
    assert main_text.extract(rows.where("page_id > 5"), tree=tree).collect() == []
