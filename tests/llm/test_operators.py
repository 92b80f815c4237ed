"""Each operator against a plain version on small adversarial tables, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest

from loomlake.llm import chat, decontaminate, line_dedup, lm_score, minhash_dedup, mixing, pii, quality, secret_scan, substring_dedup
from loomlake.llm import textkit as tk
from loomlake.llm.fm_index import FMIndex

from . import brute

SCHEMA = "k string, doc_id long, text string, lang string, source string, n int, th string, rank int, words string, hash string"


def frame(spark, rows):
    """Documents of (id, text) or (id, source, text), with columns that share names with those inside operators."""
    full = [("x", r[0], r[-1], "en", r[1] if len(r) == 3 else "s", 1, "t", 2, "w", "h") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    passages = [[rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(20, 60))] for _ in range(6)]
    shared = [" ".join(rng.choice(["the", "of", "in"]) for _ in range(rng.randint(3, 14))) + "." for _ in range(8)]
    out = []
    for d in range(150):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.3:
                p = rng.choice(passages)
                a = rng.randrange(0, len(p) - 15)
                parts.append(" ".join(p[a : a + rng.randint(15, 60)]))
            elif kind < 0.6:
                parts.append(rng.choice(shared))
            else:
                parts.append(" ".join(f"W{rng.randrange(10**6)}é" for _ in range(rng.randint(1, 30))) + ".")
        out.append((d, rng.choice(["\n", " "]).join(parts)))
    out += [(rng.randrange(150), t) for _, t in out[:5]]
    out += out[5:9]  # rows repeated whole
    out += [(None, None), (None, "a b c d e f g. " * 12), (400, None), (401, ""), (402, " \n\t "), (403, "word"), (404, "ha " * 3000), (405, "\n".join(shared * 40))]
    return out


def same(df, expected, *columns):
    assert brute.order([tuple(r[c] for c in columns) for r in df.collect()]) == expected


def test_substring_dedup(spark, rows):
    same(substring_dedup.remove_repeats(frame(spark, rows)), brute.repeats(rows), "doc_id", "n_words", "n_removed", "kept_text")


def _parse(texts, window):
    """Anchors of texts of numbers from 1, with the names of the whole corpus dealt here."""
    words, first = np.concatenate(texts).astype(np.uint64), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    serial, names = 1000, {}

    def name(keys):
        nonlocal serial
        count = {}
        for k in keys:
            count[k] = count.get(k, 0) + 1
        for k in sorted(count):
            serial += 1
            names[k] = serial if count[k] > 1 else 0
        return np.array([names[k] for k in keys], np.uint64)

    words = np.where(name([(int(w),) for w in words]) > 0, words, np.uint64(0))
    heads = substring_dedup._run_heads(words, doc)
    size = np.diff(np.append(heads, len(words)))
    runs = name([("run", int(words[h]), int(n)) for h, n in zip(heads, size) if n > 1])
    s, heads = substring_dedup.first_symbols(words, doc, runs)
    for turn in range(substring_dedup.rounds(window)):
        at = substring_dedup.pairs_of(s)
        s = substring_dedup.paired(s, at, name([(turn, int(s.names[i]), int(s.names[i + 1])) for i in at]))
    starts, which = substring_dedup.anchors(words, first, s, heads, window, 2 ** substring_dedup.rounds(window))
    return first, {int(i): (int(heads[s.first[a]] - i), int(s.names[a])) if a >= 0 else None for i, a in zip(starts, which)}


@pytest.mark.parametrize("window", [5, 20, 33])
def test_equal_windows_have_equal_anchors(window):
    rng = np.random.default_rng(window)
    anchored = alone = 0
    for _ in range(60):
        inner = rng.integers(1, rng.choice([3, 4, 9, 300]), rng.integers(window, 3 * window))
        texts = [np.concatenate([rng.integers(1, 5, rng.integers(0, 12)), inner[rng.integers(0, 5) :], rng.integers(1, 5, rng.integers(0, 12))]) for _ in range(3)]
        first, found = _parse(texts, window)
        places = {}
        for t, own in enumerate(texts):
            for i in range(len(own) - window + 1):
                places.setdefault(tuple(own[i : i + window]), []).append(int(first[t] + i))
        for where in places.values():
            if len(where) > 1:
                # found in every place, and at the same symbol in all of them
                assert len({found[i] for i in where}) == 1
                anchored, alone = anchored + (found[where[0]] is not None), alone + (found[where[0]] is None)
    assert anchored and (alone or window > 20)


def test_substring_dedup_decides_by_words(spark, rows, monkeypatch):
    """With hashes of three bits, equal windows, words and pairs are still told from different ones."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(tk)
    cloudpickle.register_pickle_by_value(substring_dedup)
    try:
        real = tk.told_apart
        monkeypatch.setattr(tk, "told_apart", lambda names, same: real(names & np.uint64(7), same))
        some = [r for r in rows if r[1] is None or len(r[1]) < 2000]
        same(substring_dedup.remove_repeats(frame(spark, some)), brute.repeats(some), "doc_id", "n_words", "n_removed", "kept_text")
        # the change does reach the workers: without the comparison they fail
        monkeypatch.setattr(tk, "told_apart", lambda names, same: real(names & np.uint64(7), lambda x, y: np.ones(len(x), bool)))
        with pytest.raises(Exception):  # noqa: B017
            same(substring_dedup.remove_repeats(frame(spark, some)), brute.repeats(some), "doc_id", "n_words", "n_removed", "kept_text")
    finally:
        cloudpickle.unregister_pickle_by_value(tk)
        cloudpickle.unregister_pickle_by_value(substring_dedup)


@pytest.mark.parametrize("window", [1, 2, 7, 40])
def test_substring_dedup_of_other_windows(spark, rows, window):
    some = [r for r in rows if r[1] is None or len(r[1]) < 2000]
    same(substring_dedup.remove_repeats(frame(spark, some), window=window), brute.repeats(some, window), "doc_id", "n_words", "n_removed", "kept_text")


def test_near_duplicates(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 12, 30, 100, 400]))] for _ in range(40)]
    rows = []
    for d in range(500):
        w = list(base[0] if rng.random() < 0.3 else rng.choice(base))
        for _ in range(int(rng.random() ** 2 * 0.05 * len(w) + rng.random() * 1.2)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((d, " ".join(w).title() if rng.random() < 0.2 else " ".join(w)))
    rows += [(600, None), (601, ""), (602, "one"), (603, "One"), (None, "one"), rows[3], rows[3]]
    same(minhash_dedup.near_duplicates(frame(spark, rows)), brute.near(rows), "doc_id", "n_shingles", "component_id", "kept")


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(0)
    for n in (40, 400, 4000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n * 9 // 10], rng.integers(0, 2**63, n // 10, dtype=np.uint64)]))
        level = minhash_dedup.replica_class(n)
        a, b = (minhash_dedup.registers(s, level)[None] for s in (x, y))
        truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs(minhash_dedup.estimate(a, b, np.array([n]), np.array([n]))[0] - truth) < 0.15


@pytest.mark.parametrize("block", [16_000_000, 400])
def test_decontamination(spark, block):
    rng = random.Random(block)
    vocabulary = [f"w{i}" for i in range(5)] + ["é", "Zß", "A", "b-c"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 9, 10, 11, 40])))) for i in range(20)] + [(99, None), (98, "")]
    rows = [(None, None), (1, None), (2, "")]
    for d in range(3, 200):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice([*vocabulary, f"q{rng.randrange(99)}"]) for _ in range(rng.randint(0, 20))]
            w.append((rng.choice(items)[1] or "") if rng.random() < 0.3 else "")
        rows.append((d, " ".join(w)))
    items_df = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(frame(spark, rows), items_df, block_bytes=block)
    same(found, brute.leaks(rows, items), "doc_id", "n_words", "n_hit", "items")
    text = dict(rows)
    for r in found.where("n_hit > 0").limit(20).collect():
        assert sum(len(brute.ALNUM.findall(text[r.doc_id][s.start : s.end].translate(brute.LOWER))) for s in r.spans) == r.n_hit
    clean = decontaminate.remove_contamination(frame(spark, rows), items_df, block_bytes=block).select("doc_id", "text").collect()
    assert len(clean) == len(rows) and not any(n for _, _, n, _ in brute.leaks([tuple(r) for r in clean], items))


def test_removal_does_not_depend_on_blocks(spark):
    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(6)}" for _ in range(rng.choice([3, 3, 10, 12, 40])))) for i in range(30)]
    rows = [(None, None), (2, "")]
    for d in range(3, 150):
        w = [f"q{rng.randrange(9)}"]
        for _ in range(rng.randint(1, 4)):
            w += [rng.choice(items)[1], *(f"w{rng.randrange(6)}" for _ in range(rng.randint(0, 9))), f"q{rng.randrange(9)}"]
        rows.append((d, " ".join(w)))
    # a short item inside a longer one of, in all likelihood, another block
    long = [(100 + i, " ".join(f"l{i}x{j}" for j in range(12))) for i in range(12)]
    short = [(200 + i, " ".join(f"l{i}x{j}" for j in range(5, 8))) for i in range(12)]
    items, rows = items + long + short, rows + [(300 + i, f"before {t} after") for i, (_, t) in enumerate(long)]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    one, many, more = ([tuple(r) for r in decontaminate.remove_contamination(frame(spark, rows), items_df, block_bytes=b).select("doc_id", "text").collect()] for b in (16_000_000, 400, 3000))
    assert brute.order(many) == brute.order(one) == brute.order(more)
    assert len(many) == len(rows) and not any(n for _, _, n, _ in brute.leaks(many, items))
    assert sum(r == (300 + i, "before\nafter") for i in range(12) for r in many) == 12


def test_fm_index():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 600).astype(np.int32)
    index = FMIndex(text, 3)
    patterns = rng.integers(1, 4, (50, 3))
    who, lo, hi = index.search(patterns)
    found = {int(w): sorted(index.locate(np.arange(a, b))) for w, a, b in zip(who, lo, hi)}
    for i, p in enumerate(patterns):
        assert found.get(i, []) == [j for j in range(598) if (text[j : j + 3] == p).all()]
    assert len(FMIndex(np.empty(0, np.int32), 3).search(patterns)[0]) == 0


def test_line_dedup(spark, rows):
    same(line_dedup.dedup_lines(frame(spark, rows)), brute.lines(rows), "doc_id", "text", "n_lines", "n_removed")


def test_line_dedup_of_maximal_runs(spark):
    rng = random.Random(12)
    rows = []
    for d in range(120):
        pool = ["a", "b", "c d", "e f g", "", "h i j k l m n o p q r s", f"x{d}"]
        rows.append((d, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))))
    # equal texts without an id are copies; columns may be named as those inside
    rows += [(None, rows[3][1] + "\nnull one " + "w " * 12)] * 3
    clashing = spark.createDataFrame([(*r, 1, 2, "x", 3, "y") for r in rows], "doc_id long, text string, __k int, n_lines int, removed string, turn int, c0 string").repartition(4)
    got = line_dedup.dedup_lines(clashing)
    assert got.columns == ["doc_id", "text", "__k", "removed", "turn", "c0", "n_lines", "n_removed"]
    same(got, brute.lines(rows), "doc_id", "text", "n_lines", "n_removed")


def test_quality(spark, rows):
    junk = [(500, "A| b\nx | y | z | w\n" * 4), (501, "BIG!! LOUD!! WORDS!! HERE!! NOW!! AND!! THEN!! SOME!! MORE!! OF!! IT!!"), (502, "Clean words here, all of them fine. " + " ".join(f"v{i}" for i in range(30)) + ".\nPlease accept cookies.\n")]
    same(quality.judge(frame(spark, rows + junk)), brute.judged(rows + junk), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "base_failed", "kept")


def test_quality_of_other_scripts_and_many_lines(spark):
    hindi, thai, plain = "यह एक साधारण वाक्य है जो यहाँ लिखा गया।", "ก ข ค ง จ ฉ ช ซ ฌ ญ ฎ ฏ", "one two three four five six seven eight nine"
    rows = [(1, f"{hindi}\nवह कल शहर से नई किताब लेकर घर आया था।"), (2, thai + " " + "\n" + hindi), (3, plain), (4, "\n".join(f"line number {i} says something of its own." for i in range(20000)))]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    assert [got[i].n_removed_words for i in (1, 2, 3, 4)] == [0, 0, 9, 0] and got[1].kept and got[4].n_words == 160000
    own = quality.judge(frame(spark, rows), boilerplate=("says something",), menu=1).collect()
    assert {r.doc_id: r.n_removed_words for r in own}[4] == 160000


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(d, rng.choice(["a", "a", "a", "b", "c", "é", None, "z"]), "w " * rng.randint(0, 40)) for d in range(300)] + [(None, "a", "x y"), (7, "b", None), (8, "empty", "")]
    got = mixing.mix(frame(spark, rows))
    same(got, brute.mixed(rows), "doc_id", "size", "source_size", "taken")
    for r in got.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert r["sum(taken)"] == int(r["max(target)"] + 1e-9)


def test_mixing_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 7)
    rows = [(d, "ab"[d % 3 == 0], "w " * (d % 11)) for d in range(200)]
    same(mixing.mix(frame(spark, rows)), brute.mixed(rows), "doc_id", "size", "source_size", "taken")


def test_chat(spark):
    rng = random.Random(5)
    bits = ["</turn>", "### ", "\\", ": ", "user", "\n", "é", "word ", "<\\/turn>", "###"]
    rows = [(c, t, rng.choice(["system"] if t == 0 and c % 3 == 0 else ["user", "assistant", "a:b"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for c in range(12) for t in range(rng.randint(1, 30))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} " + "w " * 40) for t in range(400)]
    rows += [(None, 0, "user", None), (60, None, None, "x"), (61, 1, "user", "same"), (61, 1, "user", "same"), (62, 0, "assistant", "long " * 5000)]
    rows += [(70, t, "system" if t == 0 else "user", "s " * n) for t, n in enumerate((40, 496, 496, 1, 476, 60, 3, 0, 124, 125, 30))]
    clashing = [(*r, "x", 1, 2, True, 3) for r in rows]
    windows = chat.format_windows(spark.createDataFrame(clashing, "conv_id long, turn long, role string, text string, k string, w int, g int, system boolean, tokens int").repartition(5), budget=128, history=64)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    conv = {}
    for c, t, r, x in sorted(rows, key=lambda r: (brute.key(r[0]), brute.key(r[1]), r[2] or "", r[3] or "")):
        conv.setdefault(c, []).append((r or "", x or ""))
    assert got.keys() == conv.keys()
    for c, turns in conv.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    cost = lambda text: len(brute.WORD.findall(text)) + 4
    largest, alone = 0, 0
    for r in windows.collect():
        parts = chat.parse(r.formatted)
        total = sum(cost(text) for _, text in parts)
        one = r.n_turns == 1 and r.n_context <= (parts[0][0] == "system")
        assert total <= 128 or one or (r.n_turns == 2 and parts[0][0] == "system" and not r.n_context)
        largest, alone = max(largest, total if total <= 128 else 0), alone + one
    assert largest > 120 and alone
    by_conv = {}
    for r in windows.collect():
        by_conv.setdefault(r.conv_id, []).append(r)
    assert all(min(r.window for r in w) == 0 and len({r.window for r in w}) == len(w) and sum(r.n_turns for r in w) == got[c].n_turns for c, w in by_conv.items())
    repeated = windows.where("conv_id = 50").collect()
    assert all(r.n_context > 0 for r in repeated if r.window > 0)
    for r in windows.where("conv_id = 0 and window > 0").collect():
        assert chat.parse(r.formatted)[0][0] == "system"


def base_by_regex(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return sorted(out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_pii_base_rules():
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice(["1", "2", "0", "25", "9.", ".", "@", "a", "+", "-", " ", "b.c", "(", "é", "x@y.z", "1.2.3.4", "4111 1111 1111 1111"]) for _ in range(rng.randint(1, 25)))
        assert sorted(pii.base_spans(t)) == base_by_regex(t)


def test_tagger_gradients(monkeypatch):
    """Those of the loss against small differences, for parameters of every kind."""
    from loomlake.llm import tagger

    monkeypatch.setattr(tagger, "F4", np.float64)
    t = tagger.Tagger(9, embed=3, hidden=4)
    rng = np.random.default_rng(1)
    chars, gold = rng.integers(0, tagger.N_CLASSES, (3, 11)), np.zeros((3, 11), np.int64)
    gold[:, 3], gold[:, 4], gold[1, 7] = 1, 2, 5

    def loss():
        return t._loss(t.emissions(chars), gold)[0]

    hidden, state = t._run(chars)
    _, grad, d_emit = t._loss(hidden @ t.p["O"] + t.p["o"], gold)
    t._back(state, d_emit @ t.p["O"].T, grad)
    for name, at in (("A", (0, 1)), ("A", (1, 2)), ("s", (1,)), ("U", (0, 1, 2)), ("U", (1, 2, 7)), ("W", (0, 0, 3)), ("W", (1, 2, 5)), ("b", (1, 0, 9))):
        own, sides = t.p[name][at], []
        for step in (1e-5, -1e-5):
            t.p[name][at] = own + step
            sides.append(loss())
        t.p[name][at] = own
        assert np.isclose((sides[0] - sides[1]) / 2e-5, grad[name][at], rtol=1e-3, atol=1e-8)


def test_pii_tagger_on_held_out_passages():
    tagger = pii.trained([], steps=160)
    chars, gold = pii.training_windows([], 200, seed=99)
    emit = tagger.emissions(chars)
    assert np.mean([(tagger.decode(e) == g).mean() for e, g in zip(emit, gold)]) > 0.95


def test_pii_tagger_adds_spans(spark):
    """Numbers and addresses that the rules miss, in texts the tagger has not seen; saved and loaded it finds the same."""
    phones = ["(706) 555-7379", "0049 171 555 0137", "212-555-0188", "01 42 68 53 00", "(415) 555-2671"]
    words = "please call our office at {} before noon or write to the desk about the order we placed".split(" ")
    rows = [(i, " ".join(words).format(p) + f" number {i} of the list.") for i, p in enumerate(phones)] + [(90, "It was in 2019 that 45 of 1200 people came, on 12.5 acres, version 3.2.1.")]
    tagger = pii.trained([t for _, t in rows[-1:]], steps=240)
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, rows), tagger=pii.Tagger.loaded(tagger.saved())).collect()}
    found = [i for i, p in enumerate(phones) if any(s.startswith("phone:") and rows[i][1][int(s.split(":")[1]) : int(s.split(":")[2])] in p for s in got[i].spans.split(",") if s)]
    assert all(r.base == "" for r in got.values()) and len(found) >= 3 and got[90].spans == ""
    again = {r.doc_id: r.spans for r in pii.find_pii(frame(spark, rows), tagger=tagger).collect()}
    assert again == {i: r.spans for i, r in got.items()}
    # overlaps are found in time linear in the text
    text = "+49 171 5550134 " * 20000
    assert pii.tagged_spans(tagger, [text], [pii.base_spans(text)]) == [[]]


def test_pii(spark):
    rows = [(1, "write to jo.doe@mail.example.com or +1 (706) 555-7379 now"), (2, "call (706) 555-7379 today, please. Thanks"), (3, None), (4, ""), (None, "at 10.2.3.4 " * 2), (4, "x" * 5000 + "@b.c"), (9, "no data in 2024 or 3.5")]
    got = {(r.doc_id, r.n_email, r.n_ip): r for r in pii.find_pii(frame(spark, rows), steps=160).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        own = [r for r in got.values() if r.doc_id == d]
        assert any(sorted((k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.base.split(",") if s)) == base_by_regex(t or "") for r in own)
    assert all(set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) for r in got.values())
    assert got[9, 0, 0].spans == ""
    empty = pii.find_pii(frame(spark, rows).where("false"), steps=2)
    assert empty.count() == 0


def test_secrets(spark):
    live, copied = "0123456789abcdef0123456789abcdee", "fedcba9876543210fedcba9876543210"
    jwt = "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2Q"
    rows = [(i, f"s{i}", f'Token = "{copied}" é PASSWORD:short') for i in range(6)] + [(10, "s1", f"secret: '{live}' AKIA{'B7' * 8} AKIA1 {jwt}"), (11, None, None), (None, "s2", ""), (10, "s1", "token=abcdefgh12 then")]
    got = secret_scan.find_secrets(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].base == "assign:0:41,hex:9:41" and "copied" in by[0][0].statuses
    first = next(r for r in by[10] if r.n_hex)
    assert (first.n_assign, first.n_access, first.n_hex) == (1, 1, 1) and "jwt:" in first.spans and "live" in first.statuses
    assert all(set(r.base.split(",")) <= set(r.spans.split(",")) for r in got)
    text = next(t for d, _, t in rows if d == 10)
    expected = [("assign", *m.span()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    assert [s[:3] for s in secret_scan.base_spans(text) if s[0] == "assign"] == expected


def test_secret_base_rules():
    rng = random.Random(4)
    bits = ["token", "PassWord", "api_key", "apikey", "\"", "'", " ", "=", ":", "abcd1234", "AKIA", "B7C8D9E0", "0123456789abcdef", "F", "é", ".", "\n", "secret", "passwd", "-/"]
    for _ in range(6000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        expected = [("assign", *m.span()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        expected += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        expected += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert sorted(s[:3] for s in secret_scan.base_spans(t)) == sorted(expected)


def test_secrets_in_addresses():
    found = lambda t: [(k, v, secret_scan.looks_live(k, v)) for k, _, _, v in secret_scan.further_spans(t, secret_scan.base_spans(t))]
    long = "Zq7" * 40
    assert found(f"x://me:{long}@h y://me:k3P9a2@h z://me:aaaaaa@h w://me:password@h") == [("url", long, False), ("url", "k3P9a2", True), ("url", "aaaaaa", False), ("url", "password", False)]
    # many candidates in one text, in time linear in it
    many = " ".join(f"ghp_{i:020d}aB" for i in range(30000))
    assert len(secret_scan.further_spans(many, [])) == 30000


def test_secrets_against_plain_rules(spark):
    rng = random.Random(14)
    pick = lambda n, letters="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789": "".join(rng.choice(letters) for _ in range(n))
    values = [pick(rng.choice([8, 20, 26, 40])) for _ in range(12)] + [pick(40, "0123456789abcdef") for _ in range(6)] + [f"AKIA{pick(16, 'ABCDEF234567')}" for _ in range(4)]
    values += [f"ghp_{pick(20)}" for _ in range(5)] + [f"x://u:{pick(rng.choice([3, 6, 9]))}@h" for _ in range(5)] + ["eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2Q", "example_example_example_A1b2", "é" * 3]
    wraps = ["{}", "token = {}", 'PASSWORD:"{}"', "api_key='{}' ", "({})", "secret={}{}", "é {} é"]
    rows = []
    for d in range(150):
        parts = [rng.choice(wraps).replace("{}", rng.choice(values)) for _ in range(rng.randint(0, 4))]
        rows.append((d if d else None, rng.choice(["a", "b", "c", "d", None]), rng.choice(["en", "fr"]), rng.choice([" ", "\n", ","]).join(parts)))
    rows += [(200, "a", "en", None), (201, "a", "en", ""), rows[5]]
    df = spark.createDataFrame([("x", d, t, lang, s, 1, "t", 2, "w", "h") for d, s, lang, t in rows], SCHEMA).repartition(3)
    same(secret_scan.find_secrets(df), brute.secrets(rows), "doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "statuses", "holders")


def test_one_repository_of_many_owners(spark):
    """Repositories are counted as the caller names them, apart from owners."""
    rows = [(i, f"o{i % 5}", "one", "password = Xk29fLw0Qz71mNbV") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, repo string, text string")
    got = secret_scan.find_secrets(df, repo_cols=("repo",), max_owners=9).collect()
    assert {r.holders.split(":", 2)[2] for r in got} == {"5:1"} and {r.statuses.rsplit(":", 1)[1] for r in got} == {"live"}


def test_secrets_in_many_repositories_of_one_owner(spark):
    spread, own = "ghp_Q7w2E9r4T1y6U3i8O5p0", "ghp_Z1x8C3v6B5n4M7a2S9d0"
    rows = [("x", i, f"key {spread} here", f"l{i}", "s", 1, "t", 2, "w", "h") for i in range(6)]
    rows += [("x", 10 + i, f"key {own} here", f"l{i % 2}", "s", 1, "t", 2, "w", "h") for i in range(6)]
    got = {r.doc_id: (r.spans, r.statuses, r.holders) for r in secret_scan.find_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i] for i in range(6)} == {("", "token:4:copied", "token:4:1:6")}
    assert {got[10 + i] for i in range(6)} == {("token:4:28", "token:4:live", "token:4:1:2")}


def test_texts_beyond_a_block(spark):
    """Documents longer than the chunks and blocks that are handled at once, among others of any length."""
    rng = random.Random(6)
    words = [f"{'abcdefghijklmnopqrstu'[: rng.randrange(18, 21)]}{rng.randrange(400)}" for _ in range(400000)]
    long = " ".join(words)
    assert len(long) > max(tk.CHUNK, lm_score.BLOCK, substring_dedup.BLOCK)
    rows = [(0, long), (1, " ".join(words[1000:1400])), (2, long + " end"), (3, None), (4, "tail " + " ".join(words[-30:]))]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    expected = {r[0]: r for r in brute.repeats(rows)}
    assert all((got[d].n_words, got[d].n_removed, got[d].kept_text) == expected[d][1:] for d in expected)
    near = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert near == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
    items = spark.createDataFrame([(9, " ".join(words[200000:200012]))], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontaminate.find_contamination(frame(spark, rows), items).collect()}
    assert hits == {0: 12, 1: 0, 2: 12, 3: 0, 4: 0}
    scored = {r.doc_id: r.n_tokens for r in lm_score.score(frame(spark, rows), spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert scored == {0: 400000, 1: 400, 2: 400001, 3: 0, 4: 31}


def test_words_of_one_polynomial_are_told_apart(spark):
    """Thue-Morse words of 1,024 letters, which every polynomial of odd base modulo a power of two names alike."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rest = " ".join(f"r{i}" for i in range(19))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} x y z u"), (4, f"{b} x y z u")]
    same(substring_dedup.remove_repeats(frame(spark, rows)), brute.repeats(rows), "doc_id", "n_words", "n_removed", "kept_text")
    same(minhash_dedup.near_duplicates(frame(spark, rows), k=5), brute.near(rows), "doc_id", "n_shingles", "component_id", "kept")
    items = [(1, a), (2, f"{b} r0 r1")]
    found = decontaminate.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    same(found, brute.leaks(rows, items), "doc_id", "n_words", "n_hit", "items")
    scored = {r.doc_id: r for r in lm_score.score(frame(spark, [(1, f"{a} q"), (2, f"{a} q"), (3, f"{b} q")]), spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert scored[3].background_loss > scored[1].background_loss + 0.1
    # several words under one name are still told apart
    data = f"{a} {b} {a}".encode()
    words = tk.words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert tk.interned(words._replace(names=np.zeros(3, np.uint64)), np.frombuffer(data, np.uint8))[0].tolist() == [0, 1, 0]


def test_lm_score(spark):
    rows = [(d, ("good words run on here " if d % 2 else "bad noise all around us ") * (d % 5)) for d in range(40)] + [(None, None), (50, ""), (51, "one")]
    targets = spark.createDataFrame([(d,) for d in range(1, 40, 2)] * 2, "doc_id long")
    got = {r.doc_id: r for r in lm_score.score(frame(spark, rows), targets).collect()}
    counts = [{}, {}]
    words = [{}, {}]
    for d, t in rows:
        w = brute.WORD.findall((t or "").translate(brute.LOWER))
        for m in (0, 1):
            if m == 0 or (d is not None and d < 40 and d % 2):
                for a, b in zip(["\0", *w], w):
                    counts[m][a, b] = counts[m].get((a, b), 0) + 1
                for x in [*w, *(["\0"] if w else [])]:
                    words[m][x] = words[m].get(x, 0) + 1
    for d, t in rows:
        w = brute.WORD.findall((t or "").translate(brute.LOWER))
        loss = []
        for m in (1, 0):
            total = sum(words[m].values())
            single = lambda x: (words[m].get(x, 0) + 1) / (total + len(words[0]))  # noqa: B023, E731
            loss.append([-np.log((counts[m].get((a, b), 0) + 50 * single(b)) / (words[m].get(a, 0) + 50)) for a, b in zip(["\0", *w], w)])
        if w:
            assert abs(got[d].target_loss - np.mean(loss[0])) < 1e-5 and abs(got[d].background_loss - np.mean(loss[1])) < 1e-5
        else:
            assert got[d].n_tokens == 0 and got[d].score is None
    assert got[3].score < got[2].score


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        substring_dedup.remove_repeats(none), minhash_dedup.near_duplicates(none), decontaminate.find_contamination(none, items), line_dedup.dedup_lines(none),
        quality.judge(none), mixing.mix(none), secret_scan.find_secrets(none), lm_score.score(none, none), chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert out.count() == 0
    assert decontaminate.find_contamination(frame(spark, [(1, "a b")]), items).first().n_hit == 0


def test_tables_without_a_word(spark):
    rows = [(1, None), (2, ""), (None, None), (3, " \n ")]
    df, items = frame(spark, rows), spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    same(substring_dedup.remove_repeats(df), brute.repeats(rows), "doc_id", "n_words", "n_removed", "kept_text")
    same(minhash_dedup.near_duplicates(df), brute.near(rows), "doc_id", "n_shingles", "component_id", "kept")
    same(line_dedup.dedup_lines(df), brute.lines(rows), "doc_id", "text", "n_lines", "n_removed")
    assert minhash_dedup.one_of_each(df).count() == 4
    for block in (1, 1000):
        same(decontaminate.find_contamination(df, items, block_bytes=block), brute.leaks(rows, items.collect()), "doc_id", "n_words", "n_hit", "items")
        assert brute.order([(r.doc_id, r.text) for r in decontaminate.remove_contamination(df, items, block_bytes=block).collect()]) == brute.order(rows)
    assert [r.taken for r in mixing.mix(df).collect()] == [0] * 4 and not any(r.kept for r in quality.judge(df).collect())
    assert {r.spans for r in secret_scan.find_secrets(df).collect()} == {""} and {r.n_tokens for r in lm_score.score(df, df).collect()} == {0}
