"""Personal data by exact rules and a character-level BiLSTM with CRF transitions.

The rules give the base spans. The tagger is trained on the driver from labelled spans, or one trained before is given: a bounded sample of the documents'
own passages (``sample_chars`` of up to ``sample_rows`` documents chosen by hash, labelled by the rules) and seeded passages in which generated addresses
and numbers of many spellings, and numbers that are none of these, stand between words of those documents. It then reads every
window of every document that can hold a span: every kind has a digit or an at sign, so windows without either
are passed over, and nothing else is. Overlapping windows are averaged and decoded as one. A decoded span is added
where it fits its kind's form and touches no base span.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm import textkit as tk
from loomlake.llm.frames import keyed, shown
from loomlake.llm.spans import listed
from loomlake.llm.tagger import Tagger, classes, stitched

KINDS = ("email", "ip", "card", "phone")
SIZE, STRIDE = 64, 32
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the rules, in time linear in the text.

    An address is found from its at sign: the run of name characters before it, from the end of the last match on, and a
    domain behind. Dotted numbers match in fours from the left of each run. Each rule is leftmost and non-overlapping.
    """
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    if _ANCHOR.search(text):
        for m in _DOTTED.finditer(text):
            parts = m[0].split(".")
            a = m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                b = a + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in four):
                    out.append(("ip", a, b))
                a = b + 1
        for m in _SPACED.finditer(text):
            if m.end() - m.start() >= 14:
                digits = re.sub("[ -]", "", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PLUS.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


def _made(rng: np.random.Generator, kind: str) -> str:
    """An invented value of a kind; of kind "" a number that is no personal data."""
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9)))
    pick = lambda *options: options[rng.integers(len(options))]
    if kind == "email":
        return pick(f"{word()}.{word()}", f"{word()}{d(2)}", word(), f"{word()}_{word()}", f"{word()}.{d(2)}") + "@" + pick("mail", "post", word()) + pick("", d(1)) + "." + pick("example.com", "com", "org", "co.uk", "example.org", "fr")
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(1, 256, 4))
    if kind == "card":
        digits = d(15)
        digits += next(x for x in "0123456789" if luhn(digits + x))
        return pick(digits, " ".join(digits[i : i + 4] for i in range(0, 16, 4)), "-".join(digits[i : i + 4] for i in range(0, 16, 4)))
    if kind == "phone":
        return pick(f"+1 ({d(3)}) 555-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) 555-{d(4)}")
    return pick(f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"{d(2)},{d(3)}.{d(2)}", d(4), d(8), f"{d(2)}:{d(2)}", f"{d(1)}.0", f"#{d(5)}", "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, 40)), d(2), f"{d(3)}-{d(3)}", f"{rng.integers(1900, 2100)}-{rng.integers(1900, 2100)}")


def training_windows(samples: list[str], n: int = 3000, seed: int = 5, sample_words: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tags of labelled windows: generated values between the samples' words, and passages of the samples."""
    rng = np.random.default_rng(seed)
    words = [w for t in samples for w in re.findall(r"[^\s0-9@]+", t)[:sample_words]] or ["the", "of", "and"]
    chars, gold = np.zeros((n, SIZE), np.int64), np.zeros((n, SIZE), np.int64)
    real = [(t, s) for t in samples for s in [base_spans(t)] if s]
    for row in range(n):
        if real and row % 4 == 0:
            text, spans = real[rng.integers(len(real))]
            kind, a, b = spans[rng.integers(len(spans))]
            at = max(0, a - int(rng.integers(0, SIZE - 8)))
            spans = [s for s in spans]
        else:
            text, spans, at = "", [], int(rng.integers(0, 24))
            while len(text) < at + SIZE + 20:
                if rng.random() < 0.25:
                    kind = ("", "", *KINDS)[rng.integers(6)]
                    value = _made(rng, kind)
                    if kind:
                        spans.append((kind, len(text), len(text) + len(value)))
                    text += value
                else:
                    text += words[rng.integers(len(words))]
                text += (" ", " ", " ", " ", "\n", ", ", ". ")[rng.integers(7)]
        part = classes(text[at : at + SIZE])
        chars[row, : len(part)] = part
        for kind, a, b in spans:
            t = KINDS.index(kind)
            for x in range(max(a, at), min(b, at + SIZE)):
                gold[row, x - at] = 2 * t + 2
            if at <= a < at + SIZE:
                gold[row, a - at] = 2 * t + 1
            elif a < at < b:
                gold[row, 0] = 2 * t + 1
    return chars, gold


def trained(samples: list[str], steps: int = 240, sample_words: int = 200) -> Tagger:
    """A tagger for the four kinds, fitted on passages of the samples and on made ones between ``sample_words`` words of each."""
    tagger = Tagger(2 * len(KINDS) + 1)
    tagger.train(*training_windows(samples, sample_words=sample_words), steps=steps)
    return tagger


def plausible(kind: str, value: str) -> bool:
    """Whether a decoded value has its kind's form; numbers that fail a check sum are no cards."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[A-Za-z]{2,}", value) is not None
    if kind == "ip":
        return False  # the rule has them all
    if kind == "card":
        return len(digits) == 13 and luhn(digits) and re.fullmatch(r"[0-9][0-9 -]+[0-9]", value) is not None
    return 9 <= len(digits) <= 12 and len(re.findall(r"[ ().-]+", value)) >= 2 and re.fullmatch(r"[(0-9][0-9 ().-]*[0-9]", value) is not None


def tagged_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans beyond the base, for each text."""
    places, coded = [], []
    for text in texts:
        anchors = {s for m in _ANCHOR.finditer(text) for s in range(max(0, (m.start() - SIZE) // STRIDE + 1), m.start() // STRIDE + 1)}
        places.append([s * STRIDE for s in sorted(anchors)])
        coded.append(classes(text) if anchors else np.empty(0, np.int64))
    out: list[list[tuple[str, int, int]]] = []
    for text, own, stretches in zip(texts, base, stitched(tagger, coded, places, SIZE), strict=True):
        found, taken = [], bytearray(len(text))
        for _, x, y in own:
            taken[x:y] = b"\1" * (y - x)
        for begin, tags in stretches:
            heads = np.flatnonzero(tags % 2 == 1)
            for h in heads:
                t, end = tags[h], h + 1
                while end < len(tags) and tags[end] == t + 1:
                    end += 1
                kind, a, b = KINDS[t // 2], begin + int(h), begin + int(end)
                value = text[a:b].rstrip(" .-,(")
                b = a + len(value)
                around = text[max(0, a - 1) : a] + text[b : b + 1]
                if plausible(kind, value) and not re.search("[0-9A-Za-z]", around) and taken.find(1, a, b) < 0:
                    found.append((kind, a, b))
        out.append(found)
    return out


def _scan(model):
    def run(batches):
        tagger = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more: list[list] = [[] for _ in texts]
            live = [i for i, t in enumerate(texts) if _ANCHOR.search(t)]
            for x in range(0, len(live), 200):
                part = live[x : x + 200]
                for i, found in zip(part, tagged_spans(tagger, [texts[i] for i in part], [base[i] for i in part]), strict=True):
                    more[i] = found
            counts = [pa.array([sum(s[0] == kind for s in own) for own in base], pa.int64()) for kind in KINDS]
            spans = [[listed(own, KINDS) for own in base], [listed(own + add, KINDS) for own, add in zip(base, more, strict=True)]]
            yield pa.record_batch([batch.column("k"), *counts, *(pa.array(s, pa.string()) for s in spans)], names=["k", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return tk.releasing(run)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 512, sample_chars: int = 2000, sample_words: int = 200, steps: int = 240) -> Tagger:
    """A tagger fitted on ``sample_chars`` characters, around the first digit or at sign, of at most ``sample_rows`` documents that have one: the smallest hash
    of id and text for each residue. ``Tagger.saved()`` keeps it as bytes, ``Tagger.loaded`` brings it back.
    """
    # one document for each residue of the hash: the sample is chosen in the shuffle, and the driver gets it alone
    hashed = keyed(docs, id_col, text_col).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("k", "text"))
    around = F.substring("text", F.greatest(F.regexp_instr("text", F.lit("[0-9@]")) - sample_chars // 2, F.lit(1)), F.lit(sample_chars))
    sample = hashed.select(F.pmod("h", F.lit(sample_rows)).alias("slot"), "h", around.alias("part")).groupBy("slot").agg(F.min_by("part", F.struct("h", "part")).alias("part"))
    return trained([r["part"] for r in sample.orderBy("slot").collect()], steps, sample_words)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None, **fitting: int) -> DataFrame:
    """Personal data in every whole text.

    Returns ``id_col``, n_email, n_ip, n_card, n_phone (base spans), base and spans (base spans and all spans, as
    kind:start:end by start, then kind; code points, end exclusive).

    Without a ``tagger``, one is fitted on the documents first; ``fitting`` are the bounds of ``fit``. All documents are scanned. Null text is
    empty. A null id stays null. Rows that repeat an id are scanned one by one. Extra columns are ignored; an empty table gives an empty
    result, from a tagger that saw generated passages only.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger or fit(docs, id_col, text_col, **fitting))
    out = keyed(docs, id_col, text_col).mapInArrow(_scan(model), "k long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
    return out.select(shown().alias(id_col), *(f"n_{k}" for k in KINDS), "base", "spans")
