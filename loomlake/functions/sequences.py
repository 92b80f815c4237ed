"""Column functions on sequences, multi-value strings and rule lists; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(x: Column) -> Column:
    """ASCII letters only, upper case."""
    return F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z]", ""))


def split_values(x: Column, sep: str = r"\|") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), sep), F.trim), lambda t: t != "")


def join_values(xs: Column, sep: str = "|") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(xs, lambda t: t.isNotNull() & (t != "")))), sep)


def recode(x: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """Dictionary lookup; without a default an unknown key raises."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    other = F.raise_error(F.concat(F.lit("unknown key: "), x)) if default is None else F.lit(default)
    return F.coalesce(F.try_element_at(table, x), other)


def first_present(xs: Column, order: Sequence[str], default: str = "UNKNOWN") -> Column:
    return F.coalesce(*[F.when(F.array_contains(xs, p), p) for p in order], F.lit(default))


def none_of(xs: Column, vocabulary: Sequence[str]) -> Column:
    return ~F.exists(xs, lambda x: F.lower(F.trim(x)).isin(*vocabulary))


def any_substring(x: Column, vocabulary: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, vocabulary)), lambda v: F.contains(F.lower(x), v))


def qc_flags(seq: Column, low: int = 50, high: int = 1000, alphabet: str = "ACDEFGHIKLMNPQRSTVWY") -> Column:
    n = F.length(seq)
    flags = F.array(F.when(n == 0, "empty"), F.when((n > 0) & (n < low), "too_short"), F.when(n > high, "too_long"), F.when(seq.rlike(f"[^{alphabet}]"), "nonstandard"))
    return F.filter(flags, lambda f: f.isNotNull())


def passes_qc(seq: Column, blob: Column, banned: str, low: int = 50, high: int = 1000, alphabet: str = "A-Z") -> Column:
    return F.length(seq).between(low, high) & ~seq.rlike(f"[^{alphabet}]") & ~blob.rlike(banned)


def decide(rules: Sequence[tuple[Column, str, str]], default: tuple[str, str]) -> Column:
    """The first rule that holds gives (label, reason)."""
    pair = lambda label, reason: F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))
    out = F.when(rules[0][0], pair(*rules[0][1:]))
    for test, label, reason in rules[1:]:
        out = out.when(test, pair(label, reason))
    return out.otherwise(pair(*default))


def motif_positions(seq: Column, motif: str, size: int, shift: int = 0) -> Column:
    """0-based starts (plus shift) of all occurrences, overlapping ones included.

    Whether a start is possible is asked of the whole text at once, and marks stand in its place; only there are the letters compared as ``size`` of
    them. Both are cut apart once and only where a mark is, so the work grows with the length and not with its square. A motif has no anchors.
    """
    at, mark = F.sequence(F.lit(1), F.length(seq) - size + 1), F.lit("\u0001")
    # a mark takes one letter and looks at what follows, so starts may overlap
    marked = F.regexp_replace(seq, f"(?=(?:{motif}))[\\s\\S]", "\u0001")
    whole = lambda cut, i: F.array_join(F.slice(cut["letters"], i, size), "").rlike(f"^(?:{motif})$")
    within = lambda cut: F.filter(at, lambda i: (F.get(cut["marks"], i - 1) == mark) & whole(cut, i))
    cut = lambda m: F.transform(F.array(F.struct(F.split(m, "").alias("marks"), F.split(seq, "").alias("letters"))), within)[0]
    hits = F.transform(F.array(marked), lambda m: F.when(F.contains(m, mark), cut(m)))[0]
    none = F.array().cast("array<int>")
    return F.when(F.length(seq) >= size, F.coalesce(F.transform(hits, lambda i: i - 1 + shift), none)).otherwise(none)


def fraction(seq: Column, letter: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(letter)))) / F.greatest(F.length(seq), F.lit(1)).cast("double")


def centred(seq: Column, at: Column, reach: int) -> Column:
    """The window of ``reach`` letters either side of a 0-based position, clipped at the ends."""
    start = F.greatest(at - reach, F.lit(0))
    return F.substr(seq, start + 1, at + reach + 1 - start)


def padded(seq: Column, at: Column, reach: int, fill: str = "-") -> Column:
    """As ``centred``, with what the sequence's start cuts off filled up on the left, so that the centre keeps its place."""
    return F.concat(F.repeat(F.lit(fill), F.greatest(reach - at, F.lit(0)).cast("int")), centred(seq, at, reach))


def letter_at(seq: Column, at: Column) -> Column:
    """The letter at a 0-based position, null outside the sequence."""
    return F.when((at >= 0) & (at < F.length(seq)), F.substr(seq, at + 1, F.lit(1)))


def nearest(xs: Column, x: Column) -> Column:
    """The element closest to a value, the smaller of two as close."""
    return F.array_min(F.transform(xs, lambda g: F.struct(F.abs(g - x).alias("gap"), g.alias("value"))))["value"]


def truncate(seq: Column, n: int = 1022) -> Column:
    return F.substring(seq, 1, n)


def f_score(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), F.lit(0.0))
