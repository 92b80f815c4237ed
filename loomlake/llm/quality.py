"""Quality rules, in DataFrame operations only: lines are cleaned first, then documents judged by what is left.

Everything is a projection of a document's own columns, so the plan is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A line that holds one of these, in any case, is boilerplate.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript",
    "click here", "sign in to", "log in to", "subscribe to our", "share this page", "skip to content", "lorem ipsum",
)
#: A line is navigation if it holds this many menu separators.
MENU = 3
#: Closing marks and those inside sentences, of Latin, Greek and Cyrillic text, Chinese and Japanese, Arabic, the Indic scripts, Armenian, Ethiopic, Burmese, Khmer, Tibetan, Mongolian.
MARKS = ".,;:!?…¿¡" + "。、，．；：！？" + "؟،؛۔" + "।॥" + "։՝՞՜" + "።፣፤፥፦፧" + "၊။" + "។" + "།" + "᠂᠃"
#: Letters of scripts whose sentences need no marks: Thai and Lao.
UNMARKED = "\u0E00-\u0EFF"
#: Per cent of a document's words in failing lines beyond which it is rejected.
LOSS = 50


#: White space other than the blank and the line break.
_GAPS = r"[\x09\x0B-\x0D]"


def _words_by_line(text: Column) -> Column:
    """The words of each line: cut at single characters, which needs no pattern matching."""
    return F.transform(F.split(F.regexp_replace(text, _GAPS, " "), "\n"), lambda line: F.array_remove(F.split(line, " "), ""))


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))


def line_fails(line: Column, low: Column, n: Column, n_distinct: Column, boilerplate: tuple[str, ...] = BOILERPLATE, menu: int = MENU) -> Column:
    """Whether a line of n words, n_distinct of them distinct, is no prose; ``low`` is the line in lower case.

    Punctuation: it is shouted (every other word ends in two marks), or has eight words and neither a closing mark nor any inside, in a script that
    uses them. Navigation: it has ``menu`` or more menu separators between its words. Boilerplate: it holds a phrase of the list,
    or as many symbols as half its words, or has under a quarter of its words distinct. A line without words never fails.
    """
    # a plain search goes first where it spares most lines the count
    shouted = F.contains(line, F.lit("!!")) & (F.regexp_count(line, F.lit(r"!!(?=[\x20\x09-\x0D]|$)")) * 2 >= n)
    bare = (n >= 8) & ~line.rlike(f"[{MARKS}{UNMARKED}]")
    menus = F.regexp_count(line, F.lit(r"(^|[\x20\x09-\x0D])[|»›·•](?=[\x20\x09-\x0D]|$)")) >= menu
    marked = line.rlike(f"[{SYMBOLS}»›·•]") & (menus | (line.rlike(f"[{SYMBOLS}]") & (_symbols(line) * 2 >= n)))
    phrase = reduce(Column.__or__, (F.contains(low, F.lit(p)) for p in boilerplate), F.lit(False))
    repeated = (n >= 16) & (n_distinct * 4 < n)
    return (n > 0) & (shouted | bare | marked | repeated | phrase)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of five that the text has twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(5))))
    return F.when(F.size(words) >= 6, hashes).otherwise(F.array().cast("array<bigint>"))


def _placed(hashes: Column) -> Column:
    """Windows by hash and position, if any hash comes twice; else none."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(pairs)).otherwise(F.array().cast("array<struct<h: bigint, p: int>>"))


def _twice(placed: Column) -> Column:
    """Positions, in order, of the windows whose neighbour in ``placed`` has the same hash."""
    same = lambda x, i: F.coalesce(F.get(placed, i)["h"] == x["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(placed, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))


def _covered(at: Column) -> Column:
    """Words in the union of windows of five at ascending positions."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    return F.aggregate(at, zero, lambda acc, p: F.struct((p + 5).alias("end"), (acc["total"] + p + 5 - F.greatest(acc["end"], p)).alias("total")), lambda acc: acc["total"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and is gone with the row; as a column it would be copied into every row of the projections above."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(by_line: Column) -> Column:
    """n_words, word_chars and n_repeat_words of the words by line."""

    def of(words: Column) -> Column:
        repeated = _let(_repeat_words(words), lambda hashes: _let(_placed(hashes), lambda placed: _covered(_twice(placed))))
        return F.struct(F.size(words).alias("n_words"), F.length(F.array_join(words, "")).alias("word_chars"), repeated.alias("n_repeat_words"))

    return _let(F.flatten(by_line), of)


def _lines(lines: Column, by_line: Column, fails: Callable[..., Column]) -> Column:
    """Each line with its number of words and whether it fails."""
    distinct = lambda words: F.when(F.size(words) >= 16, F.size(F.array_distinct(words))).otherwise(F.size(words))
    counts = lambda line, words: F.struct(line.alias("line"), F.lower(line).alias("low"), F.size(words).alias("n"), distinct(words).alias("d"))
    return F.transform(F.zip_with(lines, by_line, counts), lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), fails(x["line"], x["low"], x["n"], x["d"]).alias("fails")))


def _measured(text: Column, fails: Callable[..., Column]) -> Column:
    """What ``judge`` returns of a text, as one value; a text's words and lines live only while it is measured."""
    full = lambda judged: F.transform(F.filter(judged, lambda x: x["n"] > 0), lambda x: x["line"])
    good = lambda judged: F.array_join(F.transform(F.filter(judged, lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    lost = lambda judged: F.aggregate(judged, F.lit(0), lambda acc, x: acc + F.when(x["fails"], x["n"]).otherwise(0))

    def of(judged: Column, words: Column) -> Column:
        return F.struct(
            words["n_words"].cast("bigint").alias("n_words"), words["word_chars"].cast("bigint").alias("word_chars"), _symbols(text).cast("bigint").alias("n_symbols"),
            _let(full(judged), lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("bigint").alias("n_dup_lines"), words["n_repeat_words"].cast("bigint").alias("n_repeat_words"),
            F.when(F.exists(judged, lambda x: x["fails"]), good(judged)).otherwise(text).alias("clean_text"), lost(judged).cast("bigint").alias("n_removed_words"),
        )

    return _let(_words_by_line(text), lambda by_line: _let(_lines(F.split(text, "\n"), by_line, fails), lambda judged: _let(_repeated(by_line), lambda words: of(judged, words))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss: int = LOSS, carry: tuple[str, ...] = (), boilerplate: tuple[str, ...] = BOILERPLATE, menu: int = MENU) -> DataFrame:
    """Measures and verdict for each document, with the text that is left of it.

    Returns ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, clean_text,
    base_failed (under 10 words, or over 20 % of them in repeated windows of five), kept (not base_failed, and at
    most ``loss`` per cent of the words in failing lines). clean_text has the lines that did not fail.

    Columns named in ``carry`` come along behind these. ``boilerplate`` are phrases in lower case, of whatever languages the corpus has; the default is
    a short English list.

    Null text has no words and is rejected, like an empty one. Rows that repeat an id are judged one by one; a
    null id stays null. Extra columns are ignored; an empty table gives an empty result.
    """
    carried = [docs[c].alias(f"__{i}") for i, c in enumerate(carry)]
    base = docs.select(docs[id_col].cast("bigint").alias("k"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *carried)
    fails = lambda line, low, n, d: line_fails(line, low, n, d, boilerplate, menu)
    measured = base.select(
        "k", *(f"__{i}" for i in range(len(carry))), _measured(F.col("text"), fails).alias("m"),
        # a column that is not deterministic keeps filters on the verdict from being copied below the measures
        F.monotonically_increasing_id().alias("row"),
    ).select("*", "m.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = measured.withColumn("base_failed", failed)
    out = out.withColumn("kept", (F.col("row") >= 0) & ~F.col("base_failed") & (100 * F.col("n_removed_words") <= loss * F.col("n_words")))
    behind = [F.col(f"__{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(F.col("k").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "clean_text", "base_failed", "kept", *behind)
