"""The main text of web pages: flat blocks, judged by their words, links and neighbours with a decision tree.

Python cuts each page into blocks; what a block's neighbours are like, and the verdict of the tree, are column expressions over the page's array of
blocks, so a page is read once, never leaves its row, and nothing is shuffled. The tree is fitted by Spark on a small table of labelled blocks: of
pages that ``labelled`` makes up by a rule, in layouts with and without telling markup.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm import html_blocks as hb
from loomlake.llm import textkit as tk

#: Labelled pages that the tree is fitted on, of about 20 blocks each.
PAGES = 400
_BLOCK = "text string, words int, linked int, kind int, inner int, against int, outside int, ends boolean, titled boolean"
_ARROW = pa.struct([("text", pa.string()), *((c, pa.int32()) for c in ("words", "linked", "kind", "inner", "against", "outside")), ("ends", pa.bool_()), ("titled", pa.bool_())])
#: Pages whose blocks are handed over at once, in bytes.
CHUNK = 2_000_000


def segmented(pages: DataFrame, html_col: str) -> DataFrame:
    """``pages`` with ``html_col`` replaced by ``blocks``, the page's flat text blocks in order."""
    others = [c for c in pages.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < len(batch):
                found, size, start = [], 0, at
                while at < len(batch) and size < CHUNK:
                    page = batch.column(html_col)[at].as_py() or ""
                    found.append([dict(zip(_ARROW.names, b, strict=True)) for b in hb.blocks(page)])
                    size, at = size + len(page), at + 1
                some = batch.slice(start, at - start)
                yield pa.record_batch([some.column(c) for c in others] + [pa.array(found, pa.list_(_ARROW))], names=[*others, "blocks"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html_col)
    return pages.mapInArrow(tk.releasing(run), f"{kinds}, blocks array<struct<{_BLOCK.replace(' ', ': ').replace(',:', ',')}>>")


def _density(b: Column) -> Column:
    return F.coalesce(b["linked"] / b["words"], F.lit(0.0))


def features(blocks: Column) -> Column:
    """The blocks as (text, f), f holding the numbers that the tree asks about: of the block, of the one before and the one behind, and of the page."""
    marked = F.exists(blocks, lambda b: (b["inner"] == hb.FOR) & (b["outside"] == 0)).cast("double")

    def one(b: Column, i: Column) -> Column:
        before, behind = F.when(i > 0, F.get(blocks, i - 1)), F.get(blocks, i + 1)
        near = [n for x in (before, behind) for n in (F.coalesce(x["words"], F.lit(0)).cast("double"), _density(x))]
        own = [b[c].cast("double") for c in ("words", "kind", "inner", "against", "outside", "ends", "titled")]
        return F.struct(b["text"].alias("text"), F.array(*own, _density(b), *near, marked).alias("f"))

    return F.transform(blocks, one)


def _nodes(lines: list[str]) -> tuple:
    """A fitted tree from its printed form: (feature, bound, at most, above), or (verdict,) for a leaf."""
    line = lines.pop(0)
    if leaf := re.match(r"\s*Predict: ([\d.]+)", line):
        return (float(leaf[1]) == 1.0,)
    asked = re.match(r"\s*If \(feature (\d+) <= ([-\d.eE]+)\)", line)
    low = _nodes(lines)
    lines.pop(0)
    return int(asked[1]), float(asked[2]), low, _nodes(lines)


def _verdict(f: Column, node: tuple) -> Column:
    if len(node) == 1:
        return F.lit(node[0])
    return F.when(F.get(f, F.lit(node[0])) <= node[1], _verdict(f, node[2])).otherwise(_verdict(f, node[3]))


class Tree:
    """A fitted tree; ``nodes`` is plain data, so it can be kept and given again."""

    def __init__(self, nodes: tuple):
        self.nodes = nodes

    def keeps(self, f: Column) -> Column:
        return _verdict(f, self.nodes)


def fit(spark: SparkSession, labels: DataFrame | None = None, depth: int = 9) -> Tree:
    """A tree fitted on ``labels`` (html, labels: one 0 or 1 for each of the page's blocks), by default on ``labelled()``."""
    if labels is None:
        labels = spark.createDataFrame(labelled(), "html string, labels array<int>")
    rows = segmented(labels.select("html", "labels"), "html").select(F.explode(F.arrays_zip(features(F.col("blocks")).alias("x"), "labels")).alias("z"))
    table = rows.select(array_to_vector(F.col("z.x.f")).alias("features"), F.col("z.labels").cast("double").alias("label"))
    table = table.coalesce(2).persist()
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=128, minInstancesPerNode=3, seed=1).fit(table)
    table.unpersist()
    return Tree(_nodes(model.toDebugString.rstrip().split("\n")[1:]))


_FITTED: dict[int, Tree] = {}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """Each page's main text: the blocks that the tree keeps, in order, with an empty line between them.

    Returns ``id_col``, ``url_col``, text and n_chars. Character references are decoded and white space within a block is one space.

    A null or empty page has the empty text, and so has one of which no block is kept. Rows that repeat an id are pages of their own;
    null ids and addresses stay null. Markup of any kind is read: unclosed elements end with those around them, an unclosed comment or script with
    the page. Extra columns are ignored; an empty table gives an empty result. Without ``tree`` one is fitted, once a process.
    """
    if tree is None:
        tree = _FITTED.get(PAGES) or _FITTED.setdefault(PAGES, fit(pages.sparkSession))
    cut = segmented(pages.select(pages[id_col].alias("id"), pages[url_col].alias("address"), pages[html_col].cast("string").alias("page")), "page")
    kept = F.filter(features(F.col("blocks")), lambda b: tree.keeps(b["f"]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    out = cut.select("id", "address", text.alias("text"))
    return out.select(F.col("id").alias(id_col), F.col("address").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))


def labelled(pages: int = PAGES, seed: int = 13) -> list[tuple[str, list[int]]]:
    """Pages made up by a rule, each with a label for every block: 1 main text, 0 not."""
    return [_Page(random.Random(f"{seed}:{i}")).made() for i in range(pages)]


class _Page:
    """One made-up page. Styles: telling elements, telling class names, only the article marked, only the rest marked, nothing marked."""

    NAMES = {  # part: element, class names
        "header": ("header", "site-header masthead topbar"), "nav": ("nav", "menu navbar main-nav"), "notice": ("div", "cookie-notice consent-banner alert"), "ad": ("div", "ad advert sponsored ad-slot"),
        "search": ("form", "search-form"), "crumbs": ("nav", "breadcrumbs"), "side": ("aside", "sidebar widget-area"), "related": ("aside", "related recommended"), "share": ("div", "share social-buttons"),
        "comments": ("section", "comments comment-list"), "letter": ("form", "newsletter subscribe"), "footer": ("footer", "footer site-footer copyright"), "article": ("article", "article post-content entry story-body"),
    }

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []
        self.style = rng.choice(["elements", "elements", "classes", "classes", "article", "rest", "bare"])
        syllables = [a + b for a in "bcdfglmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "is")]
        self.words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(300)]

    def some(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high)))

    def sentences(self, words: int) -> str:
        out = []
        while words > 0:
            n = min(words, self.rng.randint(1, 18))
            out.append(self.some(n, n).capitalize() + self.rng.choice([".", ".", ".", "?", "!"]))
            words -= n
        return " ".join(out)

    def leaf(self, tag: str, text: str, label: int, link: bool = False) -> None:
        inside = f'<a href="/{len(self.out)}">{text}</a>' if link else text
        self.out.append(f"<{tag}>{inside}</{tag}>" if self.rng.random() < 0.95 or tag not in ("p", "li") else f"<{tag}>{inside}")
        self.labels.append(label)

    def part(self, name: str) -> str:
        """Opens a part and returns its end tag."""
        tag, classes = self.NAMES[name]
        main = name == "article"
        named = self.style in ("elements", "classes") or self.style == ("article" if main else "rest")
        if self.style == "classes" or not named:
            tag = "div"
        cls = f' class="{self.rng.choice(classes.split())}"' if named and (self.style != "elements" or tag in ("div", "section") or self.rng.random() < 0.3) else ""
        self.out.append(f"<{tag}{cls}>")
        return f"</{tag}>"

    def links(self, low: int, high: int, words: int = 3) -> None:
        self.out.append("<ul>")
        for _ in range(self.rng.randint(low, high)):
            self.leaf("li", self.some(1, words), 0, True)
        self.out.append("</ul>")

    def paragraph(self) -> None:
        short = self.rng.random() < 0.2
        text = self.sentences(self.rng.randint(1, 8) if short else self.rng.randint(9, 120))
        if not short and self.rng.random() < 0.3:
            text += f' <a href="/x">{self.some(1, 4)}</a> {self.sentences(self.rng.randint(4, 30))}'
        self.leaf("p", text, 1)

    def article(self) -> None:
        end, rng = self.part("article"), self.rng
        if rng.random() < 0.85:
            inside = rng.random() < 0.2
            self.out.append("<header>" * inside)
            self.leaf("h1", self.some(2, 12).capitalize() + rng.choice(["", ".", "?"]), 1)
            self.out.append("</header>" * inside)
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.78:
                self.paragraph()
            elif kind < 0.86:
                self.leaf(rng.choice(["h2", "h3"]), self.some(1, 8).capitalize(), 1)
                self.paragraph()
            elif kind < 0.92:
                self.out.append("<ul>")
                for _ in range(rng.randint(2, 5)):
                    self.leaf("li", self.some(2, 20), 1)
                self.out.append("</ul>")
            elif kind < 0.96:
                self.leaf("blockquote", self.sentences(rng.randint(5, 40)), 1)
            elif self.style != "bare" and self.style != "article":
                close = self.part(rng.choice(["ad", "related", "share"]))
                self.leaf("p", self.sentences(rng.randint(2, 20)), 0, rng.random() < 0.5)
                self.out.append(close)
        if self.style in ("elements", "classes", "rest") and rng.random() < 0.2:
            self.comments()
        self.out.append(end)

    def comments(self) -> None:
        end = self.part("comments")
        self.leaf("h3", self.some(1, 3), 0)
        for _ in range(self.rng.randint(1, 6)):
            self.leaf(self.rng.choice(["p", "div", "li"]), self.sentences(self.rng.randint(2, 80)), 0)
        self.out.append(end)

    def made(self) -> tuple[str, list[int]]:
        rng, maybe = self.rng, lambda p: self.rng.random() < p
        marked = self.style != "bare"
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.some(2, 8)}</title><style>p{{}}</style></head><body>")
        if maybe(0.4):
            end = self.part("header")
            self.leaf("div", self.some(1, 4), 0, maybe(0.7))
            if maybe(0.4):
                self.leaf("p", self.some(2, 9), 0)
            self.out.append(end)
        if maybe(0.85):
            end = self.part("nav")
            self.links(3, 10)
            self.out.append(end)
        if maybe(0.25):
            end = self.part("notice")
            self.leaf("p", self.sentences(rng.randint(5, 45)), 0) if marked else self.leaf("p", self.some(1, 6), 0, True)
            self.out.append(end)
        if maybe(0.15):
            end = self.part("crumbs")
            self.links(2, 4)
            self.out.append(end)
        if maybe(0.4):
            end = self.part("ad")
            self.leaf("div", self.sentences(rng.randint(2, 25 if marked else 8)), 0, maybe(0.3))
            self.out.append(end)
        if maybe(0.15):
            end = self.part("search")
            self.leaf("div", self.some(1, 3), 0)
            self.out.append(end)
        self.article()
        if maybe(0.25):
            end = self.part("share")
            self.links(2, 5, 2)
            self.out.append(end)
        if maybe(0.3):
            end = self.part("related")
            self.leaf("h3", self.some(1, 3), 0)
            self.links(2, 6, 9)
            self.out.append(end)
        if marked and maybe(0.3):
            self.comments()
        if maybe(0.3):
            end = self.part("side")
            self.leaf("h4", self.some(1, 3), 0)
            self.links(2, 8, 6)
            if marked and maybe(0.4):
                self.leaf("p", self.sentences(rng.randint(4, 40)), 0)
            self.out.append(end)
        if maybe(0.15):
            end = self.part("letter")
            self.leaf("p", self.sentences(rng.randint(2, 20 if marked else 5)), 0)
            self.out.append(end)
        if maybe(0.85):
            end = self.part("footer")
            if maybe(0.5):
                self.links(1, 6, 2)
            self.leaf("p" if maybe(0.5) else "div", "&copy; " + self.some(1, 25 if marked else 8) + rng.choice(["", "."]), 0)
            self.out.append(end)
        self.out.append("</body></html>" if maybe(0.9) else "")
        return "".join(self.out), self.labels
