"""Main text of web pages by gradient-boosted trees over features of DOM elements.

No table has labels for pages, so the trees learn from pages that are composed here, of parts whose nature is known:
articles in containers of all kinds, named or not, or in none, with bare text, lists, tables and figures; menus, headers,
footers, sidebars, notices, adverts, forms and comments with the names that authors use. Spark ML fits the trees. Each
element of a page gets the probability that it holds main text, and the decoding takes the most likely choice in which
nothing is kept below an element that is dropped; elements count by their own text, so that a doubtful container does not
outweigh its paragraphs.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweave.llm.dom import FEATURES, Page, features

#: The bounds of what is fitted.
TRAINING_PAGES, TREES, DEPTH, SEED = 900, 24, 5, 17


def composed(rng: random.Random) -> tuple[str, set[int]]:
    """A page and the numbers of its elements, in the order of their start tags, that hold main text. The root is 0."""
    out: list[str] = []
    good: set[int] = set()
    number = 0

    def open_(tag: str, names: str = "", keep: bool = False) -> None:
        nonlocal number
        number += 1
        if keep:
            good.add(number)
        out.append(f"<{tag}{f' {rng.choice(["class", "id"])}={chr(34)}{names}{chr(34)}' if names else ''}>")

    def words(low: int, high: int) -> str:
        w = ["".join(rng.choice(["an", "er", "th", "ion", "en", "st", "la", "de", "qu", "é", "ing", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        for k in range(len(w)):
            if rng.random() < 0.12:
                w[k] += rng.choice([".", ",", "."])
        return " ".join(w)

    def leaf(tag: str, low: int, high: int, keep: bool, names: str = "") -> None:
        open_(tag, names, keep)
        if keep and rng.random() < 0.25:
            inner = rng.choice(["b", "em", "a", "span", "i"])
            out.append(words(1, 8) + " ")
            open_(inner, "", True)
            out.append(words(1, 6) + f"</{inner}> ")
        out.append(words(low, high))
        if rng.random() < 0.9 or tag not in ("p", "li"):
            out.append(f"</{tag}>")

    def links(container: str, names: str, count: int) -> None:
        open_(container, names)
        listed = rng.random() < 0.7
        if listed:
            open_("ul")
        for _ in range(count):
            if listed:
                open_("li")
            open_("a")
            out.append(words(1, 4) + "</a>")
            if listed:
                out.append("</li>")
        out.append(("</ul>" if listed else "") + f"</{container}>")

    def box(container: str, names: str, paragraphs: int, high: int = 25) -> None:
        open_(container, names)
        if not paragraphs or rng.random() < 0.3:
            out.append(words(2, high))
        for _ in range(paragraphs):
            leaf(rng.choice(["p", "div", "span", "p"]), 2, high, False)
        if rng.random() < 0.3:
            open_("a")
            out.append(words(1, 3) + "</a>")
        out.append(f"</{container}>")

    def form() -> None:
        open_("form", rng.choice(["", "search", "newsletter-form", "login"]))
        leaf("label", 1, 4, False)
        open_("input")
        leaf("button", 1, 2, False)
        out.append("</form>")

    def noise() -> None:
        kind = rng.choice(["advert", "notice", "side", "form", "share", "menu", "plain"])
        if kind == "advert":
            box("div", rng.choice(["ad", "ads", "advert", "sponsored", "promo box", "ad-slot"]), rng.randint(0, 2))
        elif kind == "notice":
            box(rng.choice(["div", "section"]), rng.choice(["cookie-notice", "consent", "notice", "alert", "gdpr-banner", "popup"]), rng.randint(1, 2))
        elif kind == "side":
            box(rng.choice(["aside", "div"]), rng.choice(["sidebar", "related", "widget", "rail"]), rng.randint(1, 4))
        elif kind == "form":
            form()
        elif kind == "share":
            links("div", rng.choice(["share", "social-links"]), rng.randint(2, 4))
        elif kind == "menu":
            links(rng.choice(["nav", "div"]), rng.choice(["menu", "navbar", "breadcrumbs", "pagination"]), rng.randint(2, 8))
        else:
            links("aside", "", rng.randint(2, 5))

    def article(high: int) -> None:
        """What an article is made of, in an element that is open."""
        if rng.random() < 0.75:
            leaf(rng.choice(["h1", "h1", "h2"]), 3, 14, True)
        if rng.random() < 0.15:
            leaf("p", 2, 6, True, rng.choice(["", "meta", "byline", "date"]))
        bare = rng.random() < 0.2
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13])):
            r = rng.random()
            if bare and r < 0.5:
                out.append(words(*rng.choice([(2, 8), (15, 60)])) + rng.choice(["<br>", "<br><br>", " "]))
            elif r < 0.66:
                leaf("p", *rng.choice([(1, 2), (3, 12), (20, high // 2), (40, high)]), True)
            elif r < 0.73:
                leaf(rng.choice(["h2", "h3", "h4"]), 1, 8, True)
            elif r < 0.78:
                leaf(rng.choice(["blockquote", "pre"]), *rng.choice([(1, 6), (5, 40)]), True)
            elif r < 0.83:
                tag = rng.choice(["ul", "ol"])
                open_(tag, "", True)
                for _ in range(rng.randint(2, 5)):
                    leaf("li", 2, 20, True)
                out.append(f"</{tag}>")
            elif r < 0.87:
                leaf("div", 10, 60, True)
            elif r < 0.9:
                open_("figure", "", True)
                open_("img", "", True)
                leaf("figcaption", 3, 15, True)
                out.append("</figure>")
            elif r < 0.92:
                open_("table", "", True)
                for _ in range(rng.randint(1, 4)):
                    open_("tr", "", True)
                    for _ in range(rng.randint(2, 3)):
                        leaf(rng.choice(["td", "td", "th"]), 1, 5, True)
                    out.append("</tr>")
                out.append("</table>")
            elif r < 0.94:
                open_("dl", "", True)
                for _ in range(rng.randint(1, 3)):
                    leaf("dt", 1, 4, True)
                    leaf("dd", 4, 25, True)
                out.append("</dl>")
            elif r < 0.965:
                open_("section", "", True)
                leaf(rng.choice(["h2", "h3"]), 1, 6, True)
                for _ in range(rng.randint(1, 3)):
                    leaf("p", 10, high, True)
                out.append("</section>")
            else:
                noise()
        if rng.random() < 0.1:
            box("footer", "", 0, 12)

    bodied = rng.random() < 0.9  # else a fragment
    if bodied:
        open_("html", "", True)
        if rng.random() < 0.5:  # an element of its own
            open_("head")
            open_("meta")
            out.append("<title>x</title></head>")
        open_("body", "", True)
    alone = not bodied or rng.random() < 0.12  # nothing but the article
    if not alone and rng.random() < 0.7:
        header = rng.random() < 0.5
        if header:
            open_("header", rng.choice(["", "site-header", "masthead"]))
            leaf(rng.choice(["div", "h2", "span", "p"]), 1, 5, False)
        links(rng.choice(["nav", "nav", "div", "ul"]), rng.choice(["", "", "menu", "nav", "navbar", "top-menu"]), rng.randint(2, 9))
        if header:
            out.append("</header>")
    for _ in range(0 if alone else rng.randint(0, 2)):
        noise()
    neutral = ["", "", "wrapper", "container", "page", "main", "layout", "row", "col", "inner", "grid", "section1"]
    wrappers = []
    for _ in range(rng.choice([0, 0, 1, 2, 3])):
        wrappers.append(rng.choice(["div", "div", "section", "main"]))
        open_(wrappers[-1], rng.choice(neutral), True)
    high = rng.choice([60, 160])
    kind = rng.random()
    if kind < 0.2:  # in no container of its own
        article(high)
    else:
        container = rng.choice(["article", "article", "main", "div", "div", "section"])
        named = rng.choice(["content", "post-content", "article-body", "entry", "story", "main-text"]) if container in ("div", "section") and kind < 0.55 else rng.choice([*neutral, "post"])
        open_(container, named, True)
        article(high)
        out.append(f"</{container}>")
    if rng.random() < 0.35 and not alone:
        tag = rng.choice(["section", "div"])
        open_(tag, rng.choice(["comments", "comment-list", "discussion", "replies"]))
        leaf("h3", 1, 3, False)
        for _ in range(rng.randint(1, 5)):
            box(rng.choice(["div", "div"]), rng.choice(["comment", "comment", "reply", ""]), rng.randint(1, 2), 60)
        out.append(f"</{tag}>")
    out += [f"</{w}>" for w in wrappers[::-1]]
    for _ in range(0 if alone else rng.randint(0, 2)):
        noise()
    if not alone and rng.random() < 0.8:
        tag = rng.choice(["footer", "footer", "div"])
        box(tag, rng.choice(["", "footer"]) if tag == "footer" else rng.choice(["footer", "copyright", "bottom"]), rng.choice([0, 0, 1, 2]))
    if bodied:
        out.append("</body></html>")
    return "".join(out), good


class Trees:
    """Boosted trees as arrays."""

    def __init__(self, text: str, weights: list[float]):
        """text: the model as Spark ML prints it."""
        self.weights, self.trees = weights, []
        for part in re.split(r"\n\s*Tree \d+ .*\n", text)[1:]:
            lines = [x.strip() for x in part.split("\n") if x.strip()]
            nodes: list[list[float]] = []
            at = 0

            def read() -> int:
                nonlocal at
                me = len(nodes)
                nodes.append([0, 0, 0, 0, 0])
                if m := re.match(r"Predict: (\S+)", lines[at]):
                    at += 1
                    nodes[me] = [0, np.inf, me, me, float(m[1])]
                    return me
                m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at])
                at += 1
                left = read()
                at += 1  # the line of Else
                nodes[me] = [int(m[1]), float(m[2]), left, read(), 0]
                return me

            read()
            self.trees.append(np.array(nodes))

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for w, t in zip(self.weights, self.trees, strict=True):
            feature, bound, left, right = t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int)
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = np.where(x[rows, feature[at]] <= bound[at], left[at], right[at])
            margin += w * t[at, 4]
        return 1 / (1 + np.exp(-2 * margin))


def fit(spark: SparkSession, pages: int = TRAINING_PAGES) -> Trees:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(SEED)
    rows: list[list[float]] = []
    for _ in range(pages):
        source, good = composed(rng)
        page = Page(source)
        x = features(page)
        rows += [[*map(float, x[k]), float(k in good)] for k in range(1, len(x))]
    table = pa.Table.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)], names=[*FEATURES, "label"])
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(spark.createDataFrame(table)).select("label", "features").coalesce(2).cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED).fit(data)
    data.unpersist()
    return Trees(model.toDebugString, list(model.treeWeights))


def decode(page: Page, probability: np.ndarray) -> np.ndarray:
    """The most likely choice of kept elements in which all ancestors of a kept element are kept.

    An element weighs by the logarithm of its own text, one without text little: it matters for what is in it.
    """
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    weight = 0.25 + np.log1p(page.own()) / 4
    keep, drop = weight * np.log(p), weight * np.log(1 - p)
    keep[0], drop[0] = 0.0, -np.inf  # the page itself
    for k in range(len(p) - 1, 0, -1):  # children come after their parents
        keep[page.parent[k]] += max(keep[k], drop[k])
        drop[page.parent[k]] += drop[k]
    kept = np.zeros(len(p), bool)
    kept[0] = True
    for k in range(1, len(p)):
        kept[k] = kept[page.parent[k]] and keep[k] >= drop[k]
    return kept


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages(page_id, url, html).

    text: the kept blocks in page order, each with white space folded to single blanks and trimmed, joined by line
    feeds. Text outside all elements is main text if it has a letter or a digit. Null, empty and blank pages, and pages without
    main text, give the empty text. Repeated rows give equal results; other columns are ignored; an empty table gives an
    empty result.
    """
    trees = trees or fit(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sources = part.column(2).to_pylist()
                parsed = [Page(h) for h in sources]
                x = [features(p) for p in parsed]
                probability = trees.probability(np.concatenate(x))
                cuts = np.cumsum([0] + [len(f) for f in x])
                texts = []
                for k, p in enumerate(parsed):
                    kept = decode(p, probability[cuts[k] : cuts[k + 1]])
                    kept[0] = any(c.isalnum() for e, t in p.runs if e == 0 for c in t)
                    texts.append("\n".join(p.blocks(kept)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
