"""Main text of web pages by the maximum-scoring subsequence of words and tags.

Each word's and tag's chance to be the article's follows from the boxes around it: a logistic model of element names and
class words, fitted on pages that mark their article. Words score positive, more so where they are likely the article's;
tags score negative, more so where they are not. One scan finds the contiguous part with the best sum; a second one
over that part cuts out where its running sum falls, so what boxes inside the article hold beside it goes too.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.llm.binary import slices
from transcript_lake.llm.common import hashed_sample, table

#: Weights are fitted on about so many pages, those of the least hash among the ones that mark their main part.
TRAIN_PAGES = 2_000

#: What a tag costs where words are the article's, and how much more where they are not.
TAG, OUTSIDE = 0.02, 0.5

#: A fall of the running sum by DIP parts the best region; it goes on where the sum has risen by RISE.
DIP, RISE = 0.75, 0.5

#: A box with so large a share of a page's words holds the article, whatever its name.
HOLDS = 0.9

#: A page marks its main part if one word in so many lies in it.
MARKED = 10

#: The fit: steps, their size, weight of the squared distance from the weights before it.
STEPS, PACE, RIDGE = 400, 0.1, 0.002

# Fixed values of HTML: names of elements.
RAW = ("script", "style", "textarea", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
PHRASING = frozenset("b i em strong span font u a".split())
MAIN = ("article", "main")
ASIDE = frozenset("nav aside footer form head menu dialog".split())
#: Elements whose words are controls, drawings or stand-ins.
CONTROL = frozenset("button canvas iframe math noscript object option select svg template".split())
#: Words of a class, id or role that name what stands beside an article.
BESIDE = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related reply replies respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>\"'<]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def before_fit(feature: str) -> float:
    """The weight of a feature that no page has taught: names of what stands beside an article tell against it, all others nothing."""
    if feature == "":
        return 2.0
    if feature == "main":
        return 1.0
    if feature == "li a":
        return -1.0
    if feature.startswith("."):
        return -8.0 if BESIDE.issuperset(feature[1:].split("-")) else 0.0
    return -8.0 if feature in ASIDE or feature in CONTROL or feature in ("header", "beside main") else 0.0


def features(name: str, rest: str, in_main: bool, parent: str) -> list[str]:
    """What the model sees of an element: its name, if it is a box's, and the words of its classes, id and role."""
    named = [[w.lower() for w in PARTS.findall(x)] for a in NAMED.finditer(rest) for x in (a[1] or a[2] or a[3] or "").split()]
    out = ["." + "-".join(x) for x in named if x]
    if name in MAIN or (name not in ("html", "body") and any("main" in x for x in named) and not any(w in BESIDE for x in named for w in x)):
        out.append("main")
    if name in ASIDE or name in CONTROL or (name == "header" and not in_main):
        out.append(name)
    if name == "a" and parent == "li":
        out.append("li a")
    return out if name not in ("html", "body") else []


class Page:
    """A page as a row of tokens: tags (no text) and texts, each with the element around it and its block. Elements have their
    features, the element around them, the one that resets what counts (the outermost main one), and their first and last token."""

    def __init__(self, source: str) -> None:
        self.text: list[str] = []
        self.within: list[int] = []
        self.block: list[int] = []
        self.broken: list[bool] = []  # white space stands for a tag before this text
        self.names, self.features, self.around, self.first, self.last = ["", ], [[]], [0], [0], [0]
        stack, open_, block, mains, gap = [0], Counter(), 0, [], False

        def put(text: str) -> None:
            self.text.append(text)
            self.within.append(stack[-1])
            self.block.append(block)
            self.broken.append(gap)

        def pop() -> None:
            k = stack.pop()
            open_[self.names[k]] -= 1
            self.last[k] = len(self.text)
            if mains and mains[-1] == k:
                mains.pop()

        for m in TOKEN.finditer(source):
            name = m["name"]
            if m["raw"] or (name is None and m["text"] is None):
                continue
            if name is None:
                put(m["text"])
                gap = False
                continue
            name, rest = name.lower(), m["rest"] or ""
            gap |= name in ("br", "td", "th", "img")
            block += name in BLOCK
            if m["close"]:
                if open_[name] > 0:
                    put("")
                    while self.names[stack[-1]] != name:
                        pop()
                    pop()
                continue
            if name in ("p", "li"):
                while self.names[stack[-1]] in PHRASING:
                    pop()
                if self.names[stack[-1]] == name:
                    pop()
            if name in VOID or rest.endswith("/"):
                put("")
                continue
            k = len(self.names)
            self.names.append(name)
            self.features.append(features(name, rest, bool(mains), self.names[stack[-1]]))
            self.around.append(stack[-1])
            self.first.append(len(self.text))
            self.last.append(-1)
            if "main" in self.features[k]:
                mains.append(k)
            stack.append(k)
            open_[name] += 1
            put("")
        while len(stack) > 1:
            pop()
        self.last[0] = len(self.text)
        self.words = np.array([len(x.split()) for x in self.text], np.int64)
        total = np.concatenate([[0], np.cumsum(self.words)])
        self.held = [int(total[e] - total[s]) for s, e in zip(self.first, self.last, strict=True)]  # words in each element
        within = self.inherited(lambda k, above: bool(above) or "main" in self.features[k])
        if int(self.words[[within[k] for k in self.within]].sum() if self.within else 0) * MARKED >= max(1, self.held[0]):
            self.features[0] = ["beside main"]

    def inherited(self, value) -> list:
        """For each element, what value(element, that of the element around it) gives, from the outside in."""
        out: list = [None] * len(self.names)
        for k in range(len(self.names)):
            out[k] = value(k, out[self.around[k]] if k else None)
        return out


def contexts(page: Page) -> Counter:
    """How many words the page has in each context (features of all boxes that count, sorted) and under either label: whether they
    are in the main part and in no box of it that is named as beside."""
    def label(k, above):
        main, beside = above or (False, False)
        if "main" in page.features[k] and not main:
            return True, False
        return main, main and beside or any(before_fit(f) <= -8 for f in page.features[k])

    def box(k, above):
        if "main" in page.features[k] and "main" not in (above or ()):
            return frozenset(page.features[k])
        return (above or frozenset()) | frozenset(page.features[k]) if page.features[k] else above or frozenset()

    labels, boxes, out = page.inherited(label), page.inherited(box), Counter()
    for k, n in zip(page.within, page.words.tolist(), strict=True):
        if n:
            main, beside = labels[k]
            out["\t".join([str(int(main and not beside)), *sorted(boxes[k])])] += n
    return out


class Weights:
    """The logistic model: a weight for each feature and one ("") for all, fitted to counts of contexts; each context is seen with and
    without the mark of a main element, so that pages that mark none are read by all else. Unseen features weigh as before_fit says."""

    def __init__(self, counts: dict[str, int]) -> None:
        rows: Counter = Counter()
        for x, c in counts.items():
            label, *found = x.split("\t")
            rows[(int(label), tuple(found))] += c / 2
            rows[(int(label), tuple(f for f in found if not f.endswith("main")))] += c / 2
        names = {f: i for i, f in enumerate(sorted({"", *(f for (_, found) in rows for f in found)}))}
        start = np.array([before_fit(f) for f in names])
        at = np.array([i for i, (_, found) in enumerate(rows) for _ in ("", *found)], np.int64)
        of = np.array([names[f] for (_, found) in rows for f in ("", *found)], np.int64)
        y, share = np.array([label for label, _ in rows], float), np.array(list(rows.values()), float)
        share /= max(share.sum(), 1)
        w, mean, square = start.copy(), np.zeros(len(names)), np.zeros(len(names))
        for step in range(1, STEPS + 1 if rows else 1):
            off = (y - 1 / (1 + np.exp(-np.bincount(at, w[of], len(rows))))) * share
            up = np.bincount(of, off[at], len(names)) - RIDGE * (w - start)
            mean, square = 0.9 * mean + 0.1 * up, 0.99 * square + 0.01 * up * up
            w += PACE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        self.weight = dict(zip(names, w.tolist(), strict=True))

    def of(self, feature: str) -> float:
        found = self.weight.get(feature)
        return before_fit(feature) if found is None else found


def scores(page: Page, weights: Weights) -> np.ndarray:
    """Of each token: words count 0 to 1 each, a tag costs TAG and up to OUTSIDE more."""
    def logit(k, above):
        if k == 0:
            return weights.of("") + sum(map(weights.of, page.features[0])), False
        value, main = above
        if page.held[k] > page.held[0] * HOLDS and not main and "main" not in page.features[k] and page.names[k] not in ASIDE - {"form"}:
            return above  # what holds nearly all of the page is not beside it
        if "main" in page.features[k] and not main:
            value, main = weights.of(""), True
        return value + sum(map(weights.of, page.features[k])), main

    chance = 1 / (1 + np.exp(-np.clip(np.array([x for x, _ in page.inherited(logit)]), -50, 50)))
    p = chance[np.array(page.within, np.int64)] if page.within else np.zeros(0)
    return np.where(page.words > 0, page.words * np.maximum(0, 2 * p - 1), np.where([not x for x in page.text], -TAG - OUTSIDE * (1 - p), 0))


def best_run(score: np.ndarray) -> tuple[int, int]:
    """The tokens of the contiguous part with the highest sum, by one scan; of equal sums, the first and shortest."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(score.tolist()):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, at = total, (start, k + 1)
    return at


def region(score: np.ndarray, mains: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of the best run, widened to all main elements that the page marks (their first and last tokens), between the places
    where its running sum falls by DIP or more; each next part begins at the lowest sum before it rises by RISE."""
    lo, hi = best_run(score)
    if lo < hi and mains:
        lo, hi = min([lo, *(x for x, _ in mains)]), max([hi, *(x for _, x in mains)])
    out, start, end, top, low, turn, total, falling = [], lo, lo, 0.0, 0.0, lo, 0.0, False
    for k in range(lo, hi):
        total += score[k]
        if falling:
            if total <= low:
                low, turn = total, k + 1
            elif total >= low + RISE:
                falling, start, end, top = False, turn, k + 1, total
        elif total > top:
            top, end = total, k + 1
        elif top - total >= DIP:
            out.append((start, end))
            falling, low, turn = True, total, k + 1
    return out if falling else [*out, (start, end)]


def blocks(page: Page, parts: list[tuple[int, int]]) -> list[str]:
    """The texts of the parts' tokens, one a block: references decoded, white space made one blank."""
    out, last, texts = [], None, []
    for lo, hi in parts:
        for k in range(lo, hi):
            if page.text[k]:
                if page.block[k] != last:
                    out.append(texts)
                    texts, last = [], page.block[k]
                texts += [" " * page.broken[k], page.text[k]]
    joined = [" ".join(html.unescape("".join(x)).split()) for x in [*out, texts]]
    return [x for x in joined if x]


def extract(source: str, weights: Weights) -> str:
    """The page's main text: its best region without what the region's falls leave out."""
    page = Page(source)
    score = scores(page, weights)
    mains = [(s, e) for s, e, found in zip(page.first, page.last, page.features, strict=True) if "main" in found] if page.features[0] else []
    return "\n\n".join(blocks(page, region(score, mains)))


def fit(pages: DataFrame, column: str = "html", most: int = TRAIN_PAGES) -> Weights:
    """Weights from about `most` pages that mark their main part by an element, which is their label: those of the
    least hash, copies once. Tasks count words by context; the driver gets the sums, one a context of the sample."""

    def count(batches):
        sums: Counter = Counter()
        for _, texts in slices(batches, 0):
            for x in texts:
                sums.update(contexts(Page(x)))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["context", "words"])

    sample = hashed_sample(pages.where(F.col(column).rlike("(?i)<(article|main)\\b")), column, most)
    sums = sample.repartition(16).mapInArrow(count, "context string, words long").groupBy("context").agg(F.sum("words").alias("words"))
    return Weights({r["context"]: r["words"] for r in sums.toLocalIterator()})


def extract_pages(pages: DataFrame, column: str = "html", weights: Weights | None = None) -> DataFrame:
    """pages without column, and with text: the main text, empty if there is none.

    Null page: empty. Each row on its own, so repeated rows repeat. No rows: no rows. A column named text is replaced."""
    weights = weights or fit(pages, column)
    rest = [c for c in pages.columns if c not in (column, "text")]

    def run(batches):
        for batch, texts in slices(batches, len(rest)):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array([extract(x, weights) for x in texts], pa.string())], names=[*rest, "text"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in pages.select(*rest).dtypes), "text string"])
    return pages.select(*rest, F.col(column)).mapInArrow(run, schema)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
