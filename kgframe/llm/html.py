"""Main text of web pages: the contiguous region of greatest score.

A page is a row of words and tags. Words score positive, tags negative, with weights learnt from pages that label
their own content (exactly one <article> or <main>): a word's weight depends on the element that holds it, a tag's on
its name and classes. One linear scan finds the region of greatest sum; words in it whose element is marked as
boilerplate are left out. Where content elements (the outermost <article> and <main>) hold words, each of them is
scanned by itself and what lies outside takes no part; content elements inside another belong to it.
"""

from __future__ import annotations

import html as html_entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgframe.llm.common import slices, table

#: Pages that the weights are learnt from, at most.
SAMPLE_PAGES = 2000

# Element names of HTML by the part they play.
HIDDEN = {"script", "style", "head", "title", "noscript", "template", "svg", "iframe", "object", "select", "textarea"}
RAW = {"script", "style", "textarea", "title", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "input", "fieldset"}
CONTENT = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words that name boilerplate where they are a whole class, id or role, but for words of LAYOUT.
NOTES = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "notice", "notices", "popup", "modal", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related", "newsletter", "subscribe", "signup", "login", "search", "widget", "toolbar", "masthead", "complementary", "contentinfo", "alert"}
LAYOUT = {"area", "articles", "bar", "block", "box", "button", "buttons", "container", "form", "group", "icon", "icons", "inner", "item", "items", "link", "links", "list", "outer", "panel", "post", "posts", "section", "site", "slot", "stories", "unit", "wrap", "wrapper"}
#: Those of NOTES that name a part of a page wherever they are in a class, id or role: a soft mark, outside content elements.
PARTS = {"advert", "advertisement", "adverts", "breadcrumb", "breadcrumbs", "contentinfo", "cookie", "cookies", "disqus", "footer", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "popup", "sidebar", "toolbar", "widget"}
#: How sure a mark is. Soft: a form, a part of a name. Named: a whole name. Hard: the element itself, or hidden.
SOFT, NAMED, HARD = 1, 2, 3

#: Headings of reader comments, which mark the section or list that they open.
COMMENT_TITLES = re.compile(r"(?:\d+ )?(?:(?:reader|user|all) )?(?:comments?|responses|kommentare?|leserkommentare|commentaires?|comentarios?|leave a (?:comment|reply))(?: \(?\d+\)?)?\W*")
SECTIONS = {"section", "div", "ul", "ol", "dl"}
#: Elements whose end tag may be left out.
OPEN_ENDED = {"p", "li", "td", "th", "tr", "dt", "dd", "thead", "tbody", "tfoot", "option", "html", "body"}

#: What stepping over marked boilerplate outside a content element costs.
STEP = 4.0

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]{2,}")


def signature(name: str, attributes: str, inside: bool = False, nested: bool = False) -> tuple[str, int]:
    """An element's name with its classes, and how surely name or attributes mark it as boilerplate (0: not at all).

    ``inside`` a content element only whole names count; on content elements themselves names count only if they are
    ``nested`` in another. Ids of headings and paragraphs are made from their text.
    """
    words: list[str] = []
    mark = SOFT if name in ("form", "fieldset") else HARD if name in BOILERPLATE or name in HIDDEN else NAMED if name == "header" and not inside else 0
    for kind, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        kind = kind.lower()
        if kind not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        value = "".join(values).lower()
        if kind == "hidden" or kind == "aria-hidden":
            if kind == "hidden" or value == "true":
                mark = HARD
            continue
        if kind != "id":
            words += value.split()
        elif name == "p" or name in HEADINGS:
            continue
        if name in ("html", "body") or name in CONTENT and not nested:
            continue
        for one in value.split():
            parts = set(_NAME.findall(one))
            if parts.isdisjoint(NOTES):
                continue
            if parts <= NOTES | LAYOUT:
                mark = max(mark, NAMED)
            elif not inside and name != "p" and name not in HEADINGS and not parts.isdisjoint(PARTS):
                mark = max(mark, SOFT)
    return ".".join([name, *words[:3]]), mark


def boilerplate(parents: list[int], marks: list[int], contents: list[str], words: list[int], unclosed: set[int]) -> list[bool]:
    """Of each element (parents come first), whether it lies in boilerplate.

    A mark on an element that is never closed is soft, for what follows it may be anything.

    A mark does not count on what is rather a wrapper of the page: a soft one where a content element or more than half
    of all words is below, a named one where more than half of all words and all articles are (without any, all mains).
    If then no content element outside others is free of marks, these are free of all but hard ones. ``contents`` has
    the names of content elements, ``words`` the counts of words right in an element.
    """
    label = "article" if "article" in contents else "main"
    total, holds, labels = list(words), [False] * len(parents), [c == label for c in contents]
    for e in range(len(parents) - 1, 0, -1):
        total[parents[e]] += total[e]
        holds[parents[e]] |= holds[e] or contents[e] != ""
        labels[parents[e]] += labels[e]
    own = []
    for e, mark in enumerate(marks):
        most = 2 * total[e] > total[0]
        mark = SOFT if mark and e in unclosed else mark
        own.append(0 if mark == SOFT and (holds[e] or most) or mark == NAMED and most and labels[e] == labels[0] > 0 else mark)

    def inherited(free: bool) -> tuple[list[int], bool]:
        sure, inside, clear = [0] * len(parents), [False] * len(parents), False
        for e in range(1, len(parents)):
            up = parents[e]
            outermost = contents[e] != "" and not inside[up]
            sure[e] = max(0 if free and outermost and sure[up] < HARD else sure[up], own[e])
            inside[e] = inside[up] or contents[e] != ""
            clear = clear or outermost and not sure[e] and total[e] > 0
        return sure, clear

    sure, clear = inherited(False)
    return [x > 0 for x in (sure if clear or labels[0] == 0 else inherited(True)[0])]


def pieces(page: str) -> Iterator[tuple[str, str, str, bool, int]]:
    """(kind, text or tag name, signature, boilerplate, inside) in page order; kind: text, inline, open or close.

    Text carries the signature of the element that holds it, whether any element around it is boilerplate, and the
    number of the outermost content element around it (0: none). A header is boilerplate outside content elements. A
    closing tag ends the elements that are open inside its own; one without an open element ends nothing.
    """
    found, parents, marks, contents, words, unclosed = [], [0], [0], [""], [0], set()
    stack: list[tuple[str, str, int, int]] = [("", "", 0, 0)]
    opened: dict[str, int] = {}

    def element(mark: int, content: str = "") -> int:
        parents.append(stack[-1][2])
        marks.append(mark)
        contents.append(content)
        words.append(0)
        return len(parents) - 1

    def leave() -> tuple[str, str, int, int]:
        opened[stack[-1][0]] -= 1
        return stack.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            text = page[at:end]
            if stack[-1][0] in HEADINGS and stack[-2][0] in SECTIONS and COMMENT_TITLES.fullmatch(" ".join(text.lower().split())):
                holder = stack[-2][2]
                marks[holder] = marks[holder] if words[holder] else max(marks[holder], NAMED)
            words[stack[-1][2]] += len(text.split())
            found.append(("text", text, *stack[-1][1:]))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                found.append(("text", m[0][9:].removesuffix("]]>"), stack[-1][1], element(HARD), stack[-1][3]))
            continue
        inline = name in INLINE
        if m[1]:
            if opened.get(name):
                while stack[-1][0] != name:
                    if stack[-1][0] not in OPEN_ENDED:
                        unclosed.add(stack[-1][2])
                    leave()
                _, own, e, inside = leave()
            else:
                own, (e, inside) = name, stack[-1][2:]
            found.append(("inline" if inline else "close", name, own, e, inside))
            continue
        if name == "p" and stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li":
            leave()
        inside = stack[-1][3]
        own, mark = signature(name, m[3], inside > 0 or name in CONTENT, inside > 0)
        e = element(mark, name if name in CONTENT else "")
        if name in CONTENT and not inside:
            inside = e
        found.append(("inline" if inline else "open", name, own, e, inside))
        if name in VOID or m[0].endswith("/>"):
            continue
        if name in RAW:
            close = re.compile(f"</{name}\\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        stack.append((name, stack[-1][1] if inline and not mark else own, e, inside))
        opened[name] = opened.get(name, 0) + 1
    unclosed.update(x[2] for x in stack[1:] if x[0] not in OPEN_ENDED)
    noted = boilerplate(parents, marks, contents, words, unclosed)
    for kind, text, own, e, inside in found:
        yield kind, text, own, noted[e], inside


def counted(page: str) -> dict[tuple[str, str], list[int]]:
    """Of a page that labels its content: for each (word or tag, signature) how many lie outside and inside; else nothing.

    What is marked as boilerplate is left out: it says nothing of the same signature without a mark.
    """
    low = page.lower()
    label = next((t for t in ("article", "main") if low.count(f"<{t}>") + low.count(f"<{t} ") == 1), None)
    found: dict[tuple[str, str], list[int]] = {}
    inside = False
    for kind, text, own, noted, _ in pieces(page) if label else ():
        if kind in ("open", "close") and text == label:
            inside = kind == "open"
            continue
        if kind != "inline" and not noted:
            count = len(text.split()) if kind == "text" else 1
            found.setdefault(("word" if kind == "text" else "tag", own), [0, 0])[inside] += count
    return found


def learn(pages: DataFrame, page_col: str = "html", sample: int = SAMPLE_PAGES, id_col: str = "page_id") -> dict[tuple[str, str], float]:
    """Log odds of content for words in, and tags of, each signature, from at most ``sample`` self-labelled pages.

    The sample are the pages with the least hash of their id, so it is spread over the table. The driver gets counts
    by signature of the sampled pages only.
    """
    least = pages.filter(F.col(id_col).isNotNull()).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    chosen = [r[0] for r in least.collect()]
    if not chosen:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], list[int]] = {}
        for b in batches:
            for page in b.column(0).to_pylist():
                for k, (out, ins) in counted(page or "").items():
                    t = total.setdefault(k, [0, 0])
                    t[0] += out
                    t[1] += ins
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), *(pa.array([v[i] for v in total.values()], pa.int64()) for i in (0, 1))], ["kind", "own", "outside", "inside"]
        )

    rows = pages.filter(F.col(id_col).isin(chosen)).select(page_col).mapInArrow(count, "kind string, own string, outside long, inside long")
    rows = rows.groupBy("kind", "own").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside")).collect()
    return {(r["kind"], r["own"]): math.log((r["inside"] + 0.5) / (r["outside"] + 0.5)) for r in rows}


def weight(weights: dict[tuple[str, str], float], kind: str, own: str) -> float:
    """A word's or tag's score by its signature; unknown signatures fall back to their element."""
    name = own.split(".")[0]
    known = weights.get((kind, own), weights.get((kind, name)))
    if kind == "word":
        return 1.0 if known is None or name in CONTENT else max(-2.0, min(2.0, known))
    return -0.5 if known is None else max(-20.0, min(-0.05, known))


def best_region(scores: list[float]) -> tuple[float, int, int]:
    """The greatest sum of neighbouring scores with the first such region (start, end); zero and an empty one if none is positive."""
    best, span, run, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        run += score
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, span = run, (start, i + 1)
    return best, *span


def scored(found: list[tuple[str, str, str, bool, int]], weights: dict[tuple[str, str], float]) -> list[float]:
    """The score of each piece of a page, or of a content element.

    Text inside a content element that is not marked scores positive and tags cost nothing there, so nothing of it is
    lost; marked boilerplate in it is stepped over for nothing, elsewhere at the cost of a few words.
    """
    scores, before = [], False
    for kind, text, own, noted, inside in found:
        score = 0.0
        if noted:
            score = 0.0 if before or inside else -STEP
        elif kind == "text":
            w = weight(weights, "word", own)
            score = len(text.split()) * (max(1.0, w) if inside else w)
        elif kind != "inline" and not inside:
            score = weight(weights, "tag", own)
        scores.append(score)
        before = noted
    return scores


def main_text(page: str | None, weights: dict[tuple[str, str], float]) -> str:
    """The text of the region of greatest score; empty if nothing scores.

    If outermost content elements hold unmarked words, it is the best region of one of them (the first of equals), else
    of the page. Marked boilerplate in the region is left out, all its other text is kept. Blocks are joined by one
    space, as is white space inside them; character references are decoded once.
    """
    found = list(pieces(page or ""))
    spans: dict[int, list[int]] = {}  # of each content element with words: its first piece and the one after its last
    wordy = {inside for kind, text, _, noted, inside in found if inside and kind == "text" and not noted and not text.isspace()}
    for i, piece in enumerate(found):
        if piece[4] in wordy:
            spans.setdefault(piece[4], [i, i])[1] = i + 1
    best = (0.0, 0, 0)
    for first, last in spans.values() or [(0, len(found))]:
        score, start, end = best_region(scored(found[first:last], weights))
        if score > best[0]:
            best = (score, first + start, first + end)
    out: list[str] = []
    for kind, text, own, noted, _ in found[best[1] : best[2]]:
        if kind == "text":
            if not noted:
                out.append(text)
        elif kind != "inline":
            out.append(" ")
    return " ".join(html_entities.unescape("".join(out)).split())


def extract(pages: DataFrame, id_cols: list[str], page_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE_PAGES) -> DataFrame:
    """``id_cols``, text, n_chars of every row: the main text of the whole page.

    Null and empty pages, and pages without content, give an empty text. Repeated rows are kept, each with its text;
    other columns are left out. Reading is one pass without a shuffle; weights go along as a small table.
    """
    weights = learn(pages, page_col, sample, id_col)
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, page_col):
            texts = [main_text(p, weights) for p in b.column(page_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in id_cols), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*id_cols, "text", "n_chars"])

    return pages.select(*id_cols, page_col).mapInArrow(run, f"{fields}, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
