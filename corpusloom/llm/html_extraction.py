"""Main text of web pages by wrapper induction over pages of one host.

Pages are taken in groups of one host. A host under 2 * `group_pages` pages is one group; the pages of a larger one are
dealt by a hash of the row into 2^k groups of `group_pages` to twice as many on average, none under `least_pages`. Groups
follow from the host's pages alone, not from partitions, and are shuffled whole, so that a host with a third of all
pages is spread over many tasks. In a group each page becomes a tree of all its block elements: menus, footers,
adverts and forms stand in it like any other block; only what is never text (scripts, styles, form controls, the
head) is left out. For the alignment a run of like siblings without blocks of their own is one repeated slot, as articles
have unlike numbers of paragraphs; what is template is told for each member of a run by itself. The tree with most blocks is
the wrapper's frame, and every other page is aligned with it by simple tree matching, exact at every size and depth.

The aligned slots decide. A text that k of the n pages which have a slot show in it is template where the posterior odds
say so (odds() below): by chance one page in ten repeats a text, in an article three in ten, while a template shows on
any share of pages alike. This is one criterion for all numbers of pages; what it asks falls from both of two pages to a quarter
of fifty. By the same odds a slot in which most showings repeat shows a few longer texts in turn, such as adverts, and these are
template. In an article or main element template texts go only where they are the lesser part. Pages that share four fifths of
their text (300 characters at least) count once, as copies of an article say nothing about the template.

Element, role and class names (nav, footer, form, "sidebar", "comments") only settle slots that vary, such as a
rotating advert or reader comments: a subtree so marked goes, but not one that holds an article or main element, nor
one without which hardly any varying text would be left on the page. Where the articles (or mains) of a page hold
enough of the text that is left, they are the content and the rest goes: half of it on a host of many pages, less on one
of few, as varying text outside is told from template the better the more pages there are. Elsewhere all that varies and isn't
marked is content. A page that has nothing in common with the frame or is all template is read as if it were alone.

Character references are decoded, white space in a block becomes one space, blocks are joined by a line end in page
order. Nothing is cut. Null pages and pages without text give an empty text. Rows without a URL form a host of their
own. Repeated rows are pages of their own with the same text. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common

RESULT = "page_id long, url string, text string, n_chars long"

#: Element names and class words of the public HTML vocabulary and of common page layouts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title xmp iframe svg".split())
TEXT_LEVEL = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Never text.
DROPPED = set("button select option object canvas audio video head".split()) | RAW
NOISE = set("nav footer aside form menu dialog".split())
NOISE_WORDS = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer menu modal nav navbar navigation newsletter notice popup promo promoted related share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alert form".split())
COMMENT_WORDS = set("comment comments disqus".split())
KEEPERS = {"article", "main"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
HEAD_CONTENT = set("head title meta link base script style noscript template".split())
#: Elements that a starting tag ends, up to a boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    __slots__ = ("children", "mark", "parts", "tag")

    def __init__(self, tag: str, mark: int = 0):
        self.tag, self.parts, self.children, self.mark = tag, [], [], mark


def mark_of(tag: str, attributes: str, in_article: bool) -> int:
    """What the names say of an element: 0 nothing, 1 noise, 2 reader comments."""
    found = int(tag in NOISE or (tag == "header" and not in_article))
    if attributes and tag not in KEEPERS and tag != "body":
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in NOISE_ROLES):
                found = max(found, 1)
            if name in ("class", "id"):
                words = set(re.split(r"[^a-z0-9]+", value))
                found = max(found, 2 if words & COMMENT_WORDS else int(bool(words & NOISE_WORDS)))
    return found


def parse(page: str) -> Node:
    """The tree of block elements; parts holds text and child blocks in page order."""
    root = Node("html")
    stack: list[tuple[str, Node | None]] = [("html", root)]
    at, silent, articles = 0, 0, 0  # silent: open elements that aren't read

    def leave(depth: int) -> None:
        nonlocal silent, articles
        while len(stack) > depth:
            tag, node = stack.pop()
            silent -= tag.endswith("!")
            articles -= tag in KEEPERS

    def near(wanted: set[str], boundary: set[str]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k][0].rstrip("!")
            if tag in wanted:
                return k
            if tag in boundary:
                return 0
        return 0

    while True:
        m = TOKEN.search(page, at)
        if not silent and (text := page[at : m.start() if m else len(page)]):
            node = next(n for _, n in reversed(stack) if n is not None)
            node.parts.append(text)
        if not m:
            return root
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[1]
        if closing:
            if depth := near({tag}, {"td", "th"} if tag in TEXT_LEVEL else set()):
                leave(depth)
            continue
        if tag not in HEAD_CONTENT and (depth := near({"head"}, set())):  # a head that isn't closed ends with the first content
            leave(depth)
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if not silent:
                node = next(n for _, n in reversed(stack) if n is not None)
                if tag == "br":
                    node.parts.append(" ")
                elif tag == "hr":
                    node.parts.append(Node("hr"))
            continue
        if tag in TEXT_LEVEL:
            if mark_of(tag, m[3], articles > 0):
                silent += 1
                stack.append((tag + "!", None))
            else:
                stack.append((tag, None))
            continue
        if tag in CLOSES:
            if depth := near(*CLOSES[tag]):
                leave(depth)
        elif depth := near({"p"}, {"td", "th", "table", "button", "object"}):
            leave(depth)
        if tag in DROPPED:
            silent += 1
            stack.append((tag + "!", None))
            continue
        if tag in ("html", "body"):
            continue
        for k, (name, node) in enumerate(stack):  # a text-level element around blocks is no remark in a line
            if node is None and name.endswith("!") and name[:-1] in TEXT_LEVEL:
                stack[k] = (name[:-1], None)
                silent -= 1
        if silent:
            stack.append((tag, None))
        else:
            node = Node(tag, mark_of(tag, m[3], articles > 0))
            parent = next(n for _, n in reversed(stack) if n is not None)
            parent.parts.append(node)
            parent.children.append(node)
            stack.append((tag, node))
        articles += tag in KEEPERS


def blocks(node: Node, silent: set[int] = frozenset()) -> list[str]:
    """Texts of the blocks below node, in page order, without the text that stands directly in silent ones."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    work: list = [node]
    while work:
        item = work.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        else:
            flush()
            work.append(None)
            work.extend(reversed(item.children if id(item) in silent else item.parts))
    flush()
    return out


class Slot:
    """A node of an alignment tree: a block, or a run of like blocks without children."""

    __slots__ = ("children", "nodes", "shape", "size", "tag", "texts")

    def __init__(self, nodes: list[Node], children: list[Slot]):
        self.tag, self.nodes, self.children = nodes[0].tag, nodes, children
        self.size = 1 + sum(c.size for c in children)
        #: the tags of the tree, as a digest; a tag has no space
        self.shape = hashlib.md5(b" ".join((self.tag.encode("utf-8", "surrogatepass"), *(c.shape for c in children))), usedforsecurity=False).digest()
        self.texts = [" ".join("".join(p for p in n.parts if isinstance(p, str)).split()) for n in nodes]


def slots(node: Node) -> Slot:
    """The alignment tree below a node, built without recursion."""
    done: dict[int, Slot] = {}
    work = [(node, False)]
    while work:
        n, ready = work.pop()
        if not ready:
            work.append((n, True))
            work.extend((c, False) for c in n.children)
            continue
        children: list[Slot] = []
        run: list[Node] = []
        for c in [*n.children, None]:
            if run and (c is None or c.children or c.tag != run[0].tag):
                children.append(Slot(run, []))
                run = []
            if c is not None:
                if c.children:
                    children.append(done[id(c)])
                else:
                    run.append(c)
        done[id(n)] = Slot([n], children)
    return done[id(node)]


def ends(rows: list[Slot], columns: list[Slot]) -> tuple[int, int]:
    """Lengths of the common start and the common end of two lists: some largest match pairs them one to one."""
    short = min(len(rows), len(columns))
    start = next((k for k in range(short) if rows[k].shape != columns[k].shape), short)
    return start, next((k for k in range(short - start) if rows[-1 - k].shape != columns[-1 - k].shape), short - start)


def easy(a: Slot, b: Slot) -> int | None:
    """The score of two trees where it takes no search."""
    if a.tag != b.tag:
        return 0
    if a.shape == b.shape:
        return a.size
    return None if a.children and b.children else 1


class Table:
    """Best scores of matching the first i rows with the first j columns; every so many lines are held, others made again."""

    def __init__(self, rows: list[Slot], columns: list[Slot], known: dict):
        self.columns, self.rows, self.known = columns, rows, known
        kinds = {c.shape: c for c in columns}
        self.kinds, number = list(kinds.values()), {k: i for i, k in enumerate(kinds)}
        self.kind = np.array([number[c.shape] for c in columns])
        self.step = math.isqrt(len(rows)) + 1
        self.held = [np.zeros(len(columns) + 1, np.int64)]
        line, self.weights = self.held[0], {}
        for i in range(len(rows)):
            line = self.after(line, i)
            if (i + 1) % self.step == 0:
                self.held.append(line)
        self.score = int(line[-1])

    def weight(self, i: int) -> np.ndarray:
        """Scores of row i with every column."""
        x = self.rows[i]
        if x.shape not in self.weights:
            values = ((easy(x, y), y) for y in self.kinds)
            self.weights[x.shape] = np.array([self.known[x.shape, y.shape] if v is None else v for v, y in values], np.int64)
        return self.weights[x.shape][self.kind]

    def after(self, line: np.ndarray, i: int) -> np.ndarray:
        out = line.copy()
        np.maximum(out[1:], line[:-1] + self.weight(i), out=out[1:])
        return np.maximum.accumulate(out)

    def pairs(self) -> list[tuple[Slot, Slot]]:
        out, j = [], len(self.columns)
        for k in range(len(self.held) - 1, -1, -1):
            low, lines = k * self.step, [self.held[k]]
            for i in range(low, min(low + self.step, len(self.rows))):
                lines.append(self.after(lines[-1], i))
            i = len(lines) - 1
            while i and j:
                w = int(self.weight(low + i - 1)[j - 1])
                if w and lines[i][j] == lines[i - 1][j - 1] + w:
                    i, j = i - 1, j - 1
                    out.append((self.rows[low + i], self.columns[j]))
                elif lines[i][j] == lines[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return out


def match(a: Slot, b: Slot, known: dict | None = None) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the largest order-preserving match of two trees, and its pairs, at every size and depth.

    known holds scores by shape, as equal shapes score alike; it can be used again for other trees.
    """
    if a.tag != b.tag:
        return 0, []
    known = {} if known is None else known
    if len(known) > 1_000_000:
        known.clear()
    work = [(a, b)]
    while work:  # scores, those of children first
        x, y = work[-1]
        if easy(x, y) is not None or (x.shape, y.shape) in known:
            work.pop()
            continue
        start, end = ends(x.children, y.children)
        rows, columns = x.children[start : len(x.children) - end], y.children[start : len(y.children) - end]
        own, other = {r.shape: r for r in rows if r.children}, {c.shape: c for c in columns if c.children}
        missing = [(r, c) for r in own.values() for c in other.values() if easy(r, c) is None and (r.shape, c.shape) not in known]
        if missing:
            work += missing
            continue
        score = 1 + sum(r.size for r in x.children[:start]) + sum(r.size for r in x.children[len(x.children) - end :])
        known[x.shape, y.shape] = score + (Table(rows, columns, known).score if rows and columns else 0)
        work.pop()
    score = easy(a, b)
    pairs, work = [], [(a, b)]
    while work:
        x, y = work.pop()
        pairs.append((x, y))
        start, end = ends(x.children, y.children)
        rows, columns = x.children[start : len(x.children) - end], y.children[start : len(y.children) - end]
        work += zip(x.children[:start], y.children[:start])
        work += zip(x.children[len(x.children) - end :], y.children[len(y.children) - end :])
        if rows and columns:
            work += Table(rows, columns, known).pairs()
    return known[a.shape, b.shape] if score is None else score, pairs


def own_text(node: Node) -> str:
    """The text that stands directly in a node."""
    return " ".join(html.unescape(" ".join(p for p in node.parts if isinstance(p, str))).split())


def below(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    out, work = [], [root]
    while work:
        n = work.pop()
        out.append(n)
        work.extend(reversed(n.children))
    return out


def marked(root: Node, template: set[int]) -> set[int]:
    """The nodes below marked subtrees that go: those without articles whose loss leaves varying text on the page."""
    order = below(root)
    text, plain, holds = {}, {}, {}  # characters of varying text, those under no mark, and whether there is an article
    under = {id(root): False}
    for n in order:
        for c in n.children:
            under[id(c)] = under[id(n)] or c.mark > 0
    for n in reversed(order):
        own = 0 if id(n) in template else len(own_text(n))
        text[id(n)] = own + sum(text[id(c)] for c in n.children)
        plain[id(n)] = (0 if under[id(n)] or n.tag in HEADINGS else own) + sum(plain[id(c)] for c in n.children)
        holds[id(n)] = n.tag in KEEPERS and text[id(n)] > 0 or any(holds[id(c)] for c in n.children)
    out, work = set(), [root]
    whole, rest = text[id(root)], plain[id(root)]
    while work:
        n = work.pop()
        for c in n.children:
            least = 0 if c.mark == 2 else 0.1 * whole
            if c.mark and not holds[id(c)] and (rest > least or text[id(c)] <= 0.5 * whole or holds[id(root)]):
                out.update(map(id, below(c)))
            else:
                work.append(c)
    return out


def articles(root: Node, silent: set[int]) -> list[Node]:
    """The outermost article and main elements in page order."""
    work, found = [root], []
    while work:
        n = work.pop()
        if n.tag in KEEPERS and id(n) not in silent:
            found.append(n)
        else:
            work.extend(reversed(n.children))
    return found


def content(root: Node, template: set[int], pages: int) -> list[str]:
    """The text of a page whose template nodes are known from so many pages; one page alone keeps to its articles if it has any."""
    gone = template | marked(root, template)
    own = articles(root, gone)
    size = lambda n: sum(len(own_text(x)) for x in below(n) if id(x) not in gone)
    inside = sum(map(size, own))
    if inside and inside >= 0.5 * (1 - 1 / pages) * size(root):
        return [x for n in own for x in blocks(n, gone)]
    return blocks(root, gone)


def odds(k: int, n: int, chance: float, prior: float = 0.2) -> float:
    """Log of the posterior odds of a template, of which any number of n pages shows a text alike, against content, of which each
    page repeats a text by `chance` at most, when k do."""
    chance = min(chance, k / n)
    if not 0 < chance < 1:
        return -math.inf
    ways = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    return math.log(prior) - math.log(n + 1) - ways - k * math.log(chance) - (n - k) * math.log1p(-chance)


def families(texts: list[dict[str, int]], share: float = 0.8, least: int = 300) -> list[int]:
    """A number for each page, equal for pages that have at least `share` of their characters in common: copies of an article.

    A template is short beside an article, so that fewer than `least` common characters are no sign of a copy.
    """
    number: list[int] = []
    for i, own in enumerate(texts):
        size, same = sum(own.values()), i
        for j in range(i):
            if number[j] == j:
                small, large = (own, texts[j]) if len(own) < len(texts[j]) else (texts[j], own)
                both = sum(n for t, n in small.items() if t in large)
                if both >= max(least, share * max(size, sum(texts[j].values()))):
                    same = j
                    break
        number.append(same)
    return number


def inside(frame: Slot) -> set[int]:
    """Slots at or below an article or main element."""
    out, work = set(), [(frame, False)]
    while work:
        s, kept = work.pop()
        kept = kept or s.tag in KEEPERS
        if kept:
            out.add(id(s))
        work.extend((c, kept) for c in s.children)
    return out


def template_texts(frame: Slot, aligned: list[dict[int, Slot]], family: list[int]) -> dict[int, dict[str, bool]]:
    """For each slot of the frame its template texts; True where it is in an article."""
    kept, out, work = inside(frame), {}, [frame]
    while work:
        s = work.pop()
        work.extend(s.children)
        seen: dict[str, set[int]] = {}
        pages: set[int] = set()
        for f, pairs in zip(family, aligned, strict=True):
            if id(s) in pairs:
                pages.add(f)
                for text in pairs[id(s)].texts:
                    if text:
                        seen.setdefault(text, set()).add(f)
        in_article, n = id(s) in kept, len(pages)
        shared = {t: len(own) for t, own in seen.items() if len(own) > 1}
        found = {t: in_article for t, k in shared.items() if odds(k, n, 0.3 if in_article else 0.1) >= 0}
        if shared and not in_article:
            shown = sum(map(len, seen.values()))
            if odds(shown - len(seen), shown, 0.1) >= 0:  # a few texts in turn
                found |= {t: False for t in shared if t.count(" ") >= 4}
        if found:
            out[id(s)] = found
    return out


def extract_group(pages: list[str | None]) -> list[str]:
    """The main text of each page of one host."""
    numbers: dict[str, int] = {}
    for p in pages:  # copies of a page say nothing about the template
        if p:
            numbers.setdefault(p, len(numbers))
    roots = [parse(p) for p in numbers]
    trees = [slots(r) for r in roots]
    frame = max(trees, key=lambda t: t.size, default=None)  # of equal ones the first
    known: dict = {}
    aligned = [{id(f): own for f, own in match(frame, t, known)[1]} for t in trees]
    family = families([{t: len(t) for n in below(r) if id(n) not in gone and (t := own_text(n))} for r, gone in ((r, marked(r, set())) for r in roots)])
    n = len(set(family))
    constant = template_texts(frame, aligned, family) if n > 1 else {}
    texts = []
    for root, tree, pairs in zip(roots, trees, aligned, strict=True):
        template, weak = set(), set()
        for f, found in constant.items():
            if f in pairs:
                for node, text in zip(pairs[f].nodes, pairs[f].texts, strict=True):
                    if text in found:
                        (weak if found[text] else template).add(id(node))
        if weak:
            size = {k: sum(len(own_text(x)) for x in below(root) if (id(x) in weak) == k) for k in (True, False)}
            template |= weak if size[True] < size[False] else set()
        matched = n > 1 and (len(pairs) > 1 or not frame.children or not tree.children)
        texts.append("\n".join((content(root, template, n) if matched else []) or content(root, set(), 1)))
    return [texts[numbers[p]] if p else "" for p in pages]


def cells(rows: DataFrame, group_pages: int, least_pages: int) -> DataFrame:
    """(large, levels) of the hosts whose pages are dealt into 2^levels groups, by the low bits of place.

    Groups have group_pages to 2 * group_pages pages on average, and none has under least_pages: levels is the largest
    number at which this holds. A host that isn't listed is one group.
    """
    pages = rows.select("host", "place").distinct()  # repeated rows lie in one group and count once
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2 * group_pages)
    sizes = sizes.select(F.col("host").alias("large"), F.floor(F.log2(F.col("n") / group_pages)).cast("int").alias("most"))
    found = pages.join(sizes, F.col("host") == F.col("large")).groupBy("large", "most", F.expr("place & (shiftleft(1L, most) - 1)").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    found = found.withColumn("levels", F.explode(F.sequence(F.lit(1), F.col("most"))))
    found = found.groupBy("large", "levels", F.expr("cell & (shiftleft(1L, levels) - 1)").alias("cell")).agg(F.sum("n").alias("n"))
    found = found.groupBy("large", "levels").agg(F.count(F.lit(1)).alias("cells"), F.min("n").alias("n"))
    return found.filter((F.col("n") >= least_pages) & (F.col("cells") == F.expr("shiftleft(1L, levels)"))).groupBy("large").agg(F.max("levels").alias("levels"))


def whole_groups(batches):
    """Lists of (page_id, url, html) of one host and cell, from batches sorted by host and cell."""
    key, held, sources = None, [], {}
    for batch in batches:
        for host, cell, page_id, url, source in zip(*(batch.column(c).to_pylist() for c in ("host", "cell", "page_id", "url", "html")), strict=True):
            if (host, cell) != key:
                if held:
                    yield held
                key, held, sources = (host, cell), [], {}
            held.append((page_id, url, sources.setdefault(source, source)))  # copies are held once
    if held:
        yield held


def extract(pages: DataFrame, *, group_pages: int = 48, least_pages: int = 3, partition_pages: int = 2000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    common.ship(pages.sparkSession)
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    rows = rows.withColumn("place", F.xxhash64("page_id", "url", "html"))

    def run(batches):
        for group in whole_groups(batches):
            ids, urls, sources = zip(*group, strict=True)
            texts = extract_group(list(sources))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    # one row for 2 * group_pages pages at most: while few they are broadcast, so that the pages are shuffled once
    large = common.stored(cells(rows, group_pages, least_pages).withColumnRenamed("large", "host"))
    dealt = common.small_join(rows, large, "host", 64, "place", "left").withColumn("cell", F.expr("place & (shiftleft(1L, coalesce(levels, 0)) - 1)"))
    dealt = dealt.repartition(common.split_count(rows, partition_pages), "host", "cell").sortWithinPartitions("host", "cell", "place", "page_id", "url")
    return dealt.select("host", "cell", "page_id", "url", "html").mapInArrow(run, RESULT)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(common.table(spark, sf_dir, "pages"))
