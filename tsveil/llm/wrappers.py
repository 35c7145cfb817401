"""Operator 8, main text of web pages by wrapper induction.

Pages of one host share a template. Each host has EXEMPLARS example pages of different content (those of least hash, so
any run picks the same). A page's tree is aligned with each of them by simple tree matching (Yang 1991): two nodes of
one tag match, and their children are matched in order so that most nodes match. A text whose partner is the same text
in every aligned example is template; one whose partner varies, or that has none, is a slot. A block all of whose texts
are template is dropped; a block with a slot is content. An example that has most of the page's text is the same
article again and isn't asked.

Examples are few, so all pages of a host are counted too. Pages of one frame (the paths and names of their containers
outside page furniture and articles) share a template, of which a host may have many. A text at one path on at least
SHARE of a frame's different pages is template, also where the examples don't show it, if as many pages as examples with
their page would be have it beside different longest blocks (copies of one article share theirs), or if over half of
FRAME_PAGES or more pages have it, however much of them it is.

Slots that aren't the article also vary (adverts, menus). Alignment can't tell these, so nodes that their tag, class or
role (of containers outside an article also the id) names as page furniture are never content, and a page that marks its
article gives only what is inside. Inside a marked article a text is template only if ARTICLE_EXAMPLES examples or more
agree. Examples of a page's own frame are asked first; those of other frames only where there are too few.

Pages are parsed once to count and once to extract; what is counted of a text is 64-bit hashes, added up map-side. A
host's pages are dealt to lanes of about LANE_ROWS pages and streamed behind the host's examples and template texts, so a task
never holds a host.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsveil.llm.base import Workspace, map_batches, small

EXEMPLARS = 4
ARTICLE_EXAMPLES = 3
#: Examples that must agree outside a marked article.
LEAST_EXAMPLES = 2
LANE_ROWS = 512
#: Shares of a page's text beyond which an example is taken for the same article: without and with a marked article.
SAME_ARTICLE = (0.9, 0.5)
#: Least share of a frame's pages with a template text; pages of a frame from which a majority alone decides.
SHARE, FRAME_PAGES = 0.1, 8
#: Elements that make a page's frame.
CONTAINERS = set("html body div section main header article table form ul ol dl".split())

#: HTML, fixed values: elements without content, with raw content, and that end an open paragraph; which element ends which.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_ITSELF = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "thead": {"tr", "td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
#: How far up an element looks for one that it ends.
LIMITS = set("ul ol dl table div article section main body html aside nav header footer form td th select".split())
#: Page furniture by tag, and by words of class, id and role.
FURNITURE = set(
    "nav footer aside form script style noscript template iframe button select textarea input svg head dialog menu object canvas audio video fieldset".split()
)
FURNITURE_NAMES = set(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu header masthead footer sidebar aside complementary "
    "contentinfo cookie cookies consent gdpr notice notification alert popup modal overlay comment comments disqus respond reply replies share sharing social related recommended breadcrumb "
    "breadcrumbs pagination pager newsletter subscribe subscription signup login search toolbar widget skip".split()
)
#: Elements whose names speak of the whole page.
WHOLE = {"html", "body", "main"}
#: Containers that an id names; ids of headings and, in articles, of sections come from their titles.
ID_NAMES = set("div section ul ol dl table header".split())
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""",
    re.S,
)


class Node:
    __slots__ = ("kids", "name", "noise", "shape", "size", "tag", "text")

    def __init__(self, tag: str, text: str = "", noise: bool = False):
        self.tag, self.text, self.noise, self.kids = tag, text, noise, []
        self.shape = self.size = 0
        self.name = ""


def attributes_of(tag: str) -> dict[str, str]:
    """The attributes of a tag's inside, names in lower case, values decoded; of a name given twice the first counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(tag):
        out.setdefault(name.lower(), entities.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def furniture(tag: str, given: dict[str, str], in_article: bool) -> bool:
    """Whether an element is hidden, or named as page furniture by its attributes."""
    if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or NO_DISPLAY.search(given.get("style", "")):
        return True
    names = [given.get("class", ""), given.get("role", ""), given.get("id", "") if tag in ID_NAMES and not in_article else ""]
    words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(names)).lower())
    return not FURNITURE_NAMES.isdisjoint(words)


def parse(page: str) -> Node:
    """The tree of a page: elements and texts (tag "#"), with references decoded; comments and raw content left out."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)

    def close_to(tags: set[str], limits: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in limits:
                return

    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            text = " ".join(entities.unescape(page[at:end]).split())
            raw = page[at:end]
            if text:
                lead, trail = raw[0].isspace(), raw[-1].isspace()
                stack[-1].kids.append(Node("#", f"{' ' * lead}{text}{' ' * trail}"))
            elif raw:
                stack[-1].kids.append(Node("#", " "))
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, attributes = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "body", "main") and tag not in ("html", "body"):
                    if not any(x.tag == tag for x in stack[:i]) or tag in ("p", "b", "i", "a", "span", "li"):
                        break
            continue
        if tag in BLOCKS:
            close_to({"p"}, LIMITS)
        if tag in ENDS_ITSELF:
            close_to(ENDS_ITSELF[tag], {"ul", "ol", "dl", "table", "select"} - {tag})
        node = Node(tag, noise=tag in FURNITURE)
        if attributes and tag not in WHOLE:
            given = attributes_of(attributes)
            node.noise = node.noise or furniture(tag, given, any(x.tag == "article" for x in stack))
            if tag in CONTAINERS:
                named = " ".join(given.get(k, "") for k in ("class", "id", "role"))
                node.name = " ".join(x for x in named.split() if not any(map(str.isdigit, x)))
        stack[-1].kids.append(node)
        if tag in RAW:
            done = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", done.start()) + 1 if done else n
            at = at or n
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    return root


class Shapes:
    """A number for each shape of tree (tags only), and memoised simple tree matching between shapes."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.matched: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def mark(self, root: Node) -> None:
        order, todo = [], [root]
        while todo:
            x = todo.pop()
            order.append(x)
            todo += x.kids
        for x in reversed(order):
            x.size = 1 + sum(k.size for k in x.kids)
            x.shape = self.numbers.setdefault((x.tag, *(k.shape for k in x.kids)), len(self.numbers))

    def weight(self, a: Node, b: Node) -> int:
        """Most nodes that match, of trees with these roots; 0 if the roots' tags differ."""
        if a.shape == b.shape:
            return a.size
        return self.match(a, b)[0] if a.tag == b.tag else 0

    def match(self, a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
        """(weight, pairs of child places) of two nodes of one tag but different shapes."""
        key = a.shape, b.shape
        if key in self.matched:
            return self.matched[key]
        x, y, lo = a.kids, b.kids, 0
        m, n = len(x), len(y)
        pairs, total = [], 1
        # children of equal shape at either end match in a best solution
        while lo < min(m, n) and x[lo].shape == y[lo].shape:
            pairs.append((lo, lo))
            total += x[lo].size
            lo += 1
        while m > lo and n > lo and x[m - 1].shape == y[n - 1].shape:
            m, n = m - 1, n - 1
            pairs.append((m, n))
            total += x[m].size
        best = [[0] * (n - lo + 1)]
        step: list[list[int]] = []
        for i in range(lo, m):
            row, above, ways = [0], best[-1], []
            for j in range(lo, n):
                w = self.weight(x[i], y[j]) if x[i].tag == y[j].tag else 0
                diagonal, up, left = above[j - lo] + w, above[j - lo + 1], row[-1]
                if w and diagonal >= up and diagonal >= left:
                    row.append(diagonal)
                    ways.append(0)
                elif up >= left:
                    row.append(up)
                    ways.append(1)
                else:
                    row.append(left)
                    ways.append(2)
            best.append(row)
            step.append(ways)
        total += best[-1][-1]
        i, j = m - lo, n - lo
        while i and j:
            way = step[i - 1][j - 1]
            if way == 0:
                i, j = i - 1, j - 1
                pairs.append((lo + i, lo + j))
            elif way == 1:
                i -= 1
            else:
                j -= 1
        if len(self.matched) > 200_000:
            self.matched.clear()
        self.matched[key] = total, pairs
        return self.matched[key]

    def constant(self, a: Node, b: Node) -> set[int]:
        """The ids of a's text nodes whose partner in b is the same text."""
        out, todo = set(), [(a, b)]
        while todo:
            x, y = todo.pop()
            if x.tag == "#":
                if x.text == y.text:
                    out.add(id(x))
            elif x.shape == y.shape:
                todo += zip(x.kids, y.kids, strict=True)
            elif x.tag == y.tag:
                todo += [(x.kids[i], y.kids[j]) for i, j in self.match(x, y)[1]]
        return out


def holds_article(root: Node) -> set[int]:
    """The ids of the nodes that are, or hold, an article or main element outside page furniture by tag."""
    out: set[int] = set()
    todo: list[tuple[Node, tuple]] = [(root, ())]
    while todo:
        x, above = todo.pop()
        if x.tag in ("article", "main") and not x.noise:
            out.add(id(x))
            while above:
                out.add(id(above[0]))
                above = above[1]
        elif x.tag not in FURNITURE:
            todo += [(k, (x, above)) for k in x.kids if k.kids]
    return out


def content_blocks(root: Node) -> tuple[list[list[Node]], bool]:
    """(text nodes of each block outside page furniture, in page order; whether the page marks its article, outside of which nothing counts)."""
    marked = holds_article(root)
    out: list[list[Node]] = []
    texts: list[Node] = []

    def flush() -> None:
        nonlocal texts
        if texts:
            out.append(texts)
            texts = []

    # (node, inside a marked article); None ends a block
    todo: list[tuple[Node, bool] | None] = [(root, not marked)]
    while todo:
        now = todo.pop()
        if now is None:
            flush()
            continue
        x, inside = now
        if x.tag == "#":
            if inside:
                texts.append(x)
            continue
        if (x.noise and id(x) not in marked) or x.tag in FURNITURE or (x.tag == "header" and not (marked and inside)):
            continue
        if x.tag == "br":
            texts.append(BREAK)
            continue
        if x.tag in BLOCKS:
            flush()
            todo.append(None)
        inside = inside or x.tag in ("article", "main") and id(x) in marked
        todo += [(k, inside) for k in reversed(x.kids)]
    flush()
    return out, bool(marked)


BREAK = Node("#", " ")


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def frame_of(root: Node, blocks: list[list[Node]]) -> tuple[int, dict[int, int]]:
    """(the page's frame; path and text of each text of these blocks, by its id), as hashes."""
    wanted = {id(t) for block in blocks for t in block if not t.text.isspace()}
    containers, found = set(), {}
    todo = [(root, "", "")]
    while todo:
        x, path, frame = todo.pop()
        if x.tag == "#":
            if id(x) in wanted:
                found[id(x)] = hash64(f"{path}\0{' '.join(x.text.split())}")
            continue
        path = f"{path}/{x.tag}"
        if frame is not None and x.tag in CONTAINERS and not x.noise:
            frame = f"{frame}/{x.tag} {x.name}"
            containers.add(frame)
        if x.tag == "article" or x.noise:
            frame = None
        todo += [(k, path, frame) for k in x.kids]
    return hash64("\0".join(sorted(containers))), found


def evidence(page: str) -> tuple[int, int, int, int, set[int]]:
    """(frame, least pages that must agree, text of the longest block, all text, texts with their paths) of a page, as hashes."""
    root = parse(page)
    blocks, marked = content_blocks(root)
    frame, found = frame_of(root, blocks)
    texts = ["".join(t.text for t in block if id(t) in found) for block in blocks]
    return frame, 1 + (ARTICLE_EXAMPLES if marked else LEAST_EXAMPLES), hash64(max(texts, key=len, default="")), hash64("\0".join(texts)), set(found.values())


#: The text that stands for a page itself.
PAGE = 0
#: Bits of the longest blocks' hashes that number a place in a bitmap of 64: as many texts differ as a bitmap has places.
BITMAPS = (0, 6, 12, 18)


def template_texts(pages: DataFrame) -> DataFrame:
    """(host, frame, texts: hashes of path and text) of the texts that all of a host's pages (host, html) show to be template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                (host, frame, least, lead, body, t) for host, page in zip(
                    *(c.to_pylist() for c in b.columns),
                    strict=True,
                ) if page for frame, least, lead, body, texts in [evidence(page)] for t in (PAGE, *texts)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, [pa.string(), *[pa.int64()] * 5], strict=True)],
                names=["host", "frame", "least", "lead", "body", "t"],
            )

    rows = map_batches(pages.select("host", "html"), run, "host string, frame long, least long, lead long, body long, t long").distinct()
    maps = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(lead, {b}) & 63 as int))")).alias(f"map{b}") for b in BITMAPS]
    counted = rows.groupBy("host", "frame", "least", "t").agg(F.count("*").alias("n"), *maps).where(F.col("n") >= F.col("least"))
    counted = counted.select("host", "frame", "least", "t", "n", F.greatest(*(F.bit_count(f"map{b}") for b in BITMAPS)).alias("leads"))
    # a frame's pages and its texts meet in one aggregate
    of_frame = counted.groupBy("host", "frame", "least").agg(
        F.max(F.when(F.col("t") == PAGE, F.col("n"))).alias("pages"),
        F.collect_list(F.when(F.col("t") != PAGE, F.struct("t", "n", "leads"))).alias("all"),
    )
    kept = "transform(filter(all, x -> (x.leads >= least and x.n >= {s} * pages) or (pages >= {p} and 2 * x.n > pages)), x -> x.t)".format(s=SHARE, p=FRAME_PAGES)
    return of_frame.select("host", "frame", F.expr(kept).alias("texts")).where(F.size("texts") > 0)


class Wrapper:
    """A host's example pages, parsed, with the shapes that they and the host's pages share."""

    def __init__(self, shapes: Shapes, examples: list[str], template: dict[int, set[int]] | None = None):
        self.template = template or {}
        self.shapes, self.sources, self.examples = shapes, examples, [parse(e) for e in examples]
        for e in self.examples:
            shapes.mark(e)
        self.frames = [frame_of(e, content_blocks(e)[0])[0] for e in self.examples]

    def extract(self, page: str | None) -> str:
        """The page's main text; an example that is the page itself doesn't count."""
        if not page:
            return ""
        root = parse(page)
        self.shapes.mark(root)
        blocks, marked = content_blocks(root)
        sizes = {id(t): len(t.text) for block in blocks for t in block if not t.text.isspace()}
        agreed: dict[int, int] = {}
        used, whole = 0, sum(sizes.values())
        frame, found = frame_of(root, blocks)
        least = ARTICLE_EXAMPLES if marked else LEAST_EXAMPLES
        asked = [k for k, f in enumerate(self.frames) if f == frame]
        for k in asked if len(asked) >= least else range(len(self.examples)):
            same = self.shapes.constant(root, self.examples[k]) & sizes.keys() if self.sources[k] != page else sizes.keys()
            # an example with this page's article tells nothing of the template
            if sum(sizes[i] for i in same) <= SAME_ARTICLE[marked] * whole:
                used += 1
                for i in same:
                    agreed[i] = agreed.get(i, 0) + 1
        enough = used >= least
        known = self.template.get(frame, ())
        counted = {i for i, t in found.items() if t in known}
        out = []
        for block in blocks:
            if any(i in sizes and i not in counted and not (enough and agreed.get(i, 0) == used) for i in map(id, block)):
                out.append(" ".join("".join(t.text for t in block).split()))
        return "\n\n".join(out)


def host_of(url):
    """The host of a URL column, in lower case; "" for null or without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of df: id_col, url_col, text, n_chars (code points).

    A null or empty page gives an empty text; a null URL counts as a host of its own. Pages are read whole, repeated rows
    give repeated rows, an empty table an empty result. A template of fewer pages than must agree (three, or four with a
    marked article) can't be told from copies of an article: then only markup tells furniture from content. Other columns aren't read.
    """
    NO_TEXTS = F.lit(None).cast("array<bigint>").alias("texts")
    own = df.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
    ).withColumn("host", host_of(F.col("url")))
    keyed = own.where("html is not null").select("host", F.md5(F.col("html").cast("binary")).alias("hash"))
    ranked = (
        keyed.groupBy("host", "hash")
        .count()
        .withColumn("at", F.row_number().over(W.partitionBy("host").orderBy("hash")))
        .where(F.col("at") <= EXEMPLARS)
    )
    space = Workspace(df.sparkSession, "main_text")
    picked = space.save(ranked.select(F.col("host").alias("__host"), F.col("hash").alias("__hash")), "picked")
    # lanes: only hosts of more than LANE_ROWS pages have more than one, so there are few of those
    many = (
        own.groupBy("host")
        .count()
        .where(F.col("count") > LANE_ROWS)
        .select(F.col("host").alias("__h"), F.ceil(F.col("count") / LANE_ROWS).cast("int").alias("lanes"))
    )
    many = space.save(many, "many")
    lanes = small(many, many.count())
    pages = own.join(lanes, F.col("host") == F.col("__h"), "left").withColumn("lanes", F.coalesce("lanes", F.lit(1)))
    n_picked = picked.count()
    same = (F.col("host") == F.col("__host")) & (F.md5(F.col("html").cast("binary")) == F.col("__hash"))
    examples = (
        pages.join(small(picked, n_picked), same)
        .groupBy("host", "__hash")
        .agg(F.max("lanes").alias("lanes"), F.any_value("html").alias("html"))
    )
    examples = examples.select(
        "host",
        F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"),
        F.lit(0).alias("kind"),
        F.col("__hash").alias("hash"),
        F.lit(None).cast(dict(df.dtypes)[id_col]).alias("id"),
        F.lit(None).cast("string").alias("url"),
        "html",
        NO_TEXTS,
        F.lit(None).cast("bigint").alias("frame"),
    )
    template = space.save(template_texts(own), "template")
    n_template = template.count()
    of_host = own.groupBy("host").agg(F.ceil(F.count("*") / LANE_ROWS).cast("int").alias("lanes")).withColumnRenamed("host", "__host")
    known = of_host.join(small(template, n_template), F.col("__host") == F.col("host"))
    known = known.select(
        "host",
        F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"),
        F.lit(0).alias("kind"),
        F.lit("").alias("hash"),
        F.lit(None).cast(dict(df.dtypes)[id_col]).alias("id"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("html"),
        "texts",
        "frame",
    )
    rows = pages.select(
        "host",
        F.pmod(F.xxhash64("id", "url", F.length("html")), F.col("lanes")).cast("int").alias("lane"),
        F.lit(1).alias("kind"),
        F.lit("").alias("hash"),
        "id",
        "url",
        "html",
        NO_TEXTS,
        F.lit(None).cast("bigint").alias("frame"),
    )
    streams = examples.unionByName(known).unionByName(rows).repartition("host", "lane").sortWithinPartitions("host", "lane", "kind", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sources, template, wrapper, shapes = None, [], {}, None, Shapes()
        for b in batches:
            ids, texts, places = b.column(4), [], []
            for i, (host, lane, kind, page) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(6).to_pylist(), strict=True)):
                if key != (host, lane):
                    key, sources, template, wrapper = (host, lane), [], {}, None
                    if len(shapes.numbers) > 500_000:
                        shapes = Shapes()
                if kind == 0:
                    if page is None:
                        template.setdefault(b.column(8)[i].as_py(), set()).update(b.column(7)[i].as_py())
                    else:
                        sources.append(page)
                    continue
                wrapper = wrapper or Wrapper(shapes, sources, template)
                texts.append(wrapper.extract(page))
                places.append(i)
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), b.column(5).take(at), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    return map_batches(streams, run, f"`{id_col}` {dict(df.dtypes)[id_col]}, `{url_col}` string, text string, n_chars long")
