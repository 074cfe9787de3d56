"""Main text of web pages: containers vote on paths per host, and the winning paths extract."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.llm.common import filled_id, written

#: The best container is the deepest that holds this share of the page's text.
NEARLY_ALL = 0.9

#: A host's path is used on a page if it holds this share of what the page's own best container holds.
COVERS = 0.5

#: Hosts with this share of all voting pages are frequent; there are at most 1/share of them.
FREQUENT_SHARE = 1 / 1000

# Element kinds of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript textarea title".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = set("nav header footer aside form button select head iframe object svg canvas audio video menu dialog".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"}
OPENS_NEXT = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
WHOLE_PAGE = set("html body main".split())
CONTAINERS = set("article main section div td body blockquote".split())

#: Class or id words of what is not the article.
ASIDE_WORDS = set(
    "ad ads adv advert advertisement adverts banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar side aside footer header masthead comment comments discussion disqus reply replies respond cookie cookies consent "
    "gdpr notice alert popup modal newsletter subscribe signup login share sharing social related recommended widget toolbar "
    "pagination pager skip copyright disclaimer search form".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
MARKER = re.compile(r"(?:^|\s)(class|id|role|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: What ends an element whose content is no markup.
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
NUMBER = re.compile(r"\d+")
WORDS = re.compile(r"[^a-z]+")


def generalised(tag: str, classes: str) -> str:
    """A step of a path: the tag and its classes with digits removed, so that numbered ones agree."""
    names = sorted({NUMBER.sub("", c) for c in classes.lower().split()} - {""})
    return ".".join([tag, *names])


class Node:
    """An open or closed element: its place in the table of paths, and whether it belongs to what surrounds the article.

    ``aside`` is sure (the kind of the element, a whole class word) or ``doubted``: a part of a class word, which holds
    only for elements without most of the page's text.
    """

    __slots__ = ("tag", "path", "aside", "doubted", "above")

    def __init__(self, tag: str, path: int, aside: bool, doubted: bool, above: Node | None):
        self.tag, self.path, self.aside, self.doubted, self.above = tag, path, aside, doubted, above


class Page:
    """The blocks of a page in its order, (the element each lies in, text, characters of it in links), and its paths.

    A path is its parent's number and its last step, so that memory grows with the page, however deep its elements nest.
    """

    def __init__(self) -> None:
        self.blocks: list[tuple[Node, str, int]] = []
        self.nodes: list[Node] = []
        self.parents, self.steps, self.numbers = [-1], [""], {}

    def below(self, path: int, step: str) -> int:
        number = self.numbers.setdefault((path, step), len(self.steps))
        if number == len(self.steps):
            self.parents.append(path)
            self.steps.append(step)
        return number

    def name(self, path: int) -> str:
        steps = []
        while path > 0:
            steps.append(self.steps[path])
            path = self.parents[path]
        return "".join(f"/{x}" for x in reversed(steps))

    def number(self, name: str) -> int | None:
        path = 0
        for step in name.split("/")[1:]:
            path = self.numbers.get((path, step))
            if path is None:
                return None
        return path

    def settle(self) -> None:
        """Class words alone don't make an element with most of the page's text a surrounding; and what lies in one is one."""
        held: dict[Node, int] = {n: 0 for n in self.nodes}
        total = 0
        sure: dict[Node, bool] = {}
        for n in self.nodes:
            sure[n] = n.aside or (n.above is not None and sure.get(n.above, False))
        for node, text, linked in self.blocks:
            if node in sure and not sure[node] and 2 * linked <= len(text):
                held[node] += len(text)
                total += len(text)
            elif node not in sure and 2 * linked <= len(text):
                total += len(text)
        for n in reversed(self.nodes):
            if n.above in held:
                held[n.above] += held[n]
        for n in self.nodes:
            above = n.above is not None and n.above.aside
            n.aside = above or n.aside or (n.doubted and 2 * held[n] < total)

    def own(self) -> list[tuple[Node, str, int]]:
        return [b for b in self.blocks if not b[0].aside]


def tokens_of(page: str) -> Iterator[re.Match]:
    """The tokens of a page. Raw content, such as a script with ``i<n``, is no markup: it is skipped to its end tag."""
    at = 0
    while at < len(page):
        for m in TOKEN.finditer(page, at):
            at = m.end()
            yield m
            if m.group(2) and not m.group(1) and (tag := m.group(2).lower()) in RAW:
                end = RAW_END[tag].search(page, at)
                at = end.start() if end else len(page)
                break


def parsed(page: str) -> Page:
    """The blocks of a page in its order.

    Tolerant of missing end tags: a new paragraph or item ends the one before, an end tag
    ends what is open inside, and stray ones are ignored. White space becomes one space.
    Raw elements are left out, to their end tag or, without one, to the end of the page.
    """
    result = Page()
    open_tags: Counter = Counter()
    root = Node("", 0, False, False, None)
    stack = [root]
    found = result.blocks
    parts: list[str] = []
    linked = link_depth = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((stack[-1], text, linked))
            parts.clear()
        linked = 0

    for m in tokens_of(page):
        token, name = m.group(), m.group(2)
        if name is None:
            if token[0] == "<" and token[1:2] in ("!", "?"):
                continue
            text = entities.unescape(token)
            parts.append(text)
            if link_depth:
                linked += len(text.strip())
            continue
        tag = name.lower()
        if m.group(1):
            if tag == "a":
                link_depth = max(0, link_depth - 1)
            if tag in BLOCK or tag in ASIDE:
                if open_tags[tag]:
                    flush()
                    while True:
                        ended_tag = stack.pop().tag
                        open_tags[ended_tag] -= 1
                        if ended_tag == tag:
                            break
            continue
        if tag in RAW:
            continue
        if tag == "br" or tag == "hr":
            flush()
            continue
        if tag in VOID:
            continue
        if tag == "a":
            link_depth += 1
        if tag in BLOCK or tag in ASIDE:
            flush()
            ended = OPENS_NEXT.get(tag)
            if tag in CLOSES_P and any(n.tag == "p" for n in stack[-3:]):
                ended = {"p"}
            if ended and any(open_tags[x] for x in ended):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ended:
                        open_tags.subtract(n.tag for n in stack[i:])
                        del stack[i:]
                        break
                    if stack[i].tag in ("ul", "ol", "dl", "table"):
                        break
            marks = {k.lower(): a or b or c for k, a, b, c in MARKER.findall(m.group(3))}
            named = f"{marks.get('class', '')} {marks.get('id', '')} {marks.get('role', '')}".lower()
            whole = tag not in WHOLE_PAGE and not ASIDE_WORDS.isdisjoint(named.split())
            doubted = tag not in WHOLE_PAGE and not ASIDE_WORDS.isdisjoint(WORDS.split(named))
            above = stack[-1]
            # An article may well be named after its matter: its class words never are sure.
            aside = tag in ASIDE or "hidden" in marks or (whole and tag != "article")
            # Text formatting inside a container is no step of a path.
            step = result.below(above.path, generalised(tag, marks.get("class") or "")) if tag in CONTAINERS or tag in ASIDE else above.path
            if not m.group(3).endswith("/"):
                stack.append(Node(tag, step, aside, doubted, above))
                open_tags[tag] += 1
                result.nodes.append(stack[-1])
    flush()
    result.settle()
    return result


def blocks_of(page: str) -> list[tuple[Node, str, int]]:
    """The blocks of a page in its order: (the element it lies in, text, characters of it in links)."""
    return parsed(page).blocks


def container_scores(page: Page) -> list[int]:
    """Score of every container path of a page: the text in it and below it that is no surrounding and not mostly links."""
    scores = [0] * len(page.steps)
    for node, text, linked in page.own():
        if 2 * linked <= len(text):
            scores[node.path] += len(text)
    for path in range(len(scores) - 1, 0, -1):  # parents stand before what lies in them
        scores[page.parents[path]] += scores[path]
    return scores


def best_container(page: Page, scores: list[int]) -> int:
    """The outermost article with most of the text, or else main part; without one, the deepest container with nearly all of
    the text, or what also holds the page's title around it. So short headings, leads and closing words beside a long inner body stay.
    0 if the page has no text.
    """
    if not scores[0]:
        return 0

    def around(share: float) -> list[int]:
        """The containers that hold more than that share, from the deepest on: they nest, so the last path is the deepest."""
        chain = [max(i for i, x in enumerate(scores) if x > share * scores[0])]
        while chain[-1] > 0:
            chain.append(page.parents[chain[-1]])
        return chain

    for tag in ("article", "main"):
        for path in reversed(around(0.5)):
            if page.steps[path].partition(".")[0] == tag:
                return path
    chain = around(NEARLY_ALL)
    best = chain[0]
    titled = {node.path for node, _, _ in page.own() if node.tag == "h1"}
    if titled and best not in titled:
        for path in chain[1:]:
            if path in titled and page.steps[path].partition(".")[0] not in WHOLE_PAGE:
                return path
    return best


def text_under(html: str, name: str | None) -> str:
    """The blocks of a page that lie under a path, without what surrounds the article.

    Where that path holds only a small part of what the page's own best container holds, as on a page of another template
    than most of its host, the page's own best container is extracted.
    """
    page = parsed(html)
    scores = container_scores(page)
    best = best_container(page, scores)
    path = page.number(name) if name is not None else None
    if path is None or scores[path] < COVERS * scores[best] or not scores[path]:
        path = best
    inside = [False] * len(page.steps)
    for i in range(len(inside)):
        inside[i] = i == path or (i > 0 and inside[page.parents[i]])
    return "\n".join(t for n, t, _ in page.own() if inside[n.path])


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each page votes for its best container; votes are summed in the task."""
    votes: dict[tuple[str, str], int] = {}
    for batch in batches:
        for host, html in zip(batch["host"], batch["html"], strict=True):
            page = parsed(html)
            best = best_container(page, container_scores(page))
            if best:
                vote = host, page.name(best)
                votes[vote] = votes.get(vote, 0) + 1
        if len(votes) > 200_000:
            yield pd.DataFrame([(*k, v) for k, v in votes.items()], columns=["host", "path", "votes"])
            votes = {}
    if votes:
        yield pd.DataFrame([(*k, v) for k, v in votes.items()], columns=["host", "path", "votes"])


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The main text of every page: ``page_id``, ``url``, ``text``, ``n_chars`` (code points).

    1. Every container of a page is scored; the page votes for the generalised tag-class path of its best one.
    2. Votes are counted per host, in the tasks first; the path with most votes wins (ties: the shorter, then the
       smaller one). A host of most pages is one row per task by then.
    3. Every page is extracted again with its host's winning path. A page where that holds less than ``COVERS`` of what its own best
       container holds, as one of another template, gives the text of its own best container.

    An element is a surrounding by its kind or a whole word of its class, id or role; by a part of such a word only if it holds less
    than half of the page's text.
    The paths of hosts with at least ``FREQUENT_SHARE`` of all voting pages, boundedly many, are broadcast; the others meet
    their pages in a join by host, in which no host has a large share.
    NULL is an empty page, which gives an empty text, as does a page without blocks. Pages without
    a host (NULL url, no ``://``) vote together. Repeated rows are extracted alike; pages of any length are read whole.
    """
    kind = pages.schema[id_column].dataType.simpleString()
    page_id, has_id = filled_id(pages, id_column)
    host = F.lower(F.regexp_extract(F.coalesce(pages[url_column], F.lit("")), r"://([^/?#]*)", 1))
    page = F.coalesce(pages[html_column], F.lit(""))
    votes = pages.select(host.alias("host"), page.alias("html")).mapInPandas(_votes, "host string, path string, votes long")
    counted = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    own_host = Window.partitionBy("host")
    ranked = counted.withColumns(
        {
            "rank": F.row_number().over(own_host.orderBy(F.col("votes").desc(), F.length("path"), "path")),
            "pages": F.sum("votes").over(own_host),
        }
    )
    winners = written(ranked.where("rank = 1").select("host", "path", "pages"))
    total = winners.agg(F.sum("pages")).first()[0] or 0
    frequent = F.col("pages") >= F.lit(total * FREQUENT_SHARE)

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = batch["path"].where(batch["path"].notna(), None)
            texts = [text_under(h, p) for h, p in zip(batch["html"], paths, strict=True)]
            yield batch[["page_id", "has_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    own = pages.select(
        page_id.alias("page_id"), has_id.alias("has_id"), pages[url_column].alias("url"), host.alias("host"), page.alias("html")
    )
    often = winners.where(frequent).select("host", F.col("path").alias("often"))
    known = own.join(F.broadcast(often), "host", "left")
    # Pages whose path is known stand under a name that no host has, which spreads them over the tasks.
    apart = F.concat(F.lit("/"), F.xxhash64("page_id", "url", "html").cast("string"))
    keyed = known.withColumn("key", F.when(F.col("often").isNull(), F.col("host")).otherwise(apart))
    rare = winners.where(~frequent).select(F.col("host").alias("key"), "path")
    path = F.coalesce("often", "path").alias("path")
    joined = keyed.join(rare, "key", "left").select("page_id", "has_id", "url", "html", path)
    out = joined.mapInPandas(extracted, f"page_id {kind}, has_id boolean, url string, text string, n_chars long")
    return out.select(F.when(F.col("has_id"), F.col("page_id")).alias("page_id"), "url", "text", "n_chars")
