"""Main text of web pages by a style tree of each site: the pages of a host are merged, and contents that carry little
of their own there are taken out of the pages that have them."""

from __future__ import annotations

import hashlib
import html as _html
import itertools
import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, stash
from .packing import groups_of

# HTML's own classes of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select option canvas".split())
#: Of these, what follows an element without an end tag is its text; of the others, the page goes on after the start tag.
TO_END = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements, roles and words of class and id that mark a branch as presentation, and words that beside
#: these say nothing. A class counts if it is such words throughout: "ad" and "site-footer" do, "ad-free" does not.
BRANCHES = frozenset("nav footer aside form button dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead sidebar aside ad ads advert adverts advertisement sponsor sponsored promo promotion banner"
    " cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus respond replies share sharing related recommended newsletter subscribe"
    " subscription login signin signup search pagination pager toolbar copyright form".split()
)
BESIDE = frozenset("site page main top bottom left right box block container wrapper bar area section list inner item items slot widget links social user global".split())
#: What the page itself calls its main part: a branch in it needs only WITHIN of the importance asked for elsewhere.
LANDMARKS, WITHIN = frozenset(["article", "main"]), 0.65
#: Contents with less importance than LEAST go. PRIOR: entropy on few pages says little, so that a content counts as
#: important on so many pages besides those of the site.
LEAST, PRIOR = 0.12, 1
#: Rows of low contents that the driver sends to all workers; beyond, they are joined to the pages.
SEND = 100_000

_MARK = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_CLOSERS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


#: Stands in a node's parts where an element without content ends a block.
BREAK = object()


class Node:
    """An element of a page that is not inline. parts: children, texts and breaks in order; label: its tag and classes;
    path: labels from the root (a long one begins with its hash); below: at the root, all nodes in order."""

    __slots__ = ("tag", "label", "path", "parts", "dropped", "inside", "content", "below")

    def __init__(self, tag: str, label: str, path: str, dropped: bool, inside: bool):
        self.tag, self.label, self.path, self.dropped, self.inside = tag, label, path, dropped, inside
        self.parts, self.content, self.below = [], None, []


def _attributes(raw: str) -> dict[str, str]:
    """Attributes by name; the first of a name counts."""
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed([*_ATTRIBUTE.finditer(raw)])} if raw.strip() else {}


def _marked(name: str) -> bool:
    words = [w.lower() for w in _PART.findall(name)]
    return not WORDS.isdisjoint(words) and all(w in WORDS or w in BESIDE for w in words)


def _presentation(tag: str, at: dict[str, str], inside: bool) -> bool:
    if tag in BRANCHES or tag == "header" and not inside:
        return True
    if at.get("role", "").lower() in ROLES or "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in at.get("style", "").replace(" ", "").lower():
        return True
    return tag not in ("html", "body", "article", "main", "h1") and any(map(_marked, f"{at.get('class', '')} {at.get('id', '')}".split()))


def _tag_end(html: str, at: int, lone: set[str]) -> int:
    """The place of the > that ends a tag, or -1. Quotes after = hide it; one without a partner in the rest of the page
    (lone) is taken as a letter."""
    while found := _STOP.search(html, at):
        if found[0] == ">":
            return found.start()
        before, at = found.start() - 1, found.end()
        while html[before].isspace():
            before -= 1
        if html[before] == "=" and found[0] not in lone:
            end = html.find(found[0], at)
            if end < 0:
                lone.add(found[0])
            else:
                at = end + 1
    return -1


def parse(html: str) -> Node:
    """The page's tree, in time linear in the page; elements that no end tag closes end where HTML ends them."""
    root = Node("", "", "", False, False)
    stack, opened, at, n = [root], Counter(), 0, len(html)
    unclosed, lone = set(), set()  # unclosed: elements without an end tag in the rest of the page

    def close() -> str:
        tag = stack.pop().tag
        opened[tag] -= 1
        return tag

    while at < n:
        start = html.find("<", at)
        found = _MARK.match(html, start) if start >= 0 else None
        name = found and found[2]
        end = _tag_end(html, found.end(), lone) if name else -1
        if not found or name and end < 0:  # no tag: text up to here, or to the page's end
            upto = n if start < 0 or found else start + 1
            stack[-1].parts.append(html[at:upto])
            at = upto
            continue
        if start > at:
            stack[-1].parts.append(html[at:start])
        if not name:
            mark = "-->" if found[0] == "<!--" else ">"
            at = html.find(mark, found.end())
            at = n if at < 0 else at + len(mark)
            continue
        at, tag, raw = end + 1, name.lower(), html[found.end() : end]
        if found[1]:
            if tag not in INLINE and opened[tag] > 0:
                while close() != tag:
                    pass
            continue
        if tag in RAW:
            if tag in ("svg", "math") and raw.rstrip().endswith("/") or tag in unclosed:
                continue
            if over := _CLOSERS[tag].search(html, at):
                at = over.end()
            elif tag in TO_END:
                at = n
            else:
                unclosed.add(tag)
            continue
        if tag in INLINE:
            if tag == "br":
                stack[-1].parts.append(" ")
            continue
        if tag in VOID:
            stack[-1].parts.append(BREAK)
            continue
        while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag == tag and tag in ("li", "tr", "td", "th", "dt", "dd", "option") or tag == "tr" and stack[-1].tag in ("td", "th") or tag == "body" and stack[-1].tag == "head"):
            close()
        own, above = _attributes(raw), stack[-1]
        names = ".".join(sorted(w.lower() for w in _PART.findall(own.get("class", ""))))
        label = f"{tag}.{names}" if names else tag
        path = above.path if len(above.path) < 400 else f"#{_hash(above.path)}"
        node = Node(tag, label, f"{path}/{label}", above.dropped or _presentation(tag, own, above.inside), above.inside or tag in LANDMARKS)
        above.parts.append(node)
        root.below.append(node)
        if not raw.rstrip().endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def branches(root: Node, host: str) -> list[tuple[Node, int, int, int]]:
    """Each branch that is not dropped already: its node, and numbers for its place (host and path), its style (the
    children's labels) and its content (its texts, and the contents of its children)."""
    out = []
    for node in reversed(root.below):  # children before their parents
        if node.dropped:
            continue
        content, style, run = [], [], []
        for part in [*node.parts, None]:
            if isinstance(part, str):
                run.append(part)
            elif part is BREAK:
                run.append(" ")
            else:
                if text := " ".join("".join(run).split()):
                    content.append(f"t{text}")
                run.clear()
                if part is not None:
                    style.append(part.label)
                    if part.content is not None and not part.dropped:
                        content.append(f"c{part.content}")
        if content:
            node.content = _hash("\0".join(content))
            if node.tag not in ("html", "body"):
                short = [s for s, before in zip(style, [None, *style]) if s != before]
                out.append((node, _hash(f"{host}\0{node.path}"), _hash(",".join(short)), node.content))
    return out


def main_text(root: Node) -> str:
    """The blocks that are left, one a line."""
    blocks: list[str] = []
    run: list[str] = []
    stack = [iter(root.parts)]
    while stack:
        part = next(stack[-1], None)
        if isinstance(part, str):
            run.append(part)
            continue
        if run and (block := " ".join(_html.unescape("".join(run).replace("\0", "")).split())):
            blocks.append(block)
        run.clear()
        if part is None:
            stack.pop()
        elif part is not BREAK and not part.dropped:
            stack.append(iter(part.parts))
    return "\n".join(blocks)


def importance(pages: DataFrame) -> DataFrame:
    """place (host and path), content, inside (a landmark), pages (distinct pages of the host that have the path), n
    (those that have this content there, 2 at least), presentation, own and importance, in the merged trees.

    In a style tree the entropy of a node's contents over the most it could be is the mean, over its pages, of
    1 - log(n) / log(pages): that is `own`, each content's part in it, so that a content is judged and not all that lies
    at its path. It is mixed with the entropy of the path's styles as the tree's composite importance has it, and, as a
    mean over pages, with PRIOR pages of importance 1, so that small sites need no rule of their own. Equal pages (host and html) count once, and a page counts a style or content once however many nodes have it.
    """

    def run(batches):
        for batch in batches:
            for piece in groups_of(batch, "html"):
                page, ends, rows = [], [0], []
                for url, html in zip(piece.column("url").to_pylist(), piece.column("html").to_pylist(), strict=True):
                    host, own = host_of(url), set()
                    for node, place, style, content in branches(parse(html), host):
                        own |= {(place, 0, int(node.inside)), (place, 1, style), (place, 2, content)}
                    if own:
                        page.append(hashlib.blake2b(f"{host}\0{html}".encode("utf-8", "surrogatepass"), digest_size=16).digest())
                        rows += own
                        ends.append(len(rows))
                if page:
                    place, kind, value = zip(*rows, strict=True)
                    each = pa.StructArray.from_arrays([pa.array(place, pa.int64()), pa.array(kind, pa.int32()), pa.array(value, pa.int64())], ["place", "kind", "value"])
                    yield pa.RecordBatch.from_arrays([pa.array(page, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], ["page", "nodes"])

    rows = pages.select("url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page binary, nodes array<struct<place: bigint, kind: int, value: bigint>>")
    nodes = rows.dropDuplicates(["page"]).select(F.explode("nodes").alias("x")).select("x.*")
    counts = stash(nodes.groupBy("place", "kind", "value").agg(F.count(F.lit(1)).alias("n")).where("kind < 2 or n > 1"), "branches")
    n, log = F.col("n").cast("double"), F.log
    style = F.col("kind") == 1
    sums = counts.where("kind < 2").groupBy("place").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        (F.max(F.when(F.col("kind") == 0, F.col("value"))) > 0).alias("inside"),
        F.sum(F.when(style, n)).alias("all"),
        F.sum(F.when(style, n * log(n))).alias("same"),
    )
    presentation = F.when(F.col("all") > 1, 1 - F.col("same") / (F.col("all") * log("all"))).otherwise(1.0)
    sums = sums.select("place", "pages", "inside", presentation.alias("presentation"))
    out = counts.where("kind = 2").select("place", F.col("value").alias("content"), "n").join(sums.where("pages > 1"), "place")
    out = out.withColumn("own", 1 - log(n) / log("pages"))
    mean = 0.1 * F.col("presentation") + 0.9 * F.col("own")
    return out.withColumn("importance", (PRIOR + F.col("pages") * mean) / (PRIOR + F.col("pages")))


def extract(pages: DataFrame, *, least: float = LEAST, send: int = SEND) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages.

    Branches go whose content the site repeats at the same path (importance below `least`; on few pages it is never that
    low), and those that their element, role, class or id marks as presentation: no entropy saves them, as menus and
    adverts differ from page to page as well. A content that one page alone has stays, whatever else lies at its path. An article or main element is a weight in that, no switch:
    branches in it go below WITHIN times `least`, and text outside of it is judged like that of any page. The low
    contents of all hosts are sent to the workers while they are at most `send` rows; beyond, each page's own branches
    are joined to them.

    Nulls: a null html counts as empty and gives an empty text; pages with a null or bad url form one host; a null
    page_id is kept. Repeated rows give a row each. An empty table gives no rows. Columns besides page_id, url and html
    are ignored. Broken markup is taken as it comes: nothing is dropped for it.
    """
    spark = session_of(pages)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    asked = F.when(F.col("inside"), least * WITHIN).otherwise(least)
    low = stash(importance(pages).where(F.col("importance") < asked).select("place", "content"), "low")
    few = low.limit(send + 1).collect()
    schema = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long"

    if len(few) <= send:
        shared = spark.sparkContext.broadcast(frozenset(map(tuple, few)))
        lows = lambda batch: itertools.repeat(shared.value, len(batch))
    else:

        def own(batches):
            for batch in batches:
                rows = sorted({(k, place, content) for k, u, h in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html")), strict=True) for _, place, _, content in branches(parse(h), host_of(u))})
                if rows:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows, strict=True))], ["key", "place", "content"])

        pages = pages.withColumn("key", F.xxhash64("page_id", "url", "html"))
        each = pages.select("key", "url", "html").mapInArrow(own, "key long, place long, content long")
        found = each.join(low, ["place", "content"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("place", "content")).alias("low"))
        pages = pages.join(found, "key", "left").select("page_id", "url", "html", "low")
        lows = lambda batch: ({(x["place"], x["content"]) for x in own or ()} for own in batch.column("low").to_pylist())

    def text_of(url: str | None, html: str, low) -> str:
        root = parse(html)
        for node, place, _, content in branches(root, host_of(url)) if low else ():
            node.dropped = node.dropped or (place, content) in low
        return main_text(root)

    def run(batches):
        for batch in batches:
            for piece in groups_of(batch, "html"):
                text = [text_of(u, h, own) for u, h, own in zip(piece.column("url").to_pylist(), piece.column("html").to_pylist(), lows(piece), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(text), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, schema)
