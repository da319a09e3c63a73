"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. A page's element tree (block elements only; siblings of the same tag and class count
as one repeated element, the list of a wrapper) is aligned with those of the other pages by simple tree matching: two trees match if their
roots do, and their children are matched in order so that the most nodes match. Aligned nodes become one node of the
host's template, the others optional nodes. Pages are then aligned with their host's template, and the distinct pages (copies of
a page count once) that have a text in a node are counted, all of them. Text that nearly all pages with a node have
there is constant and belongs to the template; what varies is a slot. A page's main text are the texts of the varying
slots that stand for the article: slots in menus, headers, footers, sidebars, notices, adverts, forms, scripts or reader
comments, known by element or class, are not content.

The article's own place is its article or main element or, on pages without one, the smallest element around the nodes
that vary on most pages of the host. Inside it a text is constant only on much more evidence: nearly all distinct pages
of the host, ``ARTICLE_EVIDENCE`` of them or more, have it, and on the page at hand such texts are less than half of the
article; near-copies of one article share more than that, and keep it all.

Every task folds its pages into one partial template for each host, and a host's partial templates, one for each task
at most, are merged: a hot host sends as many small trees as there are tasks. Templates then meet the pages by host,
once for the counts and once, with the constant texts, for the result; they are broadcast if their measured size is
small, and otherwise joined with the hot hosts' pages salted over copies. Counts by host, node and text are combined
before they are shuffled.

Defined cases: elements may be nested to any depth; null or empty html gives an empty text; a null url, or one without host, has the host ""; a host with
fewer than ``EVIDENCE`` distinct pages has no constants; repeated rows are extracted alike; other columns play no part.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches
from .urls import with_parts

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|</\s*([a-zA-Z][\w:-]*)[^>]*>"
    r"|<([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
MARKS = re.compile(r"[^a-z_-]+")
#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
SCOPES = frozenset("article aside blockquote body div dl fieldset figure footer form header main nav ol section table td th ul".split())
#: Elements that are no part of an article, and whole tokens of a class, id or role that say the same of any element but
#: those in WHOLE, which wrap the article whatever they are called.
BESIDES = frozenset("nav aside footer form head button select option menu dialog fieldset legend".split())
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form header login masthead menu modal nav navbar navigation newsletter notice "
    "pagination popup promo promoted related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
WHOLE = frozenset("html body main article".split())
EVIDENCE, ARTICLE_EVIDENCE, CONSTANT = 3, 8, 0.9
BROADCAST_BYTES = 16 << 20


def _text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _tokens(attributes: str) -> set[str]:
    """Tokens of class, id and role, without digits and signs other than hyphens within."""
    named = " ".join(x for found in NAMED.findall(attributes) for x in found if x)
    return {t for t in (MARKS.sub("", raw).strip("-_") for raw in named.lower().split()) if t}


class Node:
    """An element of a page or a template: signature, children in order, and what follows from its place."""

    __slots__ = ("sign", "parent", "children", "by_sign", "number", "depth", "key", "beside", "inside", "used", "shape", "count")

    def __init__(self, sign: str, parent: Node | None = None):
        self.sign, self.parent, self.children, self.by_sign = sign, parent, [], {}
        self.number, self.used, self.shape, self.count = 0, False, 0, 1
        if parent is None:
            self.depth, self.key, self.beside, self.inside = 0, 0, False, False
            return
        tag, *words = sign.split(".")
        self.depth, self.key = parent.depth + 1, xxhash.xxh3_64_intdigest(sign, parent.key)
        self.inside = parent.inside or tag in ("article", "main")
        # Whether the element is outside the article: some element around it, or itself, says so.
        self.beside = parent.beside or tag in BESIDES or (tag not in WHOLE and not BESIDE_WORDS.isdisjoint(words)) or (tag == "header" and not parent.inside)

    def child(self, sign: str) -> Node:
        """The child of a signature; siblings of one signature are one node."""
        found = self.by_sign.get(sign)
        if found is None:
            found = self.by_sign[sign] = Node(sign, self)
            self.children.append(found)
        return found

    def use(self) -> None:
        node: Node | None = self
        while node is not None and not node.used:
            node.used, node = True, node.parent

    def in_order(self) -> list[Node]:
        """The node and all below it, in preorder."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            out.append(node)
            todo.extend(reversed(node.children))
        return out

    def finish(self) -> Node:
        """Numbers the nodes in preorder (the root is 0), and takes a hash of every subtree."""
        nodes = self.in_order()
        for n, node in enumerate(nodes):
            node.number = n
        for node in reversed(nodes):
            node.count = 1 + sum(c.count for c in node.children)
            node.shape = hash((node.sign, *[c.shape for c in node.children]))
        return self

    def dump(self) -> str:
        return json.dumps([[node.depth, node.sign] for node in self.in_order()])

    @classmethod
    def load(cls, raw: str) -> Node:
        open_: list[Node] = []
        for depth, sign in json.loads(raw):
            del open_[depth:]
            node = cls(sign, open_[-1] if open_ else None)
            if open_:
                open_[-1].children.append(node)
            open_.append(node)
        return open_[0].finish()


def blocks(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """A page as a tree of its block elements that hold text, and every piece of text with its node, in order."""
    root = Node("")
    stack: list[str] = []  # open elements; inline ones too
    nodes: list[Node | None] = []  # block elements among them
    around = [root]
    out: list[tuple[Node, str]] = []
    pending: list[str] = []

    def flush() -> None:
        if pending:
            text = " ".join(entities.unescape("".join(pending)).split())
            pending.clear()
            if text:
                around[-1].use()
                out.append((around[-1], text))

    def close(at: int) -> None:
        ended = sum(n is not None for n in nodes[at:])
        if ended:
            flush()
            del around[-ended:]
        del stack[at:], nodes[at:]

    end = 0
    for m in TOKEN.finditer(page):
        if m.start() > end:
            pending.append(page[end : m.start()])
        end = m.end()
        if m[3]:
            tag = m[3].lower()
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    pending.append(" ")
                continue
            ended = CLOSES.get(tag, frozenset(["p"]) if tag in ENDS_P else None)
            if ended:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] in ended:
                        close(i)
                        break
                    if stack[i] in SCOPES and not (tag == "tr" and stack[i] in ("td", "th")):
                        break
            sign = ""
            if tag in BLOCK:
                flush()
                sign = ".".join((tag, *sorted(_tokens(m[4]))))
            elif m[4]:
                words = BESIDE_WORDS.intersection(_tokens(m[4]))
                if words:
                    flush()
                    sign = tag + "." + ".".join(sorted(words))
            if not m[4].rstrip().endswith("/"):
                stack.append(tag)
                nodes.append(around[-1].child(sign) if sign else None)
                if sign:
                    around.append(nodes[-1])
        elif m[2]:
            tag = m[2].lower()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == tag:
                    close(i)
                    break
                if stack[i] in SCOPES and tag not in SCOPES and tag not in ("body", "html"):
                    break
    if end < len(page):
        pending.append(page[end:])
    flush()
    for node in root.in_order():
        node.children = [c for c in node.children if c.used]
    return root.finish(), out


class Matching:
    """Simple tree matching of two trees: two nodes match if their signatures do, and their children are matched in order
    so that the most nodes match. Subtrees of one shape match whole."""

    def __init__(self, a: Node, b: Node):
        self.kept: dict[tuple[int, int], tuple[int, list[tuple[Node, Node]]]] = {}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * (a.count + b.count) + 10_000))  # trees may be chains
        self.total = self.weigh(a, b)
        self.pairs: list[tuple[Node, Node]] = []  # below the roots
        todo = [(a, b)] if self.total else []
        while todo:
            x, y = todo.pop()
            below = list(zip(x.children, y.children, strict=True)) if x.shape == y.shape else self.kept[id(x), id(y)][1]
            self.pairs += below
            todo += below

    def weigh(self, a: Node, b: Node) -> int:
        if a.sign != b.sign:
            return 0
        if a.shape == b.shape:
            return a.count
        found = self.kept.get((id(a), id(b)))
        if found is None:
            found = self.kept[id(a), id(b)] = self.children(a, b)
        return found[0] + 1

    def children(self, a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
        """The heaviest chain of child pairs, both sides in order. Only pairs of one signature count, so a table of the
        best chains by last place in b, kept as prefix maxima, takes the place of a table of all pairs."""
        where: dict[str, list[int]] = {}
        for j, c in enumerate(b.children):
            where.setdefault(c.sign, []).append(j)
        size = len(b.children)
        best: list[tuple[int, int]] = [(0, -1)] * (size + 1)
        chain: list[tuple[int, Node, Node]] = []  # (chain before, pair)
        for x in a.children:
            for j in reversed(where.get(x.sign, ())):
                w, before, k = 0, -1, j
                while k:  # best chain that ends before place j
                    if best[k][0] > w:
                        w, before = best[k]
                    k -= k & -k
                w += self.weigh(x, b.children[j])
                chain.append((before, x, b.children[j]))
                k = j + 1
                while k <= size:
                    if best[k][0] < w:
                        best[k] = (w, len(chain) - 1)
                    k += k & -k
        w, at, k = 0, -1, size
        while k:
            if best[k][0] > w:
                w, at = best[k]
            k -= k & -k
        pairs = []
        while at >= 0:
            at, x, y = chain[at]
            pairs.append((x, y))
        return w, pairs[::-1]


def places(own: Node, template: Node) -> dict[int, int]:
    """Number of the template's node by the number of every node of a page that is aligned with one."""
    if own.shape == template.shape:
        return dict(enumerate(range(own.count)))
    return {0: 0} | {y.number: x.number for x, y in Matching(template, own).pairs}


def merge(a: Node, b: Node) -> Node:
    """Template of two templates: matched nodes become one, the others stay, in order."""
    if a.shape == b.shape:
        return a
    partner = {id(y): x for x, y in Matching(a, b).pairs}
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        place = {id(c): k for k, c in enumerate(x.children)}
        after: dict[int, list[Node]] = {}
        at = -1
        for c in y.children:
            own = partner.get(id(c))
            if own is not None:
                todo.append((own, c))
                at = place[id(own)]
            else:
                c.parent = x
                after.setdefault(at, []).append(c)
        if after:
            x.children = after.get(-1, []) + [n for k, c in enumerate(x.children) for n in (c, *after.get(k, ()))]
    return a.finish()


class Wrapper:
    """A host's template with the constant texts of its nodes, those also constant inside an article (``firm``), and the
    numbers of the nodes that hold the article on pages without an article or main element."""

    def __init__(self, template: str, constants: str | None, varying: str | None):
        self.template = Node.load(template)
        found = json.loads(constants or "[]")
        self.constants = {(c["node"], c["text"]) for c in found}
        self.firm = {(c["node"], c["text"]) for c in found if c["firm"]}
        self.article = self._around(set(json.loads(varying or "[]")))

    def _around(self, varying: set[int]) -> set[int]:
        """Numbers of the smallest element around all varying nodes and of all below it; of all nodes if none varies."""
        common: Node | None = None
        for node in self.template.in_order():
            if node.number in varying and not node.beside:
                # A node's own text is in the element around it: siblings that are alike are one node.
                above = node.parent or node
                if common is None:
                    common = above
                while common is not above:
                    if common.depth >= above.depth:
                        common = common.parent
                    else:
                        above = above.parent
        return {node.number for node in (common or self.template).in_order()}


def main_text(page: str, wrapper: Wrapper | None) -> str:
    own, found = blocks(page)
    at = places(own, wrapper.template) if wrapper is not None and found else {}
    kept_ = [(node, text) for node, text in found if not node.beside]
    marked = [(node, text) for node, text in kept_ if node.inside]
    pieces = []
    for node, text in marked or kept_:
        number = at.get(node.number)
        pieces.append((text, number is not None and (number, _text_hash(text)), bool(marked) or number is None or number in wrapper.article))
    article = sum(len(text) for text, _, inside in pieces if inside)
    same = sum(len(text) for text, key, inside in pieces if inside and key and key in wrapper.firm)
    firm = wrapper.firm if wrapper is not None and 2 * same < article else frozenset()
    return " ".join(text for text, key, inside in pieces if not (key and key in (firm if inside else wrapper.constants)))


def templates(pages: DataFrame, hosts_at_once: int = 2000) -> DataFrame:
    """``host, template`` (JSON) from ``host, html``."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Node] = {}
        seen: set[tuple[str, int]] = set()  # a structure that is in the template adds nothing
        flush = lambda: pd.DataFrame([(h, t.dump()) for h, t in known.items()], columns=["host", "template"])
        for batch in batches:
            for host, page in zip(batch["host"], batch["html"], strict=True):
                own, _ = blocks(page)
                if (host, own.shape) not in seen:
                    seen.add((host, own.shape))
                    known[host] = merge(known[host], own) if host in known else own
            if len(known) > hosts_at_once:
                yield flush()
                known.clear()
                seen.clear()
        yield flush()

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for raw in sorted(group["template"]):
            node = Node.load(raw)
            total = node if total is None else merge(total, node)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "template": [total.dump()]})

    partial = pages.select("host", F.coalesce("html", F.lit("")).alias("html")).mapInPandas(fold, "host string, template string")
    return partial.groupBy("host").applyInPandas(combine, "host string, template string")


def constants(met: DataFrame) -> DataFrame:
    """``host, constants, varying`` (JSON: node, text hash and whether firm; nodes) from ``host, html, template`` of all pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Node] = {}
        for batch in batches:
            rows = []
            for host, page, raw in zip(batch["host"], batch["html"], batch["template"], strict=True):
                if host not in known:
                    if len(known) > 500:
                        known.clear()
                    known[host] = Node.load(raw)
                own, found = blocks(page)
                at = places(own, known[host])
                pairs = dict.fromkeys((at[node.number], _text_hash(text)) for node, text in found if node.number in at)
                whole = _text_hash("\x00".join(f"{node.key:x} {text}" for node, text in found))
                rows.append((host, whole, [n for n, _ in pairs], [t for _, t in pairs]))
            yield pd.DataFrame(rows, columns=["host", "page", "nodes", "texts"])

    pages = met.mapInPandas(run, "host string, page long, nodes array<int>, texts array<long>").dropDuplicates(["host", "page"])
    # Each node of a page, with a null text and the number of its texts, and each of its texts. The root stands for the page.
    every = F.array_union(F.array(F.lit(0)), F.array_distinct("nodes"))
    here = F.transform(every, lambda n: F.struct(n.alias("node"), F.lit(None).cast("long").alias("text"), F.size(F.filter("nodes", lambda m: m == n)).alias("k")))
    texts = F.transform(F.arrays_zip("nodes", "texts"), lambda x: F.struct(x["nodes"].alias("node"), x["texts"].alias("text"), F.lit(1).alias("k")))
    counted = pages.select("host", F.explode(F.concat(here, texts)).alias("x")).groupBy("host", "x.node", "x.text").agg(F.count("*").alias("n"), F.sum("x.k").alias("k"))
    counted = settle(counted.filter((F.col("n") >= EVIDENCE * CONSTANT) | F.col("text").isNull()))  # fewer are constant nowhere
    of_node = counted.filter("text IS NULL").select("host", "node", F.col("n").alias("pages"), "k")
    of_host = of_node.filter("node = 0").select("host", F.col("pages").alias("host_pages"))
    found = counted.filter("text IS NOT NULL").select("host", "node", "text", "n").join(of_node, ["host", "node"])
    found = settle(found.filter((F.col("pages") >= EVIDENCE) & (F.col("n") >= CONSTANT * F.col("pages"))).select("host", "node", "text", "n"))
    # Nodes that have other texts than the constant ones on at least half of the host's pages.
    rest = of_node.join(found.groupBy("host", "node").agg(F.sum("n").alias("same")), ["host", "node"], "left").join(of_host, "host")
    slots = rest.filter(2 * (F.col("k") - F.coalesce("same", F.lit(0))) >= F.col("host_pages")).groupBy("host").agg(F.to_json(F.sort_array(F.collect_list("node"))).alias("varying"))
    firm = (F.col("host_pages") >= ARTICLE_EVIDENCE) & (F.col("n") >= CONSTANT * F.col("host_pages"))
    same = found.join(of_host, "host").groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("node", "text", firm.alias("firm"))))).alias("constants"))
    return of_host.select("host").join(same, "host", "left").join(slots, "host", "left")


def _meet(hosted: DataFrame, by_host: DataFrame, broadcast: bool, salts: int) -> DataFrame:
    if broadcast:
        return hosted.join(F.broadcast(by_host), "host", "left")
    copies = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(copies, ["host", "salt"], "left")


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, salts: int = 32) -> DataFrame:
    """page_id, url, text, n_chars."""
    small_batches(pages.sparkSession, 200)
    hosted = with_parts(pages.select("page_id", "url", "html")).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "host")

    def small(by_host: DataFrame, *columns: str) -> bool:
        size = sum(F.coalesce(F.length(c), F.lit(0)) for c in columns)
        return by_host.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= broadcast_bytes

    induced = settle(templates(hosted))
    met = _meet(hosted, induced, small(induced, "template"), salts)
    wrappers = settle(induced.join(constants(met.select("host", "html", "template")), "host", "left"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Wrapper | None] = {}
        for batch in batches:
            texts = []
            for host, page, raw, same, slots in zip(batch["host"], batch["html"], batch["template"], batch["constants"], batch["varying"], strict=True):
                if host not in known:
                    if len(known) > 500:
                        known.clear()
                    known[host] = Wrapper(raw, same, slots) if raw else None
                texts.append(main_text(page, known[host]))
            yield batch[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    met = _meet(hosted, wrappers, small(wrappers, "template", "constants", "varying"), salts)
    return met.select("page_id", "url", "html", "host", "template", "constants", "varying").mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
