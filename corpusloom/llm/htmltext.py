"""Main text of web pages: wrappers inferred per host as union-free regular expressions over tokens."""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.lineage import stored

# Elements by what they mean for the main text.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea option datalist".split())
CHROME = frozenset("nav footer aside form button menu dialog fieldset label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCKS - {"body", "html"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = frozenset("p li dt dd td th blockquote pre figcaption caption span b i em strong a code font small u s q cite".split())
PLAIN_BOXES = frozenset("div section table tbody tr td ul ol dl center span".split())
CHROME_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments reply replies respond disqus discussion pager pagination toc toolbar copyright legal skip".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog alertdialog".split())
MAIN = ("article", "main")
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "math", "select", "canvas", "audio", "video", "datalist")

#: Elements nested deeper are read as children of the last one within it, as browsers do at a limit of their own.
DEPTH = 150
#: Up to so many like siblings without a class are told apart by position, if every page has as many.
APART = 8
#: A text is the template's if so many different pages have it in the same slot and no page another.
PAGES = 4

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_known: dict[tuple[str, str], tuple[str, str]] = {}


def _kind(tag: str, raw: str) -> str:
    """What tells an element from its siblings: its mark, tag, classes and id, numbers in them as 0.

    The mark is "!" for what is never read, "-" for menus and the like by
    element or role, "~" for what a class or id merely calls so.
    """
    attrs = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(raw)} if raw else {}
    names = sorted(set(attrs.get("class", "").split()))
    mark = ""
    if tag in HIDDEN:
        mark = "!"
    elif tag in CHROME or attrs.get("role", "") in CHROME_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        mark = "-"
    elif tag == "header":
        mark = "~"
    elif tag in LEAVES or tag in MAIN:
        mark = "~" if not CHROME_WORDS.isdisjoint([*names, attrs.get("id", "")]) else ""
    elif tag not in HEADINGS and tag not in ("html", "body"):
        mark = "~" if not CHROME_WORDS.isdisjoint(_SPLIT.split(" ".join([*names, attrs.get("id", "")]))) else ""
    return mark + tag + _DIGITS.sub("0", "".join(f".{n}" for n in names) + (f"#{attrs['id']}" if attrs.get("id") else ""))


def _describe(tag: str, raw: str) -> tuple[str, str]:
    """(tag in lower case, kind), kept for tags that come again."""
    low = raw.lower()
    plain = not ("class" in low or "id" in low or "role" in low)
    key = (tag, "" if plain else raw)
    if key not in _known:
        if len(_known) > 50_000:
            _known.clear()
        _known[key] = (tag.lower(), _kind(tag.lower(), key[1]))
    return _known[key]


def tag_of(kind: str) -> str:
    return re.split(r"[.#]", kind.lstrip("!-~"), maxsplit=1)[0] if kind != "#" else "#"


class Element:
    __slots__ = ("tag", "kind", "kids")

    def __init__(self, tag: str, kind: str):
        self.tag, self.kind, self.kids = tag, kind, []


def parse(page: str) -> Element:
    """The page's tokens as a tree: elements, and texts as strings between them.

    Elements that the page leaves open are closed where the next one ends
    them; what is never read (scripts and the like) is passed over.
    """
    root = Element("", "")
    stack, deeper = [root], []
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        close, tag, raw = m.group(1, 2, 3)
        if tag is None:
            close, tag, raw = m.group(4, 5, 6)
            if tag is None:
                continue
        if close:
            tag = tag.lower()
            if deeper and tag in deeper:
                del deeper[len(deeper) - 1 - deeper[::-1].index(tag) :]
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    deeper.clear()
                    break
            else:
                if tag == "p":
                    stack[-1].kids.append(Element("p", "p"))
            continue
        tag, kind = _describe(tag, raw)
        if tag in CLOSES_P:
            # a block ends an open paragraph and the inline elements in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in BLOCKS:
                    if stack[i].tag == "p":
                        del stack[i:]
                        deeper.clear()
                    break
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    deeper.clear()
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "tbody", "menu"):
                    break
        if kind[0] == "!" and tag in _ENDS and not raw.endswith("/"):
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else n
            continue
        element = Element(tag, kind)
        stack[-1].kids.append(element)
        if tag in VOID or raw.endswith("/"):
            continue
        if len(stack) > DEPTH:
            deeper.append(tag)
        else:
            stack.append(element)
    return root


class Node:
    """An element (or text slot) of a wrapper: what its instances on all pages have in common.

    ``kids`` has, for each kind of child, one node, or one for each position
    where all instances have equally many; ``many`` the kinds that repeat;
    ``seen`` how many instances have the kind (fewer than ``n``: optional);
    ``next`` which kinds follow which. A text slot has its characters, those
    in links, the text's hash (-1 once texts differ) and up to PAGES pages.
    """

    __slots__ = ("n", "kids", "many", "seen", "next", "chars", "linked", "text", "pages")

    def __init__(self) -> None:
        self.n, self.kids, self.many, self.seen, self.next = 0, {}, set(), {}, set()
        self.chars = self.linked = 0
        self.text, self.pages = None, []

    def read(self, text: str, linked: bool, page: int) -> None:
        self.n += 1
        self.chars += len(text)
        if linked:
            self.linked += len(text)
        if self.text != -1:
            got = zlib.crc32(text.encode("utf-8", "replace"))
            if self.text is None:
                self.text = got
            elif self.text != got:
                self.text, self.pages = -1, []
                return
            if page not in self.pages:
                self.pages = sorted([*self.pages, page])[:PAGES]

    def add(self, kids: list, linked: bool, page: int) -> None:
        """Aligns one more instance with this node's expression."""
        self.n += 1
        groups: dict[str, list] = {}
        last = ""
        for kid in kids:
            if isinstance(kid, str):
                kid = kid.strip()
                if not kid:
                    continue
                kind = "#"
            else:
                kind = kid.kind
            groups.setdefault(kind, []).append(kid)
            self.next.add((last, kind))
            last = kind
        for kind, found in groups.items():
            self.seen[kind] = self.seen.get(kind, 0) + 1
            nodes = self._nodes(kind, len(found))
            for i, kid in enumerate(found):
                node = nodes[0] if len(nodes) == 1 else nodes[i]
                if kind == "#":
                    node.read(kid, linked, page)
                else:
                    node.add(kid.kids, linked or kid.tag == "a", page)

    def _nodes(self, kind: str, count: int) -> list["Node"]:
        """The nodes of a kind, folded into one repeated node where counts differ."""
        nodes = self.kids.get(kind)
        apart = kind in PLAIN_BOXES and count <= APART
        if nodes is None:
            nodes = self.kids[kind] = [Node() for _ in range(count if apart else 1)]
            if count > 1 and not apart:
                self.many.add(kind)
        elif kind not in self.many and len(nodes) != count:
            for other in nodes[1:]:
                nodes[0].merge(other)
            del nodes[1:]
            self.many.add(kind)
        return nodes

    def merge(self, other: "Node") -> None:
        """Aligns two expressions: the order in which pages come does not matter to the result."""
        self.n += other.n
        self.chars += other.chars
        self.linked += other.linked
        if self.text is None:
            self.text, self.pages = other.text, other.pages
        elif other.text is not None:
            if self.text != other.text or self.text == -1:
                self.text, self.pages = -1, []
            else:
                self.pages = sorted({*self.pages, *other.pages})[:PAGES]
        self.next |= other.next
        for kind, nodes in other.kids.items():
            self.seen[kind] = self.seen.get(kind, 0) + other.seen[kind]
            if kind in other.many or kind not in self.kids:
                mine = self.kids.setdefault(kind, [])
                if kind in other.many:
                    self.many.add(kind)
                    mine = self.kids[kind] = mine or [Node()]
                    for extra in mine[1:]:
                        mine[0].merge(extra)
                    del mine[1:]
                else:
                    mine += [Node() for _ in nodes]
            else:
                mine = self._nodes(kind, len(nodes)) if kind not in self.many else self.kids[kind]
            for i, node in enumerate(nodes):
                mine[0 if len(mine) == 1 else i].merge(node)

    def dump(self) -> list:
        return [self.n, self.chars, self.linked, self.text, self.pages, sorted(self.many), sorted(map(list, self.next)), {k: [self.seen[k], [x.dump() for x in v]] for k, v in self.kids.items()}]

    @staticmethod
    def load(raw: list) -> "Node":
        node = Node()
        node.n, node.chars, node.linked, node.text, node.pages = raw[:5]
        node.many, node.next = set(raw[5]), {tuple(x) for x in raw[6]}
        node.seen = {k: v[0] for k, v in raw[7].items()}
        node.kids = {k: [Node.load(x) for x in v[1]] for k, v in raw[7].items()}
        return node

    def template(self) -> bool:
        return self.text not in (None, -1) and len(self.pages) >= PAGES


def learn(node: Node, page: str) -> None:
    node.add(parse(page).kids, False, zlib.crc32(page.encode("utf-8", "replace")))


def _ordered(node: Node) -> list[list[str]]:
    """Kinds of children as they follow one another; kinds that come in either order are one group."""
    after: dict[str, list[str]] = {k: [] for k in node.kids}
    for a, b in sorted(node.next):
        if a:
            after[a].append(b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    open_, groups = [], []
    for start in sorted(after):
        if start in index:
            continue
        work = [(start, iter(after[start]))]
        index[start] = low[start] = len(index)
        open_.append(start)
        while work:
            k, it = work[-1]
            for b in it:
                if b not in index:
                    index[b] = low[b] = len(index)
                    open_.append(b)
                    work.append((b, iter(after[b])))
                    break
                if b in open_:
                    low[k] = min(low[k], index[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[k])
                if low[k] == index[k]:
                    cut = open_.index(k)
                    groups.append(sorted(open_[cut:]))
                    del open_[cut:]
    return groups[::-1]


def written(node: Node) -> str:
    """The wrapper as a union-free expression: tags, # for a slot, ( )? optional, ( )+ repeated.

    Kinds that pages have in different orders are a repeated group of
    optional items.
    """

    def item(kind: str, x: Node) -> str:
        return "#" if kind == "#" else " ".join(filter(None, (f"<{kind}>", written(x), f"</{tag_of(kind)}>")))

    out = []
    for group in _ordered(node):
        if len(group) > 1:
            parts = []
            for kind in group:
                whole = Node()
                for x in node.kids[kind]:
                    whole.merge(x)
                parts.append(f"( {item(kind, whole)} )?")
            out.append(f"( {' '.join(parts)} )+")
            continue
        kind = group[0]
        one = " ".join(item(kind, x) for x in node.kids[kind])
        if kind in node.many:
            one = f"( {one} )+"
        out.append(f"( {one} )?" if node.seen[kind] < node.n else one)
    return " ".join(out)


def rules(root: Node) -> dict:
    """What to read of a page: {"m": main region, "t": template text, "k": kept although a class calls it chrome, "c": rules below}.

    The main region is the article element (else the main element) that holds
    most of the host's plain text, else the deepest box with four fifths of
    it. A box that a class or id calls a header, notice and so on is read all
    the same if it holds an article or main element, or a heading and
    paragraphs whose text changes from page to page.
    """
    plain: dict[int, int] = {}
    keeps: set[int] = set()
    traits: dict[int, tuple[bool, bool, bool]] = {}

    def weigh(node: Node, tag: str) -> None:
        total = 0 if node.template() else node.chars - node.linked
        main, title, prose = tag in MAIN, False, False
        for kind, nodes in node.kids.items():
            own = tag_of(kind)
            for x in nodes:
                if kind[0] == "-" or kind[0] == "!":
                    continue
                weigh(x, own)
                m, t, p = traits[id(x)]
                if own == "h1":
                    t = any(not s.template() for s in x.kids.get("#", []))
                if own == "p":
                    p = any(not s.template() for s in x.kids.get("#", []))
                if kind[0] == "~":
                    if not (m and own not in MAIN or t and p):
                        continue
                    keeps.add(id(x))
                main, title, prose = main or m, title or t, prose or p
                total += plain[id(x)]
        plain[id(node)], traits[id(node)] = total, (main, title, prose)

    weigh(root, "")
    best: dict[str, tuple] = {}
    most = plain[id(root)]

    def search(node: Node, depth: int, path: str) -> None:
        for kind, nodes in sorted(node.kids.items()):
            for i, x in enumerate(nodes):
                if id(x) not in plain or kind == "#" or (kind[0] == "~" and id(x) not in keeps):
                    continue
                tag, here = tag_of(kind), f"{path}/{kind}:{i}"
                if tag in MAIN and plain[id(x)]:
                    best[tag] = max(best.get(tag, (-1,)), (plain[id(x)], -depth, here, id(x)))
                elif plain[id(x)] >= 0.8 * most and most and tag in ("html", "body", "div", "section", "td", "center", "article", "main"):
                    best["box"] = max(best.get("box", (-1,)), (depth, plain[id(x)], here, id(x)))
                search(x, depth + 1, here)

    search(root, 0, "")
    choice = next((best[t][3] for t in (*MAIN, "box") if t in best), None)
    by_box = choice is not None and not any(t in best for t in MAIN)

    def flags(node: Node) -> dict | None:
        below = {}
        for kind, nodes in node.kids.items():
            got = [flags(x) for x in nodes]
            if any(got):
                below[kind] = got
        own = {k: 1 for k, yes in (("m", id(node) == choice), ("t", by_box and node.template()), ("k", id(node) in keeps)) if yes}
        return own | ({"c": below} if below else {}) or None

    return flags(root) or {}


def extract(page: str | None, rule: dict) -> str:
    """Text of the slots of ``page`` that lie in the wrapper's main region, block by block.

    A page that lacks that region, or has no text in it, is read by its own
    article or main element, else whole but for menus and the like.
    """
    if not page:
        return ""
    root = parse(page)
    return _read(root, rule) or _read(root, {}) or _read(root, {"m": 1} | rule)


def _read(root: Element, rule: dict) -> str:
    own = not rule  # without rules: article, else main element
    if own:
        want = _largest(root)
        if want is None:
            return ""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        block = "".join(run)
        if "&" in block:
            block = entities.unescape(block)
        block = _SPACE.sub(" ", block).strip()
        if block:
            blocks.append(block)
        run.clear()

    def walk(kids: list, rule: dict | None, inside: bool, head: bool, titled: bool) -> None:
        below = rule.get("c") if rule else None
        spot: dict[str, int] = {}
        counts: dict[str, int] = {}
        if below:
            for kid in kids:
                if not isinstance(kid, str):
                    counts[kid.kind] = counts.get(kid.kind, 0) + 1
        for kid in kids:
            if isinstance(kid, str):
                if inside and (titled or not head):
                    t = below.get("#") if below else None
                    if not (t and t[0] and t[0].get("t")):
                        run.append(kid)
                continue
            kind, tag = kid.kind, kid.tag
            sub = None
            if below and kind in below:
                i = spot[kind] = spot.get(kind, -1) + 1
                options = below[kind]
                sub = options[0] if len(options) == 1 else options[i] if counts[kind] == len(options) else None
            if kind[0] == "-" or kind[0] == "!":
                if tag in BLOCKS:
                    end()
                continue
            kept = sub is not None and (sub.get("k") or sub.get("m"))
            in_head = head
            if kind[0] == "~" and not kept:
                if not (tag == "header" and inside and kind == "~header"):
                    if tag in BLOCKS:
                        end()
                    continue
                in_head = True  # of an article's own header the headings are read
            if tag == "br":
                run.append(" ")
                continue
            if tag in BLOCKS:
                end()
            walk(kid.kids, sub, inside or bool(sub and sub.get("m")) or (own and kid is want), in_head, titled or tag in HEADINGS)
            if tag in BLOCKS:
                end()

    walk(root.kids, rule, bool(rule.get("m")), False, False)
    end()
    return "\n\n".join(blocks)


def _largest(root: Element) -> Element | None:
    """The page's article element with most text, else its main element."""
    best: dict[str, tuple[int, int, Element]] = {}
    count = 0

    def size(e: Element) -> int:
        nonlocal count
        total = 0
        for kid in e.kids:
            if isinstance(kid, str):
                total += len(kid.strip())
            elif kid.kind[0] not in "-!~":
                total += size(kid)
        if e.tag in MAIN and total:
            count += 1
            best[e.tag] = max(best.get(e.tag, (-1, 0, e)), (total, -count, e), key=lambda x: x[:2])
        return total

    size(root)
    return next((best[t][2] for t in MAIN if t in best), None)


def _learner(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A wrapper for each host among this task's pages; when ``held`` hosts are held they are passed on."""
        hosts: dict[str, Node] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array([json.dumps(w.dump()) for w in hosts.values()], pa.string())], names=["host", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = page.as_py()
                if page:
                    if host not in hosts:
                        if len(hosts) >= held:
                            yield out()
                            hosts.clear()
                        hosts[host] = Node()
                    learn(hosts[host], page)
        yield out()

    return run


def _joiner(last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Wrappers, ordered by host, of which those of a host become one."""
        host, node = None, None

        def out() -> pa.RecordBatch:
            if last:
                return pa.RecordBatch.from_arrays(
                    [pa.array([host], pa.string()), pa.array([json.dumps(rules(node))], pa.string()), pa.array([written(node)], pa.string()), pa.array([node.n], pa.int64())], names=["host", "rules", "wrapper", "pages"]
                )
            return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(node.dump())], pa.string())], names=["host", "wrapper"])

        for batch in batches:
            for h, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if node is not None and h != host:
                    yield out()
                    node = None
                if node is None:
                    host, node = h, Node()
                node.merge(Node.load(json.loads(raw.as_py())))
        if node is not None:
            yield out()

    return run


def _host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, held: int = 256, salts: int = 32) -> DataFrame:
    """host, rules (what to read, JSON), wrapper (the expression), pages.

    Each task aligns its own pages of a host one after another into one
    expression; the tasks' expressions of a host are aligned with each other,
    first in ``salts`` parts, so a host with a third of all pages is learnt by
    all tasks. The result does not depend on the order of pages. An
    expression grows with the kinds of elements (tags, classes and ids, without
    their numbers) that a host has, not with its pages; a task holds at most
    ``held`` of them.
    """
    rows = pages.select(_host().alias("host"), F.col("html").cast("string").alias("html"))
    local = rows.mapInArrow(_learner(held), "host string, wrapper string").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    some = local.repartition("host", "salt").sortWithinPartitions("host").select("host", "wrapper").mapInArrow(_joiner(False), "host string, wrapper string")
    return some.repartition("host").sortWithinPartitions("host").mapInArrow(_joiner(True), "host string, rules string, wrapper string, pages long")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in batches:
        text = []
        for page, raw in zip(batch.column(2), batch.column(3).to_pylist()):
            if raw not in known:
                if len(known) > 256:
                    known.clear()
                known[raw] = json.loads(raw or "{}")
            text.append(extract(page.as_py(), known[raw]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    A null or empty page has an empty text; a null url is the host "". Rows
    that repeat get a row each; other columns are ignored.
    """
    wrappers = stored(infer_wrappers(pages).select("host", "rules"), "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), _host().alias("host"))
    found = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "rules").mapInArrow(_apply, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
