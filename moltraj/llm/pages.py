"""Main text of web pages by template deduction over equivalence classes.

A page is read into tokens: the paths of its block elements, and each text block with its path. Tokens of one host that
occur equally often on every page have the same occurrence vector; vectors are compared by fingerprints that add up in
any order, so a host's pages never meet in one task. Tokens on over half of a host's pages are grouped into classes by
their vector. A class is valid if every token of it is nested in a token of a valid class, up to the root; valid classes
nest into the host's template. Its constant text blocks are taken from the text that its elements hold; descending from
the root through elements that hold nearly all of what is left, outside menus, adverts and the like, gives the container
of the article (where nothing is left, as on a host of exact copies, constants count). What fills the template's slots
in there is extracted: its constant blocks are dropped outside the container, and inside it too if they are on
EVERYWHERE of at least 2 * MIN_PAGES pages and make up less than half of the page's text there, as near copies share
text that is no template. Hosts with fewer than MIN_PAGES pages give no vectors to compare; their pages are descended
one by one, as are pages without their host's container. Only the container and the constants travel to a host's pages.

Words in classes, ids and roles mark menus, adverts and the like, but not the article itself: the article or main
element that holds the most text is freed with all elements around it. Without any such element, those that hold nearly
all text are freed, unless their names say nothing else (`comments`, not `layout has-sidebar`).

Null and empty pages give an empty text, pages of any length are read whole, null and odd addresses share a host of
their own, repeated rows are handled one by one, an empty table gives an empty result, other columns are not read.
Unclosed and stray tags are tolerated.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.llm.shared import arrow_map, table, text_or_empty, written
from moltraj.scale import lookup_join

MIN_PAGES = 3
#: Share of the text that a container's child must hold to be descended into.
DOMINANT = 0.9
#: Share of a host's pages that a constant block inside the container must be on to be dropped.
EVERYWHERE = 0.9

#: Element names of HTML by their role, and words in classes, ids and roles that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
ASIDE = frozenset("nav footer aside form script style noscript template iframe head title button select textarea svg menu dialog object canvas".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement adslot banner sponsor sponsored promo promotion menu navbar nav navigation breadcrumb breadcrumbs "
    "sidebar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login comment comments disqus reply "
    "replies respond share sharing social related recommended footer masthead toolbar widget pagination pager search complementary contentinfo".split()
)
ITEMS = frozenset("li dt dd tr td th option".split())
CONTENT = frozenset(("article", "main"))

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(?:>|\Z)")
NAMED = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|\Z)", re.I)
SPACE = re.compile(r"\s+")


class Block:
    """One text block: its path, its text, whether it lies in a menu, an advert or the like, and the elements around it
    that are marked by words or are articles."""

    __slots__ = ("path", "text", "aside", "marks", "articles")

    def __init__(self, path: tuple[str, ...], text: str, aside: bool, marks: list[Element], articles: list[Element]):
        self.path, self.text, self.aside, self.marks, self.articles = path, text, aside, marks, articles


class Element:
    """`marked`: 0, 1 if some words of its attributes mark it as no article, 2 if all do. `above`: marked elements from it up."""

    __slots__ = ("name", "label", "aside", "marked", "above")

    def __init__(self, name: str, label: str, aside: bool, marked: int, above: list[Element]):
        self.name, self.label, self.aside, self.marked = name, label, aside, marked
        self.above = [*above, self] if marked else above


def labelled(name: str, attributes: str) -> tuple[str, int, bool]:
    """The element's name with its class, how its words mark it as no article, and whether it is hidden."""
    if not attributes:
        return name, 0, False
    label, marked, hidden = name, 0, False
    for key, value in NAMED.findall(attributes):
        value = value.strip("\"'").lower()
        if key.lower() == "hidden" or key.lower() == "aria-hidden":
            hidden |= value != "false" and name != "body"
            continue
        words = [word for word in re.split(r"[^a-z0-9]+", value) if word]
        if name not in ("html", "body") and not MARKS.isdisjoint(words):
            marked = max(marked, 2 if MARKS.issuperset(words) else 1)
        if key.lower() == "class" and words:
            label = f"{name}.{words[0]}"
    return label, marked, hidden


class Reader:
    """Reads one page into blocks and element paths."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.elements: dict[tuple[str, ...], int] = defaultdict(int)
        self.stack: list[Element] = []
        self.parts: list[str] = []
        self.plain = 0
        self.linked = 0
        self.read(page)

    def path(self) -> tuple[str, ...]:
        return tuple(e.label for e in self.stack if e.name not in INLINE)

    def flush(self) -> None:
        if not self.parts:
            return
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            names = [e.name for e in self.stack]
            link_item = self.linked and not self.plain and not ITEMS.isdisjoint(names) and "article" not in names and "main" not in names
            aside = bool(link_item) or any(e.aside for e in self.stack)
            self.blocks.append(Block(self.path(), text, aside, self.stack[-1].above if self.stack else [], [e for e in self.stack if e.name in CONTENT]))
        self.parts, self.plain, self.linked = [], 0, 0

    def add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if text.strip():
            if any(e.name == "a" for e in self.stack):
                self.linked += 1
            else:
                self.plain += 1

    def close(self, name: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].name == name:
                if name not in INLINE:
                    self.flush()
                del self.stack[at:]
                return
            if name in INLINE and self.stack[at].name not in INLINE:
                return

    def open(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self.flush()
            if name in ITEMS or name == "p" or name in ("div", "ul", "ol", "table", "section", "article", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "form", "nav", "aside", "header", "main", "hr"):
                self.end_implied(name)
        label, marked, hidden = labelled(name, attributes)
        aside = hidden or name in ASIDE or (name == "header" and CONTENT.isdisjoint({e.name for e in self.stack}))
        self.stack.append(Element(name, label, aside, marked, self.stack[-1].above if self.stack else []))
        if name not in INLINE:
            self.elements[self.path()] += 1

    def free_article(self) -> None:
        """Make blocks in marked elements asides, except for the elements that hold the article itself."""
        held: dict[Element, int] = defaultdict(int)
        total = 0
        for block in self.blocks:
            if not block.aside:
                total += len(block.text)
                for element in {*block.marks, *block.articles}:
                    held[element] += len(block.text)
        articles = [element for element in held if element.name in CONTENT]
        clear = [element for element in articles if not element.above]
        around = [element for element in articles if not element.marked and held[element] >= DOMINANT * total]
        half = [element for element in articles if 2 * held[element] >= total]
        if candidates := around or clear or [e for e in articles if not e.marked] or half:
            free = set(max(candidates, key=held.__getitem__).above)
        elif not articles:
            free = {element for element in held if element.marked == 1 and held[element] >= DOMINANT * total}
        else:
            free = set()
        for block in self.blocks:
            block.aside = block.aside or any(element not in free for element in block.marks)

    def end_implied(self, name: str) -> None:
        """A block element ends an open paragraph, an item the item before it."""
        for at in range(len(self.stack) - 1, -1, -1):
            open_name = self.stack[at].name
            if open_name == "p" or (name in ITEMS and open_name == name):
                del self.stack[at:]
                return
            if open_name not in INLINE:
                return

    def read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            next_tag = page.find("<", at)
            if next_tag < 0:
                self.add(page[at:])
                break
            if next_tag > at:
                self.add(page[at:next_tag])
            if match := COMMENT.match(page, next_tag):
                at = match.end()
                continue
            match = TAG.match(page, next_tag)
            if not match:
                self.add("<")
                at = next_tag + 1
                continue
            at = match.end()
            closing, name, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
            name = name.lower()
            if closing:
                self.close(name)
            elif name in ("br", "hr"):
                self.parts.append(" ") if name == "br" else self.flush()
            elif name in RAW:
                end = re.compile(f"</{name}", re.I).search(page, at)
                at = end.start() if end else size
                after = page.find(">", at)
                at = size if after < 0 else after + 1
            elif name not in VOID:
                self.open(name, attributes)
        self.flush()
        self.free_article()


def token(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) >> 1


def page_tokens(page: str) -> list[tuple[int, int, str, int, int]]:
    """(token, its parent's token, path of an element or empty, occurrences, text outside asides in and below it)."""
    read = Reader(page)
    size: dict[tuple[str, ...], int] = defaultdict(int)
    texts: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
    for block in read.blocks:
        found = texts[(token("text", *block.path, block.text), token("path", *block.path))]
        found[0] += 1
        if not block.aside:
            found[1] += len(block.text)
            for end in range(len(block.path) + 1):
                size[block.path[:end]] += len(block.text)
    rows = [(token("path", *path), token("path", *path[:-1]), "/".join(path), n, size[path]) for path, n in read.elements.items()]
    rows.append((token("path"), -1, "", 1, size[()]))
    rows += [(text, parent, None, n, chars) for (text, parent), (n, chars) in texts.items()]
    return rows


def slots_of(template: list[dict]) -> dict:
    """The container of a template, and its constant blocks: all, and those that are dropped inside the container."""
    elements = {node["token"]: node for node in template if node["path"] is not None}
    constant = [node for node in template if node["path"] is None]
    whole = {node["path"]: node["chars"] for node in elements.values()}
    chars = dict(whole)
    for node in constant:
        at = elements.get(node["parent"])
        while at:
            chars[at["path"]] -= node["chars"]
            at = elements.get(at["parent"])
    return {
        "container": main_container(chars if chars.get("") else whole), "constant": [node["token"] for node in constant],
        "everywhere": [node["token"] for node in constant if node["everywhere"]],
    }


def main_text(page: str, slots: dict | None) -> str:
    """The blocks of the article, joined by line feeds."""
    blocks = [block for block in Reader(page).blocks if not block.aside]
    container, constant, everywhere = (slots["container"], set(slots["constant"]), set(slots["everywhere"])) if slots else ("", set(), set())
    filled = [b for b in blocks if token("text", *b.path, b.text) not in constant] if constant else blocks
    depth = container.count("/") + 1
    if not container or not any("/".join(b.path[:depth]) == container for b in blocks):
        shares: dict[str, int] = defaultdict(int)
        for block in filled:
            for end in range(len(block.path) + 1):
                shares["/".join(block.path[:end])] += len(block.text)
        container = main_container(shares)
        depth = container.count("/") + 1
    if not container:
        return "\n".join(block.text for block in filled)
    inside = [b for b in blocks if "/".join(b.path[:depth]) == container]
    fixed = {b for b in inside if token("text", *b.path, b.text) in everywhere} if everywhere else set()
    if 2 * sum(len(b.text) for b in fixed) >= sum(len(b.text) for b in inside):
        fixed = set()
    above, held = container.rpartition("/")[0], {b.text for b in inside}
    beside = {b for b in filled if titles(b, above, depth) and b.text not in held}
    within = set(inside) - fixed | beside
    return "\n".join(block.text for block in blocks if block in within)


def titles(block: Block, above: str, depth: int) -> bool:
    """Whether the block is a first-level heading beside the container."""
    return block.path[-1:] != () and block.path[-1].partition(".")[0] == "h1" and "/".join(block.path[: depth - 1]) == above


def element(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def main_container(chars: dict[str, int]) -> str:
    """The path reached from the root by entering whatever child holds the DOMINANT share, but not single blocks."""
    children: dict[str, list[str]] = defaultdict(list)
    for path in chars:
        if path:
            children[path.rpartition("/")[0]].append(path)
    at = ""
    while chars.get(at):
        best = max(children[at], key=lambda path: (chars[path], path), default=None)
        if best is None or chars[best] < DOMINANT * chars[at] or element(best) in SINGLE:
            break
        at = best
        if element(at) in CONTENT:
            break
    return at


SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr pre blockquote ul ol dl dt dd table tbody".split())


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def site_templates(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """`_host` and `_template`: the nodes (token, path, chars) of the host's valid classes.

    A page has a bounded number of tokens and a node is on over half of the pages, so a template is about twice the
    tokens of a mean page at most, however many pages the host has.
    """
    schema = "_host string, page long, token long, parent long, path string, n long, chars long"

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            (host, name, *row)
            for host, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for row in page_tokens(text)
        ]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["_host", "page", "token", "parent", "path", "n", "chars"]
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], names=names)

    source = pages.select(host_of(url).alias("_host"), F.xxhash64(key, url).alias("page"), text_or_empty(page).alias("_html"))
    cell = F.xxhash64("page", "n")
    tokens = written(
        arrow_map(source, convert, schema)
        .groupBy("_host", "token")
        .agg(
            F.count("*").alias("support"), F.sum(cell.bitwiseAND(F.lit((1 << 31) - 1))).alias("v1"), F.sum(F.shiftrightunsigned(cell, 33)).alias("v2"),
            F.max("parent").alias("parent"), F.max("path").alias("path"), F.sum("chars").alias("chars"),
        )
    )
    root = tokens.where(F.col("path") == "").select("_host", F.col("support").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    frequent = lookup_join(tokens, root, ["_host"], salt_by=["token"]).where(2 * F.col("support") > F.col("pages"))
    everywhere = ((F.col("support") >= EVERYWHERE * F.col("pages")) & (F.col("pages") >= 2 * MIN_PAGES)).alias("everywhere")
    node = F.struct("token", "parent", "path", "chars", everywhere)
    classes = frequent.groupBy("_host", "support", "v1", "v2").agg(F.collect_list(node).alias("nodes"))
    ordered = classes.groupBy("_host").agg(F.sort_array(F.collect_list(F.struct("support", "v1", "v2", "nodes")), asc=False).alias("classes"))
    return arrow_map(ordered, nested, "_host string, _template array<struct<token:long,parent:long,path:string,chars:long,everywhere:boolean>>")


def nested(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Leave out classes with a token whose parent is in no class that is left, until all are nested."""
    templates = []
    for classes in batch.column(1).to_pylist():
        left, before = [group["nodes"] for group in classes], None
        while before != len(left):
            before, valid = len(left), {-1} | {node["token"] for group in left for node in group}
            left = [group for group in left if all(node["parent"] in valid for node in group)]
        nodes = [node for group in left for node in group]
        templates.append(nodes)
    kind = pa.list_(pa.struct([("token", pa.int64()), ("parent", pa.int64()), ("path", pa.string()), ("chars", pa.int64()), ("everywhere", pa.bool_())]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(templates, kind)], names=["_host", "_template"])


SLOTS = "struct<container:string,constant:array<long>,everywhere:array<long>>"


def site_slots(templates: DataFrame) -> DataFrame:
    """`_host` and `_slots`: what the host's pages need of its template."""

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.struct([("container", pa.string()), ("constant", pa.list_(pa.int64())), ("everywhere", pa.list_(pa.int64()))])
        found = pa.array([slots_of(template) for template in batch.column(1).to_pylist()], kind)
        return pa.RecordBatch.from_arrays([batch.column(0), found], names=["_host", "_slots"])

    return arrow_map(templates, convert, f"_host string, _slots {SLOTS}")


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """`key`, `url` and `text` of every row."""
    slots = written(site_slots(site_templates(pages, key, url, page)))
    source = pages.select(F.col(key), F.col(url), text_or_empty(page).alias("_html"), host_of(url).alias("_host"))
    joined = lookup_join(source, slots, ["_host"], "left", salt_by=[key], weight=F.size("_slots.constant") + 1)

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(text, found) for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[key, url, "text"])

    kinds = dict(pages.dtypes)
    return arrow_map(joined.select(key, url, "_html", "_slots"), convert, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string")


def op3_template_slots(spark: SparkSession, sf: str) -> DataFrame:
    return main_texts(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))
