"""Main text of web pages by template deduction over the pages of a host.

1. Tokens are the elements of a page, told apart by their path of tags, classes and ids, and its texts in their
   place. A token's occurrence vector says how often each page of the host has it; tokens with equal vectors form
   an equivalence class. Vectors are compared by a sum over pages of count times page hash, so they come from one
   aggregation with partial sums, whatever a host's number of pages.
2. Classes nest: a token belongs into the innermost section around it that the page has as often, its owner. A text
   is the template's own if it has the vector of its owner, the same owner on all pages, and if all such texts of
   this owner stand in one order on every page. A class needs SUPPORT pages of different content, as fewer cannot
   tell template and content apart; and VARIES of a host's text must remain outside the template, as pages that
   differ by less are copies of one article, which show no slots.
3. The class of the page itself is the frame: the sections that every page has once. Its slot with MOST of the host's
   text outside links holds the content. Of such sections inside one another an article goes before a main part, that
   before a name, and the outermost before those in it. Sizes and vectors are of all tokens of a page, also of
   menus and adverts; only a section that is one of those itself cannot be the slot, nor one without a mark that
   leaves more than 1 - NEARLY of what may be content outside.
4. What the template does not hold stands in its slots. A block goes if all its texts are the template's, so no
   sentence loses a word. In the slot, elements that are no content by their tag, role or class go too.
5. Where a host has no such slot, or a page has nothing in it, an article or main element with LEAST of a page's text,
   or an element named as the content that has MOST of it, is the content: the one that most pages of the host have,
   or else the page's own. Without one all slots are the content, but for blocks of links outside the element that
   holds most of the text. A class only hints here, and counts beside or inside the content, not around it.

A host with fewer than SUPPORT different pages has no texts of a template, one with fewer than SUPPORT pages no slot; the
pages of that are read by 4 and 5 on their own.

Cases: null, empty and broken html give what text can be read, or an empty text; entities are decoded once;
unclosed elements end where html lets them; null urls share one host; pages that repeat repeat in the result; an
empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, own_columns, ship, skew_join, stage, table

#: Elements of html.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title template iframe svg canvas noembed noframes".split()
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
SPACED = set("td th br wbr img input".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
NO_CONTENT = set("head nav footer aside form button select option menu dialog object applet datalist".split())
#: Elements that can own words of the template.
SECTIONS = set("html body div section article main center ul ol dl table tbody figure details fieldset header footer".split())
NO_ROLE = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NO_CLASS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager search masthead topbar copyright disclaimer".split())
#: Words that hint only as a whole name or beside one of COMPANY: a section on related work is content.
UNSURE = set("related share sharing social recommended recommendations notice notices alert reply replies respond search promotion popup overlay login signup disclaimer copyright".split())
COMPANY = set("article articles area bar block box button buttons container content form group heading icon icons inner item items link links list message messages news now on outer panel post posts row section stories story text this title to tools top bottom us wrap wrapper".split())
#: Words of a name that make it tell of a state, like no-sidebar, and not of a part of the page.
STATE = set("no not non without with has have".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTENT_CLASS = set("article content entry post story body main text".split())
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "caption", "tbody", "thead", "tfoot", "tr", "legend", "summary"}
#: An element that opens ends an open one of these, looked for up to the list or table around it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
AROUND = set("ul ol dl table menu select".split())

_INSIDE = r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+){_INSIDE}>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"  # quotes that never close
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
HINTS = NO_CLASS | {"header"}
MASK = (1 << 63) - 1
#: Share of a page's text that the element named as content, or that holds most, has at least; and of the host's
#: pages that have the content's element.
MOST, PAGES = 0.6, 0.5
#: The same for an article or main element.
LEAST = 0.3
#: The same for a slot that nothing marks.
NEARLY = 0.98
#: Pages of different content that a class needs.
SUPPORT = 3
#: Share of a host's text that is not the template's at least.
VARIES = 0.2
#: Rules of hosts are broadcast below this measured size, and joined beyond.
BROADCAST_BYTES = 16 << 20


class Element:
    __slots__ = ("tag", "role", "parent", "depth", "own", "barred", "hint", "named", "out", "level", "within", "mark", "heading", "link", "text")

    def __init__(self, tag, role, parent, own=False, hint=False, named=False, level=0):
        self.tag, self.role, self.parent, self.own, self.hint, self.named, self.level = tag, role, parent, own, hint, named, level
        #: Out by tag or role, itself or something around it.
        self.barred = own or parent is not None and parent.barred
        self.out = self.barred or hint or parent is not None and parent.out
        #: The highest level and the innermost of the marked elements from here up.
        self.within = max(level, parent.within if parent else 0)
        self.mark = self if level else parent and parent.mark
        self.link = tag == "a" or parent is not None and parent.link
        self.heading = tag in HEADINGS or parent is not None and parent.heading
        self.depth, self.text = parent.depth + 1 if parent else 0, 0


def hashed(parent: int, key: str) -> int:
    return (((parent << 7) ^ (parent >> 3) ^ zlib.crc32(key.encode("utf-8", "replace"))) * 0x9E3779B97F4A7C15 + zlib.adler32(key.encode("utf-8", "replace"))) & MASK


def opened(tag: str, attributes: str, parent: Element) -> Element:
    found = {}
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = (found.get("class", "") + " " + found.get("id", "")).lower()
    words = set(WORD.findall(names))
    hints = {w for name in names.split() for w in part_words(name)} if words & HINTS else set()
    role = found.get("role", "").lower()
    #: 3 for an article, 2 for the main part, 1 for what is marked by its class only.
    level = 3 if "article" in (tag, role) else 2 if "main" in (tag, role) else int(tag in ("div", "section", "td") and bool(words & CONTENT_CLASS))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    own = tag in NO_CONTENT or role in NO_ROLE or hidden
    named = bool(hints & NO_CLASS)
    hint = named and tag not in ("html", "body", "article", "main")
    # A header is the page's unless an article is open around it.
    if not parent.within:
        own = own or tag in ("header", "noscript")
        hint = hint or (tag not in ("html", "body", "article", "main") and "header" in hints)
    key = tag + "." + ".".join(sorted(DIGITS.sub("0", names).split()))
    return Element(tag, hashed(parent.role, key), parent, own, hint, named, level)


def part_words(name: str) -> list[str]:
    """The words of a class or id up to one that makes the rest a state, without those that hint in company only."""
    words = WORD.findall(name)
    words = words[: next((i for i, w in enumerate(words) if w in STATE), len(words))]
    if any(w not in UNSURE and w not in COMPANY and w not in HINTS for w in words):
        return [w for w in words if w not in UNSURE]
    return words


def settle(elements: list[Element], sizes: list[tuple[Element, int]]) -> None:
    """Drop the hints of elements around the content: of the outermost that hold a marked element or most of the
    text, unless another marked element, out of all hints, has text besides its headings. What they hold is looked
    at again. sizes: texts outside links and their lengths."""
    whole = sum(n for _, n in sizes)
    while whole:
        left = 0
        hidden: dict[int, list] = {}
        for e, n in sizes:
            if not e.out:
                left += n
                continue
            marks: list[Element] = []
            x = e
            while x is not None:
                if x.level and not x.named:
                    marks.append(x)
                if x.hint:
                    top, below = x, len(marks)
                x = x.parent
            found = hidden.setdefault(id(top), [top, 0, {}, {}])
            found[1] += n
            for x in marks[:below]:
                found[2 if x.level > 1 else 3][id(x)] = found[2 if x.level > 1 else 3].get(id(x), 0) + n
        if not hidden:
            return
        around, size, strong, weak = max(hidden.values(), key=lambda x: (max([0, *x[2].values(), *x[3].values()]), x[1]))
        if not strong and size < MOST * whole and not (size > left and max(weak.values(), default=0) >= LEAST * whole):
            return
        over, x = set(), around
        while x is not None:
            over.add(id(x))
            x = x.parent
        kept = [0, 0, 0, 0]
        for e, n in sizes:
            # The main part's words beside a part that has the article and most of the text do not count.
            if not e.out and not e.heading and (e.within == 3 or not (strong and size >= MOST * whole and id(e.mark) in over)):
                kept[e.within] += n
        if kept[3] or kept[2] or kept[1] >= LEAST * whole:
            return
        for top, *_ in hidden.values():
            if top.role == around.role:
                top.hint = False
        for e in elements[1:]:  # parents come before children
            e.out = e.barred or e.hint or e.parent.out


def read(page: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """Elements in page order and (element, text, block number) of every text."""
    top = Element("", 1, None)
    stack, elements, texts, block, last = [top], [top], [], 0, 0

    def add(raw):
        if raw:
            texts.append((stack[-1], entities.unescape(raw), block))

    for m in TOKEN.finditer(page):
        add(page[last : m.start()])
        last = m.end()
        closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if tag is None:
            if m[1] and m[1].lower() in ("textarea", "iframe"):
                texts.append((stack[-1], " ", block))
            continue
        tag = tag.lower()
        if closing:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if at and not (tag in INLINE and any(x.tag in BLOCK for x in stack[at + 1 :])):
                del stack[at:]
        else:
            if tag in ENDS_P:
                at = len(stack) - 1
                while at and stack[at].tag in INLINE:
                    at -= 1
                if stack[at].tag == "p":
                    del stack[at:]
            if tag in ENDS:
                at = len(stack) - 1
                while at and stack[at].tag not in AROUND and stack[at].tag not in ENDS[tag]:
                    at -= 1
                if stack[at].tag in ENDS[tag]:
                    first = at
                    while stack[first - 1].tag in ENDS[tag]:
                        first -= 1
                    del stack[first:]
            if tag not in VOID and not attributes.rstrip().endswith("/") or tag in BLOCK - VOID:
                e = opened(tag, attributes, stack[-1])
                elements.append(e)
                stack.append(e)
        if tag in BLOCK:
            block += 1
        elif tag in SPACED:
            texts.append((stack[-1], " ", block))
    add(page[last:])
    if any(e.hint and not e.barred for e in elements):
        settle(elements, [(e, n) for e, text, _ in texts if not e.barred and not e.link and (n := len(text.strip()))])
    return elements, texts


def weigh(elements: list[Element], texts: list[tuple[Element, str, int]]) -> None:
    """Lengths of these texts outside links, by element."""
    for e in elements:
        e.text = 0
    for e, text, _ in texts:
        if not e.link:
            e.text += len(text.strip())
    for e in reversed(elements):  # children come after parents
        if e.parent is not None:
            e.parent.text += e.text


def shares(elements: list[Element]) -> dict[int, list]:
    """role -> [role, depth, level, share of the page's text]."""
    total, out = elements[0].text, {}
    for e in elements[1:]:
        if not e.out:
            x = out.setdefault(e.role, [e.role, e.depth, e.level, 0.0])
            x[2] = max(x[2], e.level)
            x[3] += e.text / total if total else 0
    return out


def marked_container(roles) -> int | None:
    """The marked element with the largest share, the deepest of equals. roles: (role, depth, level, share)."""
    fits = [r for r in roles if r[2] > 1 and r[3] >= LEAST or r[2] == 1 and r[3] >= MOST]
    return max(fits, key=lambda r: (r[3], r[1], -r[0]))[0] if fits else None


def core(roles) -> int | None:
    """The deepest element that holds most of the text."""
    fits = [r for r in roles if r[3] >= MOST]
    return max(fits, key=lambda r: (r[1], r[3], -r[0]))[0] if fits else None


def within(elements: list[Element], role: int | None) -> set[int]:
    """The elements of this role and all that is in them."""
    found: set[int] = set()
    for e in elements:
        if e.role == role or (e.parent is not None and id(e.parent) in found):
            found.add(id(e))
    return found


def template_blocks(texts: list[tuple[Element, str, int]], fixed: set[int]) -> set[int]:
    """The blocks in which all texts are the template's."""
    own: dict[int, bool] = {}
    for e, text, block in texts:
        if text.strip():
            own[block] = own.get(block, True) and text_token(e, text) in fixed
    return {block for block, all_ in own.items() if all_}


def joined(texts: list[tuple[Element, str, int]]) -> str:
    """The blocks of these texts, a line each."""
    blocks: list[str] = []
    now = None
    for _, text, block in texts:
        if block != now:
            blocks.append("")
            now = block
        blocks[-1] += text
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def in_slot(elements: list[Element], texts: list[tuple[Element, str, int]], slot: int, fixed: set[int]) -> str:
    """The text of the template's slot, without the template's blocks and what is no content inside the slot; what
    stands around the slot does not count."""
    inside = within(elements, slot)
    out: set[int] = set()
    for e in elements:
        if id(e) in inside and e.role != slot and (e.own or e.hint or id(e.parent) in out):
            out.add(id(e))
    shown = [x for x in texts if id(x[0]) in inside and id(x[0]) not in out]
    taken = template_blocks(shown, fixed) if fixed else set()
    return joined([x for x in shown if x[2] not in taken]) or joined(shown)


def main_text(page: str, container: int | None, fixed: set[int], slot: int | None = None) -> str:
    elements, texts = read(page)
    if slot is not None and (found := in_slot(elements, texts, slot, fixed)):
        return found
    shown = [x for x in texts if not x[0].out]
    taken = template_blocks(shown, fixed) if fixed else set()
    for slots in ([x for x in shown if x[2] not in taken], shown) if taken else (shown,):
        weigh(elements, slots)
        roles = shares(elements)
        marked = container if container in roles else marked_container(roles.values())
        if marked is None:
            middle = core(roles.values())
            inside = within(elements, middle) if middle is not None else {id(e) for e in elements}
            lists = {block for _, _, block in slots} - {block for e, text, block in slots if text.strip() and (id(e) in inside or not e.link)}
            found = [x for x in slots if x[2] not in lists]
        else:
            inside = within(elements, marked)
            found = [x for x in slots if id(x[0]) in inside]
        if any(text.strip() for _, text, _ in found):
            break  # else all of the content would be the template's
    return joined(found)


def text_token(e: Element, text: str) -> int:
    return hashed(e.role, "#" + " ".join(text.split()))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


PAGE, ELEMENT, TEXT = 0, 1, 2
#: The page itself is a token too, and the owner of what no section owns.
ROOT = 1
TOKENS = "host string, token long, kind int, owner long, place int, depth int, level int, free int, whole long, n long, text long, page long, content long"


def free(elements: list[Element]) -> set[int]:
    """Elements that can be the slot of the content: sections that are no menu or advert and in none. A form can
    stand around a whole page, so it does not count."""
    closed: set[int] = set()
    found: set[int] = set()
    for e in elements[1:]:
        if e.hint or e.own and e.tag != "form" or id(e.parent) in closed:
            closed.add(id(e))
        elif e.tag in SECTIONS and e.tag not in ("html", "body"):
            found.add(id(e))
    return found


def tokens_of(page: str) -> list[list]:
    """[token, kind, owner, place, depth, level, free, whole, count, text] of every token of a page. text is without
    links and what is no content, whole without links only; free: can be the slot, of texts how many are content."""
    elements, texts = read(page)
    texts = [(e, text, n) for e, text, n in texts if text.strip()]
    weigh(elements, texts)
    whole = {id(e): e.text for e in elements}
    weigh(elements, [x for x in texts if not x[0].out])
    found = {ROOT: [ROOT, PAGE, 0, 0, 0, 0, 0, whole[id(elements[0])], 1, elements[0].text]}
    can = free(elements)
    for e in elements[1:]:
        x = found.setdefault(e.role, [e.role, ELEMENT, 0, 0, e.depth, 0, 1, 0, 0, 0])
        x[5] = max(x[5], e.level)
        x[6] &= id(e) in can
        x[7] += whole[id(e)]
        x[8] += 1
        x[9] += 0 if e.out else e.text
    own: dict[int, list] = {}
    around: dict[int, Element] = {}
    for place, (e, text, _) in enumerate(texts):
        t = text_token(e, text)
        x = own.setdefault(t, [t, TEXT, 0, place, e.depth, 0, 0, 0, 0, 0])
        around.setdefault(t, e)
        x[6] += not e.out
        x[8] += 1
        x[9] += 0 if e.link or e.out else len(text.strip())
    for t, x in own.items():
        if t not in found:
            e = around[t]
            while e.parent is not None and not (e.tag in SECTIONS and found[e.role][8] == x[8]):
                e = e.parent
            x[2] = e.role if found[e.role][8] == x[8] else 0
            found[t] = x
    return list(found.values())


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row for each token and page. page is a hash of the row, content of the texts of the page."""

    def run(batches):
        claim("html")
        for batch in batches:
            rows = []
            for host, page_id, page in zip(*(batch.column(c).to_pylist() for c in range(3))):
                found = tokens_of(page or "")
                key = zlib.crc32(f"{page_id} {zlib.crc32((page or '').encode('utf-8', 'replace'))}".encode()) | 1
                content = sum(x[0] * x[6] for x in found if x[1] == TEXT) & MASK
                rows += [(host, *x, key, content) for x in found]
            fields = [x.split() for x in TOKENS.split(", ")]
            kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
            columns = list(zip(*rows)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [name for name, _ in fields])

    return pages.select("host", "page_id", "html").mapInArrow(run, TOKENS)


def classes(tokens: DataFrame) -> DataFrame:
    """One row for each token of a host on two pages or more: its vector, which names its class, on how many pages
    and contents it is, and its owner, null where pages do not agree."""
    vector = F.sum((F.col("n") * F.col("page")).cast("decimal(38,0)")).alias("vector")
    found = tokens.groupBy("host", "token", "kind").agg(
        F.count("*").alias("pages"), F.count_distinct("content").alias("contents"), vector, F.when(F.min("owner") == F.max("owner"), F.min("owner")).alias("owner"),
        F.max("depth").alias("depth"), F.max("level").alias("level"), F.sum("text").alias("text"), F.sum("whole").alias("whole"), F.min("free").alias("free"),
    )
    return found.filter(f"pages > 1 OR kind = {PAGE}")


def own_texts(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """(host, token, text): texts of the template. tokens by page, known: their classes."""
    firm = known.filter(f"contents >= {SUPPORT}")
    owners = firm.filter(f"kind < {TEXT}").select("host", F.col("token").alias("owner"), F.col("vector").alias("frame"))
    nested = firm.filter(f"kind = {TEXT} AND owner > 0").join(owners, ["host", "owner"]).filter("vector = frame").select("host", "token", "owner", "text")
    nested = stage(nested, "nested")
    # The texts of an owner must come in one order on all pages; an array here is one page's, also if its row repeats.
    places = tokens.filter(f"kind = {TEXT}").select("host", "page", "place", F.col("token").alias("t"), F.xxhash64("host", "token").alias("key"))
    placed = skew_join(places, nested.select(F.col("token").alias("u"), "owner", F.xxhash64("host", "token").alias("key")), "key").filter("t = u")
    turns = placed.groupBy("host", "owner", "page").agg(F.xxhash64(F.transform(F.array_sort(F.collect_set(F.struct("place", "t"))), lambda x: x["t"])).alias("turn"))
    ordered = turns.groupBy("host", "owner").agg(F.min("turn").alias("a"), F.max("turn").alias("b")).filter("a = b").select("host", "owner")
    return nested.join(ordered, ["host", "owner"]).select("host", "token", "text")


def templates(pages: DataFrame) -> DataFrame:
    """(host, slot, container, fixed array<long>) of hosts that have a template or whose pages agree on a container."""
    tokens = stage(page_tokens(pages), "page-tokens")
    known = stage(classes(tokens), "classes")
    whole = known.filter(f"kind = {PAGE}").select("host", F.col("pages").alias("all_pages"), F.greatest("text", F.lit(1)).alias("all_text"))
    # The frame is the class of the page itself; its slot has most of what all tokens of the host's pages hold.
    frame = known.filter(f"kind = {PAGE} AND pages >= {SUPPORT}").select("host", F.col("vector").alias("frame"), F.greatest("whole", F.lit(1)).alias("all_whole"), F.col("text").alias("shown"))
    able = known.filter(f"kind = {ELEMENT} AND free = 1").join(frame, "host").filter(f"vector = frame AND whole >= {MOST} * all_whole AND (level > 0 OR text >= {NEARLY} * shown)")
    slots = able.groupBy("host").agg(F.max_by("token", F.struct("level", (-F.col("depth")).alias("d"), "whole", (-F.col("token")).alias("t"))).alias("slot"))
    # The same choice as marked_container(), over the pages of the host.
    marked = known.filter(f"kind = {ELEMENT} AND level > 0").join(whole, "host").withColumn("share", F.col("text") / F.col("all_text"))
    marked = marked.filter(f"pages >= {PAGES} * all_pages AND share >= if(level > 1, {LEAST}, {MOST})")
    chosen = marked.groupBy("host").agg(F.max_by("token", F.struct("share", "depth", (-F.col("token")).alias("t"))).alias("container"))
    fixed = own_texts(tokens, known).groupBy("host").agg(F.collect_list("token").alias("fixed"), F.sum("text").alias("text"))
    fixed = fixed.join(whole, "host").filter(f"all_text - text >= {VARIES} * all_text").select("host", "fixed")
    return slots.join(chosen, "host", "full").join(fixed, "host", "full").select("host", "slot", "container", F.coalesce("fixed", F.array().cast("array<long>")).alias("fixed"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    ship(pages.sparkSession)
    rows = own_columns(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host_of(F.col("url")))
    rules = stage(templates(rows), "templates")
    size = rules.agg(F.coalesce(F.sum(F.length("host") + 64 + 8 * F.size("fixed")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, "host", "left").select("page_id", "url", "html", "container", "fixed", "slot")

    def run(batches):
        claim("html")
        for batch in batches:
            texts = [main_text(page or "", c, set(f or ()), s) for page, c, f, s in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
