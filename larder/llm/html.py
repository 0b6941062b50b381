"""Main text of web pages by tree scoring.

One pass over the markup makes a light tree of elements and a list of text blocks in page order. Paragraphs pass points
for length and commas to their ancestors, less to higher ones, discounted by link density; the best container is kept with
those siblings that look like more of the same. Menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are recognised by element, role and class and give neither points nor text. A name of such words and layout words
alone ("related-links", "cookie-notice") settles it; a name with other words as well ("related-work", "share-price") only
lowers the score, and within the article its block goes only if it is also linked or a short line that is no sentence.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what they mean for the text.
RAW = set("script style title noscript iframe textarea noframes".split())
#: Their text is never the article's; what stands in them is parsed, so that nesting counts; one without an end tag hides nothing.
EMBEDDED = set("svg math object canvas select video audio template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label map mark q ruby rb rp
rt s samp small span strike strong sub sup time tt u var wbr""".split())
BOILERPLATE = set("nav aside footer form button fieldset dialog menu head".split())
MENUS = set("nav aside footer menu button head".split())
#: Blocks that belong to an article at any length if they stand beside its text and hold no link.
PROSE = set("p pre ul ol dl".split())
CLOSES_PARAGRAPH = set("""address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul""".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table menu".split())
CONTAINERS = set("html body main article section div td center blockquote".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that mark what is not the article, its comments, and what is the article.
UNWANTED = set("""nav navbar navigation menu sidebar footer masthead breadcrumb breadcrumbs ad ads advert adverts advertisement
adsense adbox banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notification alert popup modal
overlay dialog share sharing social related recommended recommendations trending newsletter subscribe subscription signup login
search searchbox toolbar pagination pager widget widgets skip outbrain taboola legal copyright complementary contentinfo
disclaimer paywall""".split())
COMMENTS = set("comment comments commentlist respond reply replies disqus discussion responses feedback reviews".split())
#: Names that are no article's, whatever other words stand beside them.
NEVER = set("""navbar sidebar masthead breadcrumb breadcrumbs adsense adbox advert adverts advertisement outbrain taboola pagination
pager gdpr popup contentinfo complementary commentlist disqus""".split())
PAGE_HEADS = {"header", "banner", "topbar"}
# Words about layout, which say nothing of what a block holds; words of two letters and those with digits count as such.
LAYOUT = set("""and area areas article articles author bar bars block blocks body bottom box boxes btn button buttons card cards
carousel center close col column columns component container containers content count counter cta custom customer desktop
drawer entries entry email feed field fixed floating follow foot footer for form from frame global google grid group head
header heading holder home horizontal icon icons image info inline inner item items label large last latest law left line
link links list listing lists main message messages meta middle mobile module modules more most new news outer page pages
panel panels policy popular position post posts primary rail read reader readers recent region right row rows secondary
section sections settings sign site sitewide slider slot small space stack sticky stories story strip tab tabs teaser teasers text
the thread title toggle tool tools top unit user users vertical view views warning website with wrap wrapper wrappers you your zone
""".split())
#: What a doubtful name leaves of a container's score, how far below the best such a sibling may be, link density and
#: length that drop such a block within the article.
DOUBT, DOUBT_LEAST, DOUBT_LINKED, DOUBT_SHORT = 0.4, 0.4, 0.3, 60
TITLE_OF = set("article entry post content story".split())
EXCUSED = set("has with no without open closed".split())
WANTED = set("article content main post entry story body text blog".split())

_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_TAG_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_COMMAS = re.compile("[,،、，;；]")
_SENTENCE = re.compile("[.!?…:;。！？][\"'”’»)]*$")


def _settles(name: set[str], marks: set[str]) -> bool:
    """True if a name that holds one of the marks holds nothing else but such words and words about layout."""
    return bool(name & NEVER) or all(w in marks or w in UNWANTED or w in LAYOUT or len(w) < 3 or not w.isalpha() for w in name)


class Node:
    __slots__ = ("tag", "parent", "unwanted", "comments", "wanted", "bonus", "points", "chars", "linked", "blocks", "menu", "kept", "hidden",
                 "doubtful", "weight", "sentences", "in_menu")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.bonus, self.points, self.chars, self.linked, self.blocks = 0.0, 0.0, 0, 0, 0
        self.menu = self.kept = self.doubtful = False
        self.sentences, self.weight = 0, 1.0 if parent is None else parent.weight
        self.in_menu = parent is not None and parent.in_menu or tag in MENUS
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        named = [n for k in ("class", "id", "role") if k in found for n in found[k].split()]
        names = [set(_WORD.findall(_CAMEL.sub(" ", n).lower())) for n in named]
        marks = [n for n in names if not n & EXCUSED]
        words = {w for n in marks for w in n}
        inside = parent is not None and parent.wanted
        heads = set() if inside else PAGE_HEADS
        marked = [n for n in marks if n & (UNWANTED | NEVER) or n & heads and not n & TITLE_OF]
        bad = [n for n in marked if _settles(n, heads)]
        # a layout name beside a plain name of the article, as in "main-content sidebar-right", marks the article
        bad = [] if any(n & {"content", "article", "main"} for n in marks if n not in bad) else bad
        self.comments = parent is not None and parent.comments
        self.wanted = inside
        own = False
        out_of_sight = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        self.hidden = parent is not None and parent.hidden or out_of_sight
        if tag not in INLINE or words & {"ad", "ads", "advert"}:
            speaking = [n for n in marks if n & COMMENTS]
            remarks = any(_settles(n, COMMENTS) for n in speaking)
            self.doubtful = tag not in ("html", "body", "main", "article") and any(n not in bad for n in marked + speaking)
            own = (
                tag in BOILERPLATE or out_of_sight or remarks or bool(bad) or not inside and tag == "header"
            ) and tag not in ("html", "body")
            self.comments |= remarks and tag not in ("html", "body")
        above = parent is not None and parent.unwanted
        if tag in ("main", "article") and not own and not self.comments:
            above, self.wanted, self.weight = False, True, 1.0
        self.unwanted = above or own
        if self.doubtful:
            self.weight = DOUBT
        if not self.unwanted and (tag in ("main", "article") or words & WANTED):
            self.bonus = 25.0 if tag in ("main", "article") else 10.0


class _Quotes:
    """Finds the end of a tag; remembers where a quote has no partner, so that bad markup stays linear."""

    def __init__(self, html: str):
        self.html, self.none_from = html, {'"': len(html), "'": len(html)}

    def end(self, at: int) -> int:
        html = self.html
        while True:
            close = html.find(">", at)
            if close < 0:
                return -1
            quote = min((q for q in (html.find('="', at, close), html.find("='", at, close)) if q >= 0), default=-1)
            if quote < 0:
                return close
            mark = html[quote + 1]
            if quote + 2 >= self.none_from[mark]:
                return close
            partner = html.find(mark, quote + 2)
            if partner < 0:
                self.none_from[mark] = quote + 2
                return close
            at = partner + 1


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """Elements, parents first; text blocks in page order: the element that holds them, text, characters within links."""
    nodes, blocks, unclosed = _parse(html, set())
    if unclosed:  # once more without them, so that they hide nothing
        nodes, blocks, more = _parse(html, unclosed)
        if more:
            nodes, blocks, _ = _parse(html, None)
    return nodes, blocks


def _parse(html: str, void: set[int] | None) -> tuple[list[Node], list[tuple[Node, str, int]], set[int]]:
    """Elements, blocks, and places of embedded elements without an end tag; those at the places of void (None: all) are passed over."""
    root = Node("html", None, "")
    nodes, stack, open_tags, blocks = [root], [root], Counter(), []
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of a tag are
    holders = [root]  # the open elements that are not inline
    parts: list[str] = []
    linked, breaks, quotes, at, n = 0, 0, _Quotes(html), 0, len(html)
    embedded, within = {}, 0  # embedded elements without an end tag so far, and how many are open

    def flush():
        nonlocal linked, breaks
        if within:  # the paragraph around an embedded element goes on after it
            return
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((holders[-1], text, min(linked, len(text))))
        parts.clear()
        linked = breaks = 0

    def enter(node):
        nodes.append(node)
        open_tags[node.tag] += 1
        places[node.tag].append(len(stack))
        stack.append(node)
        if node.tag not in INLINE:
            holders.append(node)

    def leave_until(tags, bounds=()):
        nonlocal within
        innermost = lambda names: max((places[t][-1] for t in names if open_tags[t] > 0), default=0)
        place = innermost(tags)
        if not place or bounds and max(innermost(bounds), innermost(EMBEDDED) if within else 0) > place:
            return
        embedded.pop(stack[place], None)
        while len(stack) > place:
            node = stack.pop()
            within -= node.tag in EMBEDDED
            open_tags[node.tag] -= 1
            places[node.tag].pop()
            if node is holders[-1]:
                holders.pop()

    while at < n:
        open_at = html.find("<", at)
        text = html[at:open_at if open_at >= 0 else n]
        if text and not within:
            if text.strip():
                breaks = 0
            if not (stack[-1].unwanted and stack[-1].tag in INLINE):
                text = unescape(text)
                parts.append(text)
                if open_tags["a"] > 0:
                    linked += len(text.strip())
        if open_at < 0:
            break
        if html.startswith("<!--", open_at):
            end = html.find("-->", open_at + 4)
            at = n if end < 0 else end + 3
            continue
        name = _TAG_NAME.match(html, open_at + 1)
        if not name:
            if html[open_at + 1:open_at + 2] in ("!", "?", "/"):
                end = html.find(">", open_at)
                at = n if end < 0 else end + 1
            else:
                if not within:
                    parts.append("<")
                at = open_at + 1
            continue
        tag = name[0].lower()
        end = quotes.end(name.end())
        if end < 0:
            break
        at = end + 1
        if tag[0] == "/":
            tag = tag[1:]
            if tag not in INLINE and tag not in EMBEDDED:
                flush()
            if tag not in ("html", "body"):
                leave_until((tag,), CLOSES_PARAGRAPH | {"p"} if tag in INLINE else ())
            continue
        closed = html[end - 1] == "/" and (tag in ("svg", "math") or open_tags["svg"] > 0 or open_tags["math"] > 0)
        if tag in RAW and not closed:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
            if not close:
                break
            at = quotes.end(close.end()) + 1 or n
            continue
        if tag in EMBEDDED:
            if not closed and void is not None and open_at not in void:
                node = Node(tag, stack[-1], "")
                node.unwanted = True
                enter(node)
                embedded[node] = open_at
                within += 1
            continue
        if within and closed:
            continue
        if tag == "br" and within:
            continue
        if tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID or tag == "html":
            continue
        if tag in CLOSES_PARAGRAPH:
            leave_until(("p",), ("button", "td", "th"))
        if tag in CLOSED_BY:
            leave_until(CLOSED_BY[tag], SCOPES)
        if tag in HEADINGS:
            leave_until(HEADINGS, CLOSES_PARAGRAPH - HEADINGS)
        if tag == "a":
            leave_until(("a",), CLOSES_PARAGRAPH)
        node = Node(tag, stack[-1], html[name.end():end])
        if html[end - 1] != "/" or tag not in INLINE:
            enter(node)
        else:
            nodes.append(node)
    within = 0
    flush()
    return nodes, blocks, set(embedded.values())


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def main_text(html: str | None) -> str:
    """The article's blocks joined by line feeds; empty if there is none."""
    nodes, every = parse(html or "")
    blocks = [b for b in every if not b[0].unwanted]
    if not blocks:  # a page that is a form or a notice as a whole
        blocks = [b for b in every if b[0].tag not in BOILERPLATE and not b[0].comments]
        if sum(len(b[1]) for b in blocks) < 200:  # a short one without menus, and without what is not shown
            blocks = [b for b in blocks if not b[0].hidden and not b[0].in_menu and 2 * b[2] < len(b[1])]
    if not blocks:
        return ""
    for holder, text, linked in blocks:
        holder.chars += len(text)
        holder.linked += linked
        holder.blocks += 1
        holder.sentences += bool(_SENTENCE.search(text, max(0, len(text) - 5)))
        if holder.tag not in HEADINGS:
            # the container of a paragraph is its parent; text that stands in a container itself counts for that one
            container = holder if holder.tag in CONTAINERS else holder.parent or holder
            container.points += (1 + len(_COMMAS.findall(text)) + min(len(text) / 100, 3)) * (1 - linked / len(text))
    for node in reversed(nodes[1:]):  # half of its points go on to the next higher one
        above = node.parent
        above.points += node.points / 2
        above.chars, above.linked = above.chars + node.chars, above.linked + node.linked
        above.blocks, above.sentences = above.blocks + node.blocks, above.sentences + node.sentences
    score = lambda x: (x.points + x.bonus) * (1 - _density(x)) * x.weight
    holds = [x for x in nodes if x.chars and x.tag not in INLINE | HEADINGS | {"p"}] or nodes[:1]
    best = max(holds, key=score)
    least, whole = max(3.0, 0.2 * score(best)), best.tag in ("article", "main")

    def sibling(x: Node) -> bool:
        if x.unwanted or not x.chars:
            return False
        if x.tag == "h1":
            return True
        if x.doubtful and score(x) < DOUBT_LEAST * score(best):
            return False
        if x.tag in CONTAINERS:
            return score(x) >= least and (not whole or x.tag == best.tag)
        return not whole and x.tag not in HEADINGS and _density(x) < 0.25 and (x.chars > 80 or not x.linked and x.tag in PROSE)

    def slight(x: Node) -> bool:
        return x.doubtful and x is not best and (_density(x) > DOUBT_LINKED or x.chars < DOUBT_SHORT and not x.sentences)

    for x in nodes:
        above = x.parent
        x.kept = x is best or above is not None and (above.kept or above is best.parent and sibling(x)) and not slight(x)
        x.menu = above is not None and above.menu or x.kept and x is not best and x.blocks >= 3 and x.tag != "p" and _density(x) > 0.8
    return "\n".join(text for holder, text, _ in blocks if holder.kept and not holder.menu)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text (main text, empty if none), n_chars (its code points).

    Null or empty html gives an empty text; null ids and addresses stay; repeated rows give repeated rows; an empty table an
    empty result; other columns are left out. Of equally good containers the first in the page is taken. Time is linear in the page, whatever its markup.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    schema = f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long"
    return narrow.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})
