"""Flat text blocks of an HTML page, with their features.

A block is the text between block-level tags. Its features are its words, its link
density, the same of the blocks before and after it, and what its surrounding
elements say: inside an article, inside furniture (menus, headers, footers, asides,
forms, or elements whose class, id or role names furniture), a heading.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Their content is no text of the page.
HIDDEN_TAGS = frozenset(
    "script style noscript template title textarea select option button iframe object svg canvas audio video datalist".split()
)
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog fieldset button".split())
#: A new one of these ends an open one of the same kind.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role names that mark furniture.
FURNITURE_WORDS = re.compile(
    r"ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|disqus|consent|cookies?|gdpr|"
    r"disclaimer|footer|foot|header|masthead|menu|nav|navbar|navigation|newsletter|notices?|alert|pagination|pager|popup|modal|"
    r"promo\w*|recommend\w*|related|replies|reply|respond|share|sharing|sidebar|side|skip|social|sponsor\w*|subscribe|"
    r"subscription|teaser|toolbar|topbar|widget|login|signup|search|contentinfo|complementary|form|feedback"
)
#: Words that a furniture name may hold besides; with any other word (has-sidebar,
#: page-with-header, search-results) a name says nothing.
PLAIN_WORDS = re.compile(
    r"area|articles?|author|badge|bar|blocks?|blog|body|bottom|box|btn|buttons?|card|cell|col|column|container|content|desktop|entry|"
    r"global|group|holder|icons?|inner|input|items?|left|links?|lists?|main|message|meta|mobile|outer|page|panel|policy|posts?|primary|"
    r"right|rail|row|secondary|section|site|slot|stories|story|text|thread|title|tools|top|unit|user|wrap|wrapper|zone|\d+"
)
#: Furniture of many items: an article in it is one of them, not the page's.
ITEM_WORDS = re.compile(r"(?:^|[^a-z])(?:comments?|commentlist|disqus|recommend\w*|related|replies|reply|respond|sponsor\w*|teaser|promo\w*|ads?|advert\w*)(?:$|[^a-z])")
CONTENT_WORDS = re.compile(r"(?:^|[^a-z])(?:article|articlebody|content|entry|main|post|story|text|body)(?:$|[^a-z])")
TAG_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
TAG_MARK = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")


@lru_cache(maxsize=100_000)
def names_furniture(name: str) -> bool:
    """Whether one whole class, id or role says furniture: all its words do, or are plain,
    and it is not the name of a kind of page (search-page)."""
    # block__element--modifier: the element is named
    words = [w for w in re.split(r"[^a-z0-9]+", name.split("--")[0].rsplit("__", 1)[-1]) if w]
    marks = [bool(FURNITURE_WORDS.fullmatch(w)) for w in words]
    return any(marks) and words[-1] != "page" and all(m or PLAIN_WORDS.fullmatch(w) for m, w in zip(marks, words, strict=True))


def of_attributes(tag: str, text: str) -> tuple[int, bool, bool]:
    """Furniture (2: of many items), content, hidden, as the attributes of a tag say."""
    if not text or "=" not in text and "hidden" not in text.lower():
        return 0, False, False
    names, hidden = [], False
    for m in ATTRIBUTE.finditer(text):
        key, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif key == "hidden":
            hidden |= m.start() == 0 or not text[m.start() - 1].isalnum() and text[m.start() - 1] not in "-_\"'="
        else:
            names.append(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", value).lower())
    joined = " ".join(names)
    marked = [name for name in joined.split() if names_furniture(name)]
    furniture = 2 if any(map(ITEM_WORDS.search, marked)) else int(bool(marked))
    return furniture, bool(CONTENT_WORDS.search(joined)), hidden


class Scanner:
    """Tags of a page in one forward scan, each place of the page read a bounded number of
    times: what is known to be missing in the rest is not looked for again."""

    def __init__(self, html: str):
        self.html, self.size = html, len(html)
        self.missing: dict[str, bool] = {}
        self.quotes = True

    def find(self, what: str, at: int) -> int:
        """The next place of a string; the page's end when there is none."""
        if self.missing.get(what):
            return self.size
        found = self.html.find(what, at)
        if found < 0:
            self.missing[what] = True
            return self.size
        return found

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, outside of quoted values. Once a tag is
        never closed that way, quotes say nothing in the rest of the page."""
        if self.quotes:
            place = at
            while m := TAG_MARK.search(self.html, place):
                if m[0] == ">":
                    return m.start()
                place = self.find(m[0], m.end()) + 1
            self.quotes = False
        return self.find(">", at)

    def tokens(self):
        """Text as (None, text, ""), tags as (slash, name, attributes), in page order."""
        html, at = self.html, 0
        while at < self.size:
            start = self.find("<", at)
            if start > at:
                yield None, html[at:start], ""
            if start == self.size:
                return
            if html.startswith("<!--", start):
                at = self.find("-->", start) + 3
            elif html.startswith("<![CDATA[", start):
                end = self.find("]]>", start)
                yield None, html[start + 9 : end].replace("&", "&amp;"), ""
                at = end + 3
            elif html.startswith(("<!", "<?"), start):
                at = self.find(">", start) + 1
            elif m := TAG_START.match(html, start):
                end = self.tag_end(m.end())
                if end == self.size:
                    # no tag ends in the rest of the page
                    yield None, html[start:], ""
                    return
                at = end + 1
                name = m[2].lower()
                yield m[1], name, html[m.end() : end]
                if name in RAW_TAGS and not m[1]:
                    at = self._raw_end(name, at)
            else:
                yield None, "<", ""
                at = start + 1

    def _raw_end(self, name: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup."""
        if self.missing.get(name):
            return self.size
        end = re.compile(rf"</{name}\s*>", re.I).search(self.html, at)
        if end is None:
            self.missing[name] = True
            return self.size
        return end.end()


class Open:
    """The open elements, and where each kind of them and the blocks stand."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, entry: tuple) -> None:
        tag, at = entry[0], len(self.stack)
        self.stack.append(entry)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK_TAGS:
            self.blocks.append(at)

    def cut(self, at: int) -> None:
        """Close everything from a place on."""
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    @property
    def links(self) -> int:
        return len(self.places.get("a", ()))


class Block:
    __slots__ = ("article", "content", "furniture", "heading", "links", "text", "words")

    def __init__(self, text, words, links, article, content, furniture, heading):
        self.text, self.words, self.links = text, words, links
        self.article, self.content, self.furniture, self.heading = article, content, furniture, heading


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in page order; those without text are left out."""
    out: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    opened = Open()
    # of the innermost element: inherited furniture, content, hidden, article, furniture by
    # a name, numbers of the form, of the article that a name's furniture holds, and of the
    # outermost element that a name makes furniture
    outside = (False, False, False, False, 0, 0, 0, 0)
    state = outside
    forms = holders = regions = 0
    #: By block: what the page as a whole decides.
    open_points: list[tuple] = []
    page_forms: set[int] = set()

    def close_block() -> None:
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                links = len(unescape("".join(link_parts)).split()) if link_parts else 0
                heading = any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in opened.stack[-3:])
                out.append(Block(text, len(text.split()), links, state[3], state[1], state[0] or state[4] > 0, heading))
                # only a name makes it furniture, and none of many items
                open_points.append((*state[5:], not state[0] and state[4] == 1))
            parts.clear()
            link_parts.clear()

    def add(text: str) -> None:
        if text and not state[2]:
            parts.append(text)
            if opened.links:
                link_parts.append(text + " ")

    def now() -> tuple:
        return opened.stack[-1][1:] if opened.stack else outside

    for slash, tag, attributes in Scanner(html).tokens():
        if slash is None:
            add(tag)
            continue
        if slash:
            if tag in BLOCK_TAGS:
                close_block()
            at = opened.last(tag)
            # a stray end tag of an inline element does not close blocks around it
            if at >= 0 and (tag in BLOCK_TAGS or at > opened.last_block()):
                opened.cut(at)
            state = now()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK_TAGS:
            close_block()
            at = max((opened.last(t) for t in SELF_CLOSING.get(tag, ())), default=-1)
            if at >= 0 and at >= opened.last_block():
                opened.cut(at)
                state = now()
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS and tag != "a":
            continue
        if tag in RAW_TAGS:
            if tag == "title":
                close_block()
            continue
        furniture, content, hidden = of_attributes(tag, attributes)
        article = state[3] or tag == "article"
        header = tag == "header" and not state[3]
        named, form, holder, region = state[4:]
        if tag in ("main", "article") and not furniture and not state[3]:
            # the page's matter, whatever the elements around it are called
            if named < 2 or tag == "main":
                page_forms.add(form)
                if named and tag == "article":
                    holders += 1
                    holder = holders
                named = 0
        # a page's outermost elements are the page, whatever they are called
        elif tag not in ("body", "html", "article", "main"):
            if furniture and not named:
                regions += 1
                region = regions
            named = max(named, furniture)
        if tag == "form" and not form:
            forms += 1
            form = forms
        state = (
            state[0] or tag in FURNITURE_TAGS and tag != "form" or header,
            state[1] or content or tag == "main", state[2] or hidden or tag in HIDDEN_TAGS, article, named, form, holder, region,
        )
        opened.push((tag, *state))
    close_block()
    settle(out, open_points, page_forms)
    return out


#: Words of a block that can be a page's matter by itself.
MATTER = 10


def settle(blocks: list[Block], points: list[tuple], page_forms: set[int]) -> None:
    """Forms are furniture unless they are the page: hold its article, or half of its words.
    An article inside furniture by name is the page's when none outside is longer. An
    element that only its name makes furniture is the page's matter when it holds half of
    the words and no block outside of furniture is in an article or long enough to be one."""
    in_form, in_holder, in_region, outside = Counter(), Counter(), Counter(), 0
    for b, (form, holder, region, _) in zip(blocks, points, strict=True):
        in_form[form] += b.words
        in_holder[holder] += b.words
        in_region[region] += b.words
        outside += b.words if b.article and not b.furniture and not holder else 0
    total = sum(b.words for b in blocks)
    other = any(not b.furniture and (b.words >= MATTER or b.article or b.content) for b in blocks)
    for b, (form, holder, region, by_name) in zip(blocks, points, strict=True):
        if by_name and not other and 2 * in_region[region] >= total:
            b.furniture = False
        b.furniture |= bool(form) and form not in page_forms and 2 * in_form[form] < total
        b.furniture |= bool(holder) and in_holder[holder] < outside


NAMES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "article", "furniture", "content", "heading", "matter", "page_has_matter",
)


def features(blocks: list[Block]) -> list[list[float]]:
    """``matter``: inside an article, a main element or one whose name says content."""
    matter = [float(b.article or b.content) for b in blocks]
    page = float(any(m and not b.furniture for m, b in zip(matter, blocks, strict=True)))
    density = [min(1.0, b.links / b.words) if b.words else 0.0 for b in blocks]
    out = []
    for i, b in enumerate(blocks):
        before = (float(blocks[i - 1].words), density[i - 1]) if i else (0.0, 0.0)
        after = (float(blocks[i + 1].words), density[i + 1]) if i + 1 < len(blocks) else (0.0, 0.0)
        says = (float(b.article), float(b.furniture), float(b.content), float(b.heading), matter[i], page)
        out.append([float(b.words), density[i], *before, *after, *says])
    return out
