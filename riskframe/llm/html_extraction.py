"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks, each with the path of its block elements. Blocks inside menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, scripts and styles are set aside by element name and by the words
of ``class``, ``id`` and ``role``, unless such words stand on the element of the article. Of the others, text length and punctuation are added up per root-to-leaf path and
divided by the number of its blocks; both ratios are multiplied, smoothed over neighbouring blocks in page order, and
blocks above a share of the page's mean are content. So a short paragraph stays with the long ones on its path. The
text is everything that was not set aside in the article or main element around the content; without one, in the deepest
element that holds all blocks whose own path is above the share, with the running text beside it.

Defined cases: null or empty html and pages without content give an empty text; unclosed and stray tags are tolerated;
rows that repeat are read one by one; an empty table gives an empty result; text without any element is one block.
Other columns are never read. A page is read whole, however long, in time proportional to its length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from riskframe.llm import hashing

# Elements of HTML by how they shape text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output picture q ruby rp rt s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style title noscript template svg textarea iframe object select option canvas math head".split())
RAW = frozenset("script style title textarea iframe".split())
ASIDE = frozenset("nav header footer aside form button dialog menu fieldset".split())
#: Of these, those that may be wrapped around a whole page: set aside like elements whose attributes say so.
WRAPPERS = frozenset("form fieldset dialog header".split())
#: An open element of these ends when a sibling or a block begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
PARENTS = frozenset("ul ol dl table tbody thead tfoot body html div article section main blockquote".split())
MAIN = frozenset(("article", "main"))
WHOLE = frozenset(("", "html", "body"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are a part of running text, not the whole of it.
PROSE = HEADINGS | frozenset("p blockquote pre ul ol li dl dt dd figure figcaption".split())
#: Words of class, id and role that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disqus footer gdpr header menu menubar modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promoted promotion related replies respond share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription toolbar topbar widget complementary contentinfo search alert".split()
)

#: Words that a compound of them may have beside: parts of a page and of its making, never of an article.
PLACE_WORDS = frozenset(
    "site page global top bottom left right main primary secondary mobile desktop sticky fixed floating box bar block area list links "
    "link item items wrap wrapper container inner outer section panel row slot unit google js icon icons button buttons form posts "
    "media count title heading label text message overlay trail".split()
)
TALK = frozenset("comment comments disqus replies respond".split())
#: How an element is set aside: by its name, by its attributes, or as comments.
BY_NAME, BY_MARK, BY_TALK = 1, 2, 3

# No alternative looks beyond the next "<" but comments, which end their search: a page is read in linear time.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<rest>(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/<>]*+)(?P<rest2>[^<>]*+)>""",
    re.S,
)
RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Blocks whose smoothed ratio is at least this share of the page's mean are content.
SHARE = 0.1


def marks_aside(token: str) -> bool:
    """Whether a token of class, id or role is one of the words, or a compound of them and of words for places."""
    if token in ASIDE_WORDS:
        return True
    parts = [x for x in re.split("[_-]+", token) if x]
    return len(parts) > 1 and any(x in ASIDE_WORDS for x in parts) and all(x in ASIDE_WORDS or x in PLACE_WORDS for x in parts)


def set_aside(name: str, rest: str) -> int:
    """``BY_NAME``, ``BY_MARK`` for wrappers and for attributes that say so, ``BY_TALK`` for those of comments, or 0."""
    if name in HIDDEN or (name in ASIDE and name not in WRAPPERS):
        return BY_NAME
    found = BY_MARK if name in WRAPPERS else 0
    if not rest or name in ("html", "body"):
        return found
    for m in ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if key in ("class", "id", "role"):
            tokens = [x for x in value.split() if marks_aside(x)]
            if tokens:
                found = max(found, BY_MARK)
            if any(not TALK.isdisjoint(re.split("[_-]+", x)) for x in tokens):
                found = BY_TALK
        elif (key == "hidden" and value != "until-found") or (key == "aria-hidden" and value == "true") or (key == "style" and UNSEEN.search(value)):
            found = max(found, BY_MARK)
    return found


class Elements:
    """The block elements of a page in page order: name, parent, how set aside, and the number that stands for the path of names."""

    def __init__(self) -> None:
        self.names, self.parents, self.kinds, self.asides = [""], [-1], [0], [0]
        self.kind_of: dict[tuple[int, str], int] = {}

    def add(self, name: str, parent: int, aside: int) -> int:
        kind = self.kind_of.setdefault((self.kinds[parent], name), len(self.kind_of) + 1)
        self.names.append(name)
        self.parents.append(parent)
        self.kinds.append(kind)
        self.asides.append(aside)
        return len(self.names) - 1


def blocks(html: str) -> tuple[Elements, list[tuple[int, str]]]:
    """The elements of a page and the text blocks that were not set aside by name, in page order: element and text."""
    elements = Elements()
    out: list[tuple[int, str]] = []
    path: list[tuple[int, bool]] = [(0, False)]  # open elements; whether the element or one above it is set aside by name
    open_names: defaultdict[str, int] = defaultdict(int)
    text: list[str] = []
    at = 0

    def close_block() -> None:
        if text:
            element, dropped = path[-1]
            clean = "" if dropped else " ".join(unescape("".join(text)).split())
            if clean:
                out.append((element, clean))
            text.clear()

    def pop_to(size: int) -> None:
        close_block()
        for element, _ in path[size:]:
            open_names[elements.names[element]] -= 1
        del path[size:]

    def close_one_of(names: frozenset | set, within: frozenset = frozenset()) -> None:
        """Closes the last open element of these names, if it is not beyond one that holds its content together."""
        if any(open_names[x] for x in names):
            for i in range(len(path) - 1, 0, -1):
                name = elements.names[path[i][0]]
                if name in names:
                    pop_to(i)
                    return
                if name in within:
                    return

    skip, skip_name = 0, ""  # inside an inline element that is set aside: how many of its name are open
    while True:
        m = MARKUP.search(html, at)
        part = html[at : m.start() if m else len(html)]
        if part and not skip:
            text.append(part)
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        ends = (m["end"] or m["end2"]) == "/"
        rest = m["rest"] or m["rest2"] or ""
        if skip:
            if name == skip_name:
                skip += -1 if ends else 1
                continue
            if name in INLINE or name in VOID:
                continue
            skip = 0  # a block ends an inline element that was never closed
        if name in INLINE:
            if not ends and name not in VOID and not rest.endswith("/") and set_aside(name, rest):
                skip, skip_name = 1, name
            continue
        if name in ("br", "hr"):
            text.append(" ")
            if name == "hr":
                close_block()
            continue
        if name in VOID:
            continue
        close_block()
        if ends:
            close_one_of({name})
            continue
        if name in RAW:
            done = RAW_ENDS[name].search(html, at)
            at = done.end() if done else len(html)
            continue
        close_one_of(SIBLINGS.get(name, frozenset()) | {"p"} | (HEADINGS if name in HEADINGS else frozenset()), PARENTS)
        parent, dropped = path[-1]
        # the heading of an article may stand in a header of its own
        inside = name == "header" and any(open_names[x] for x in MAIN)
        aside = set_aside("", rest) if inside else set_aside(name, rest)
        path.append((elements.add(name, parent, aside), dropped or aside == BY_NAME))
        open_names[name] += 1
    close_block()
    return elements, out


def seen(elements: Elements, found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks outside the elements that attributes, or the names of wrappers, set aside.

    They do not set aside the element of the article: one that holds an article or main element, when none outside
    has as much text; or, without any outside, one that holds most of the weight, or as comments all of it.
    """
    names, parents, asides = elements.names, elements.parents, elements.asides
    if not any(a > BY_NAME for a in asides):
        return found
    n = len(names)
    kinds = [elements.kinds[element] for element, _ in found]
    length, count = defaultdict(int), defaultdict(int)
    for kind, (_, text) in zip(kinds, found):
        length[kind] += len(text)
        count[kind] += 1
    weight, articles, near, out = [0.0] * n, [0.0] * n, [False] * n, [False] * n
    for i in range(1, n):
        near[i] = near[parents[i]] or names[i] in MAIN
        out[i] = out[parents[i]] or asides[i] > 0
    outside = 0.0  # weight of articles beyond all that could be set aside
    for kind, (element, text) in zip(kinds, found):
        value = len(text) * length[kind] / count[kind]
        weight[element] += value
        articles[element] += value * near[element]
        outside += value * (near[element] and not out[element])
    for i in range(n - 1, 0, -1):
        weight[parents[i]] += weight[i]
        articles[parents[i]] += articles[i]
    gone = [False] * n
    for i in range(1, n):
        gone[i] = gone[parents[i]]
        if not gone[i] and asides[i] > BY_NAME:
            most = 2 * weight[i] > weight[0] if asides[i] == BY_MARK else weight[i] >= weight[0] * (1 - 1e-9)
            gone[i] = not (articles[i] > outside if articles[i] else not outside and most)
    return [(element, text) for element, text in found if not gone[element]]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, joined by empty lines."""
    elements, found = blocks(html or "")
    found = seen(elements, found)
    if not found:
        return ""
    kinds = [elements.kinds[element] for element, _ in found]
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for kind, (_, text) in zip(kinds, found):
        length[kind] += len(text)
        marks[kind] += len(PUNCTUATION.findall(text))
        count[kind] += 1
    fused = [length[k] / count[k] * (1 + marks[k] / count[k]) for k in kinds]
    smooth = [(fused[max(0, i - 1)] + 2 * fused[i] + fused[min(len(fused) - 1, i + 1)]) / 4 for i in range(len(fused))]
    sizes = [len(text) for _, text in found]
    level = SHARE * sum(s * n for s, n in zip(smooth, sizes)) / sum(sizes)
    names, parents = elements.names, elements.parents
    held, prose = [0] * len(names), set()
    for (element, text), f in zip(found, fused):
        held[element] += len(text) * (f >= level)  # by the ratio of its own path
        prose.add(parents[element] if names[element] in PROSE else element)
    for i in range(len(held) - 1, 0, -1):
        held[parents[i]] += held[i]
    near, outer = [0] * len(names), [0] * len(names)  # the closest and the outermost article around each element
    for i in range(1, len(names)):
        near[i] = i if names[i] in MAIN else near[parents[i]]
        outer[i] = outer[parents[i]] or near[i]
    # the deepest element that holds all of the content
    holder = max(i for i, n in enumerate(held) if n == held[0])
    articles = {outer[element] for (element, _), f in zip(found, fused) if f >= level and outer[element]}
    if near[holder]:
        chosen = {near[holder]}
    elif articles and 2 * sum(held[i] for i in articles) >= held[0]:
        chosen = articles
    else:
        # of an article with one long block or part, the rest stands beside it
        while names[holder] not in WHOLE and names[parents[holder]] not in WHOLE and (names[holder] in PROSE or parents[holder] in prose):
            holder = parents[holder]
        if names[holder] in WHOLE or (names[holder] in PROSE and parents[holder] in prose):
            keep = [s >= level for s in smooth]
            for i in range(len(keep) - 2, -1, -1):  # with the headings above
                keep[i] = keep[i] or (keep[i + 1] and names[found[i][0]] in HEADINGS)
            return "\n\n".join(text for (_, text), k in zip(found, keep) if k)
        chosen = {holder}
        if parents[holder] in prose:  # of the body or of nothing
            chosen |= {e for e, _ in found if e == parents[holder] or (parents[e] == parents[holder] and names[e] in PROSE)}
    within = [False] * len(names)
    for i in range(len(names)):  # a body among them stands for its own text alone
        within[i] = i in chosen or (i > 0 and within[parents[i]] and names[parents[i]] not in WHOLE)
    return "\n\n".join(text for element, text in found if within[element])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches):
        for batch in hashing.slices(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
