"""Main text of HTML pages by two-pass block rules.

A page becomes blocks of text. In the first pass each block is good, bad or undecided by where it
stands (menus, footers, adverts and the like are bad), its link density, length and density of stop
words. In the second pass undecided blocks inherit the label of their nearest decided neighbours.

An article or main element is evidence, not a verdict: inside, lower limits hold, blocks with few stop
words are undecided rather than bad, and the edges count as good neighbours if a block inside is good,
if its text is long, or if none on the page is good; blocks outside are judged as on other pages. Names
of classes that may also stand for a text (a legal notice, a shared widget) only raise the limits.
A form goes with all in it, unless it goes around the page; its controls always go, and so does what is
hidden and what follows a heading of comments or of other texts. Where no block of a page without such elements is good, its language may be one without stop words
here: then length and links decide alone; and of a page that has nothing but short blocks these are the text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names, name parts of classes and ids, stop words of five languages.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br-br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("nav footer aside label legend script style noscript template iframe svg math canvas object embed applet audio video map button select option textarea datalist menu dialog head title noembed noframes xmp search".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup signin login related recommended recommendations comment comments commentlist disqus reply replies respond pagination pager contentinfo complementary".split())
DOUBTED_NAMES = frozenset("aside banner promo promotion widget widgets notice notices alert share sharing social copyright legal disclaimer toolbar skip search hidden".split())
#: Headings of what isn't the main text, whole: comments and lists of other texts.
ASIDE_HEADS = re.compile(
    r"(?:\W*\d+\W+)?(?:(?:reader|user|our readers'?) )?(?:comments?|replies|responses|kommentare|leserkommentare|commentaires|comentarios|comentários)(?:\W*\d*\W*)"
    r"|related(?: (?:articles|posts|stories|content|news|links))?|(?:read|see) (?:more|next|also)|more (?:stories|articles|news)|you (?:may|might) also like|recommended(?: for you)?"
    r"|ähnliche (?:artikel|beiträge)|mehr zum thema|das könnte sie auch interessieren|articles (?:liés|similaires)|à lire aussi|artículos relacionados|te puede interesar|artigos relacionados|leia também",
    re.I,
)
#: Before a name these say something else: ``no-sidebar``, ``has-comments``.
NEGATING = frozenset("no not has have with without is hide show".split())
STOP_WORDS = frozenset(
    "the of and to a in is it you that he was for on are with as his they be at one have this from or had by but not what all were we when your can said there an which she how their if will up about out them then so some her would him has "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui nous comme mais on si leur être cette ont aux "
    "el que los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde "
    "o os as do da em um uma não dos das ao na no nos se mais foi ele ela são".split()
)

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)(?:>|\Z|["'][^>]*>?)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|[\s\"])hidden(?=[\s/=]|$)")
ARIA = re.compile(r"""\baria-hidden\s*=\s*["']?true\b""")
DIALOG = re.compile(r"""(?:^|[\s"'])role\s*=\s*["']?(?:alert)?dialog\b""")
STYLE = re.compile(r"""(?:^|[\s"'])style\s*=\s*(?:"[^"]*?|'[^']*?|)(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b""")
WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG = 70, 200  # characters
LOW, HIGH = 0.10, 0.20  # density of stop words
LINKS = 0.5  # density of link text
FEW_LINKS = 0.2  # of blocks that length and links decide alone
#: What a new list item or cell ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass(slots=True)
class Part:
    text: str
    linked: int
    dropped: bool
    doubted: bool
    article: int  # number of the outermost article or main element, 0 outside
    heading: bool
    form: int  # number of the outermost form, 0 outside


@dataclass(slots=True)
class Open:
    name: str
    dropped: bool  # here or above
    by_name: bool  # only names of classes say so
    doubted: bool
    article: int
    form: int = 0
    silent: bool = False  # an inline element that is dropped: its text goes, the block around it stays


_ROOT = Open("", False, False, False, 0)


class Elements:
    """Open elements. Each is entered and left once, so a page takes time in proportion to its length."""

    def __init__(self) -> None:
        self.stack: list[Open] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def top(self) -> Open:
        return self.stack[-1] if self.stack else _ROOT

    def enter(self, e: Open) -> None:
        self.places.setdefault(e.name, []).append(len(self.stack))
        if e.name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(e)

    def last(self, name: str) -> int | None:
        at = self.places.get(name)
        return at[-1] if at else None

    def leave(self, at: int) -> None:
        """Close the element at ``at`` and all inside it."""
        while len(self.stack) > at:
            name = self.stack.pop().name
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()


def _named(words: str, among: frozenset[str]) -> bool:
    """Is a class, id or role one of the names, or does it begin or end with one?"""
    for word in words.lower().split():
        parts = [x for x in re.split(r"[^a-z0-9]+", word) if x]
        if parts and (parts[0] in among or parts[-1] in among and parts[0] not in NEGATING):
            return True
    return False


def _unseen(attributes: str) -> bool:
    """Do an element's attributes say that it isn't shown, or is shown over the page?"""
    low = attributes.lower()
    if "hidden" in low and (ARIA.search(low) or HIDDEN.search(QUOTED.sub('""', low))):
        return True
    return "dialog" in low and DIALOG.search(low) is not None or "style" in low and STYLE.search(low) is not None


def blocks(page: str) -> list[Part]:
    """The page's blocks with text, in page order."""
    out: list[Part] = []
    open_ = Elements()
    articles = forms = 0
    wrappers: set[int] = set()  # forms that an article stands in
    texts: list[str] = []
    linked = 0
    heading = False
    level = 0  # of the heading
    apart: tuple[int, int] | None = None  # level of a heading of other texts right inside an article or the body, and that element's depth

    def flush() -> None:
        nonlocal linked, heading, level, apart
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                e = open_.top()
                if apart and (len(open_.stack) <= apart[1] or heading and level <= apart[0]):
                    apart = None
                if heading and level > 1 and not e.dropped and ASIDE_HEADS.fullmatch(text):
                    around = max((at for at in open_.blocks if open_.stack[at].name not in HEADING), default=None)
                    if around is None or open_.stack[around].name in ("article", "main", "body", "html"):
                        apart = (level, 0 if around is None else around)
                    else:  # the rest of a section with such a heading
                        open_.stack[around].dropped = e.dropped = True
                out.append(Part(text, linked, e.dropped or apart is not None, e.doubted, e.article, heading, e.form))
            texts.clear()
        linked, heading, level = 0, False, 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not open_.top().silent:
            text = entities.unescape(raw) if "&" in raw else raw
            texts.append(text)
            if open_.last("a") is not None:
                linked += len(text.strip())

    i, n = 0, len(page)
    while i < n:
        m = TAG.search(page, i)
        if m is None:
            add(page[i:])
            break
        add(page[i : m.start()])
        i = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            at = open_.last(name)
            if name in BLOCK:
                flush()
            if at is not None and (name in BLOCK or not open_.blocks or open_.blocks[-1] < at):
                open_.leave(at)
            continue
        if name in BLOCK:
            flush()
            # an open paragraph ends where a block begins, list items and cells where the next begins
            if open_.blocks and (inner := open_.stack[open_.blocks[-1]].name) and (inner == "p" or inner in ENDS.get(name, ())):
                open_.leave(open_.blocks[-1])
            if name == "body" and (at := open_.last("head")) is not None:
                open_.leave(at)
        if name == "br":
            texts.append(" ")
        if name in VOID:
            if name == "hr":
                flush()
            continue
        above = open_.top()
        e = Open(name, above.dropped, above.by_name, above.doubted, above.article, above.form, above.silent)
        names = " ".join("".join(got) for got in NAMES.findall(m[3])) if m[3] and "=" in m[3] else ""
        whole = name in ("article", "main") or "main" in names.lower().split()
        if whole and e.by_name and not _named(names, DROPPED_NAMES):
            e.dropped = e.by_name = False  # a wrapper's class says less than the element
        if name in DROPPED or name == "header" and not e.article:
            e.dropped, e.by_name = True, False
        elif names and name not in ("html", "body", "main"):
            if name != "article" and not e.dropped and (_named(names, DROPPED_NAMES) or not e.article and name not in HEADING and "header" in re.split(r"[^a-z]+", names.lower())) or name == "article" and _named(names, _COMMENTS):
                e.dropped = e.by_name = True
            e.doubted = e.doubted or name != "article" and _named(names, DOUBTED_NAMES)
        if m[3] and name not in ("html", "body") and _unseen(m[3]):
            e.dropped, e.by_name = True, False
        if name == "form" and not e.form:
            forms += 1
            e.form = forms
        e.silent = e.silent or e.dropped and not above.dropped and name not in BLOCK
        if whole and not e.article and not e.dropped:
            articles += 1
            e.article = articles
            if e.form:
                wrappers.add(e.form)
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, i)
            i = end.start() if end else n
        if not page.startswith("/>", m.end() - 2) or name in BLOCK:
            open_.enter(e)
        if name in HEADING:
            heading, level = True, int(name[1])
    flush()
    return without_forms(out, wrappers)


def without_forms(parts: list[Part], wrappers: set[int]) -> list[Part]:
    """The parts with those of forms dropped, but for forms around the page: they hold an article, or most of what isn't dropped."""
    shown: dict[int, int] = {}
    for p in parts:
        if not p.dropped:
            shown[p.form] = shown.get(p.form, 0) + len(p.text)
    most = max(sum(shown.values()) / 2, LONG)
    for p in parts:
        p.dropped = p.dropped or p.form > 0 and p.form not in wrappers and (p.article > 0 or shown.get(p.form, 0) <= most)
    return parts


_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())


def stop_density(text: str) -> float:
    found = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0


def first_pass(parts: list[Part], trust_names: bool) -> tuple[list[bool | None], list[bool]]:
    """A label for each block, None where it is undecided; and which undecided ones are nearly good."""
    first: list[bool | None] = []
    near: list[bool] = []
    for p in parts:
        links = p.linked / len(p.text)
        near.append(False)
        if p.dropped:
            first.append(False)
        elif links > LINKS:
            first.append(None if p.article and len(p.text) < SHORT else False)
        elif p.doubted and trust_names:
            density = stop_density(p.text)
            first.append(density >= HIGH and len(p.text) >= LONG)
        elif p.heading or len(p.text) < SHORT:
            first.append(None)
        else:
            density = stop_density(p.text)
            if p.article:
                near[-1] = LOW / 2 <= density < LOW
                first.append(True if density >= LOW else None)
            else:
                near[-1] = density >= LOW
                first.append(True if density >= HIGH and len(p.text) >= LONG or density >= HIGH * 2 else None if density >= LOW else False)
    return first, near


def labels(parts: list[Part]) -> list[bool]:
    """Which blocks belong to the main text."""
    first, near = first_pass(parts, True)
    found = any(first)
    if not found:
        first, near = first_pass(parts, False)
        found = any(first)
    if not found and not any(p.article and not p.dropped for p in parts):  # perhaps a language without stop words here
        first = [True if not p.dropped and len(p.text) >= LONG / 2 and p.linked <= FEW_LINKS * len(p.text) else label for p, label in zip(parts, first, strict=True)]
    bare = not found and not any(p.article and not p.dropped for p in parts)  # a page of a few short blocks
    out = [False] * len(parts)
    a = 0
    while a < len(parts):
        b = a + 1
        while b < len(parts) and parts[b].article == parts[a].article:
            b += 1
        long = sum(len(p.text) for p, label in zip(parts[a:b], first[a:b], strict=True) if label is None and p.linked <= LINKS * len(p.text)) >= LONG
        edge = bare or parts[a].article > 0 and (not found or long or any(first[a:b]))
        inherit(parts, first, near, edge, a, b, out)
        a = b
    return out


def inherit(parts: list[Part], first: list[bool | None], near: list[bool], edge: bool, a: int, b: int, out: list[bool]) -> None:
    """Second pass over the blocks a to b, all inside one article or all outside, whose edges have the label ``edge``."""
    inside = parts[a].article > 0
    apart = lambda p: inside and (p.dropped or p.doubted)  # what an article embeds says nothing of its text
    before: list[tuple[int, bool]] = []
    last = (a - 1, edge)
    for k in range(a, b):
        if first[k] is not None and not apart(parts[k]):
            last = (k, first[k])
        before.append(last)
    nxt = (b, edge)
    for k in range(b - 1, a - 1, -1):
        label, p, prev = first[k], parts[k], before[k - a]
        if label is not None:
            nxt = nxt if apart(p) else (k, label)
            out[k] = label
        elif p.linked / len(p.text) > LINKS:  # mostly links, inside the article: stays only between good blocks
            out[k] = prev[0] >= a and prev[1] and nxt[0] < b and nxt[1]
        elif p.heading:
            out[k] = nxt[1]
        elif prev[1] == nxt[1]:
            out[k] = nxt[1]
        elif near[k]:
            out[k] = True
        else:
            out[k] = nxt[1] if nxt[0] - k < k - prev[0] else prev[1] if nxt[0] - k > k - prev[0] else inside


def main_text(page: str | None) -> str:
    if not page:
        return ""
    parts = blocks(page)
    return "\n".join(p.text for p, keep in zip(parts, labels(parts), strict=True) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows with ``text`` and ``n_chars`` in place of the html.

    Null, empty and text-free pages give an empty text. All other columns pass through, but for
    columns already named text or n_chars, which are replaced. Repeated rows all stay. Pages are read
    whole, in time proportional to their length, however deep they nest. An empty table stays empty.
    """
    passed = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([*(pages.schema[c] for c in passed), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(passed))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(passed))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*passed, html).mapInArrow(run, schema)


def op8_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
