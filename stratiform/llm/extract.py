"""Main text of web pages by two passes of block rules.

Pass one looks at each block alone. Length, link density and the density of stop words make
it good, nearly good, short or bad; where stop words say little, as in languages that are not
listed, sentences count: words that end in a full stop. Containers are one more signal:
elements that never hold main text (nav, footer, form, ...) and class words that name
boilerplate make a block bad; weaker class words (form, banner, widget, ...) do so unless the
block is good by its density. On pages with an article or main element that holds good
text, what lies outside is bad.
Pass two gives undecided blocks the label of the nearest decided neighbours.

Scanning takes time in proportion to the page, whatever its markup.

Cases: null or empty html, and pages without main text, give an empty text; broken markup
(unclosed, crossed or unknown elements) is read as far as it goes: a `<` that begins no tag is
text, a tag with an unclosed quote ends at its first `>`, and an unclosed element loses its
start tag only, but for script, style, textarea, title and iframe, which take the rest of
the page as they do in browsers; an empty table gives no rows; repeated rows and
page_ids stay rows of their own; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from .textops import portions

#: Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i if in is it its not of on or she so that the their
    they this to was we were which who will with you der die das den dem des ein eine einen einem einer und oder ist sind war
    mit von zu auf für als nicht auch es er sie wir ich im am bei nach aus wie le la les un une des du de et ou est sont dans
    sur pour par pas que qui avec au aux ce cette il elle nous vous se en plus el los las unos unas y o es son del al con por
    para no lo su sus como más pero""".split()
)
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their content is no markup: it ends at the end tag or with the page.
RAW = frozenset("script style textarea title iframe".split())
#: Elements that are skipped with what they hold if they end somewhere.
SKIPPED = frozenset("object svg math audio video canvas noscript template".split())
BAD_ELEMENTS = frozenset("nav aside footer form menu button select option dialog head search".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices notification popup newsletter subscribe subscription signup login comment comments respond reply replies disqus pagination pager toolbar copyright skiplink paywall".split())
#: Class words that also name harmless containers.
WEAK_WORDS = frozenset("form banner modal overlay share sharing social related recommended recommendations widget widgets skip alert".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Characters in which a tag's quotes must close, and tags on a page that may fail to do so; beyond that tags end at their first `>`.
LONGEST_TAG, MOST_BROKEN = 1 << 16, 50
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?+""", re.I)
WORD = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SENTENCE = re.compile(r"[.!?…](?=[\s\"'»”’)\]]|$)|[。！？।؟]")
REFERENCE_ZEROS, REFERENCE_LONG = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
SHORT, LONG = 70, 140
MANY_LINKS, SOME_STOP_WORDS, MANY_STOP_WORDS = 0.4, 0.15, 0.25
#: Words of a block that is read as sentences, and letters of one in a script without spaces between words.
SENTENCE_WORDS, SENTENCE_LETTERS = 8, 40
GOOD, NEAR, SHORT_TEXT, BAD = "good", "near", "short", "bad"


def decode(text: str) -> str:
    """Character references decoded, white space as one space, trimmed. Numbers beyond Unicode become U+FFFD."""
    if "&#" in text:
        text = REFERENCE_LONG.sub("�", REFERENCE_ZEROS.sub(r"&#\1", text))
    return SPACE.sub(" ", unescape(text)).strip()


def container(name: str, attributes: str, inside_article: bool) -> str:
    """What an element says of the text in it: bad, weak (bad unless the text is good) or nothing."""
    if name in BAD_ELEMENTS or name == "header" and not inside_article:
        return BAD
    if not attributes or name in ("html", "body", "main"):
        return ""
    out = ""
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return BAD
        if key == "role" and value in BAD_ROLES:
            return BAD
        if key in ("class", "id"):
            words = {w.lower() for w in CAMEL.findall(value)}
            if words & BAD_WORDS or "header" in words and not inside_article:
                return BAD
            if words & WEAK_WORDS:
                out = "weak"
    return out


def tags(html: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of all tags in page order; comments, declarations
    and the like have no name, a CDATA section is named so and has its text for attributes."""
    out: list[tuple[int, int, str, bool, str]] = []
    at, size, broken, cdata = 0, len(html), 0, True
    while (at := html.find("<", at)) >= 0:
        c = html[at + 1 : at + 2]
        if c == "!" or c == "?":
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                end = end + 3 if end >= 0 else size
            elif cdata and html.startswith("<![CDATA[", at):
                end = html.find("]]>", at)
                cdata = end >= 0
                if cdata:
                    out.append((at, end + 3, "![CDATA[", False, html[at + 9 : end]))
                    at = end + 3
                continue
            else:
                end = html.find(">", at) + 1
                if not end:
                    break
            out.append((at, end, "", False, ""))
            at = end
            continue
        m = TAG.match(html, at, min(size, at + LONGEST_TAG)) if broken < MOST_BROKEN else None
        if m:
            end, name, closing, attributes = m.end(), m[2].lower(), bool(m[1]), m[3]
        else:
            first = re.compile(r"/?[a-zA-Z][^\s/>]{0,99}").match(html, at + 1)
            end = html.find(">", at) + 1
            if not end:
                break
            if not first:
                at += 1
                continue
            broken += 1
            name, closing = first[0].lower().lstrip("/"), c == "/"
            attributes = html[first.end() : end - 1]
        out.append((at, end, name, closing, attributes))
        at = end
        if name in RAW and not closing:
            m = RAW_END[name].search(html, at)
            at = m.end() if m else size
            out[-1] = (out[-1][0], at, "", False, "")
    return out


class Block:
    __slots__ = ("text", "link", "kind", "inside", "head")

    def __init__(self, text: str, link: int, kind: str, inside: bool, head: bool):
        self.text, self.link, self.kind, self.inside, self.head = text, link, kind, inside, head


def blocks(html: str) -> list[Block]:
    """Text blocks in page order with what surrounds them: characters of links, the container's
    word, whether an article or main element is around, whether it is a heading."""
    found = tags(html)
    ends: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    for i, (_, _, name, closing, attributes) in enumerate(found):
        if name in SKIPPED:
            if closing:
                if begun.get(name):
                    ends[begun[name].pop()] = i
            elif not attributes.endswith("/"):
                begun.setdefault(name, []).append(i)
    stack: list[tuple[str, str, bool]] = []  # name, kind and article, both with those of the elements around
    count: dict[str, int] = {}
    parts: list[str] = []
    links: list[str] = []
    in_link, heading = False, False
    out: list[Block] = []

    def flush() -> None:
        nonlocal parts, links
        if parts:
            if text := decode("".join(parts)):
                _, kind, inside = stack[-1] if stack else ("", "", False)
                out.append(Block(text, len(decode("".join(links))) if links else 0, kind, inside, heading))
            parts, links = [], []

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                links.append(text)

    def close(i: int) -> None:
        for name, _, _ in stack[i:]:
            count[name] -= 1
        del stack[i:]

    i, at = 0, 0
    while i < len(found):
        start, end, name, closing, attributes = found[i]
        add(html[at:start])
        at = end
        if i in ends:
            i = ends[i]
            at = found[i][1]
        elif name == "a":
            in_link = not closing
        elif name == "br":
            add(" ")
        elif name == "![CDATA[":
            add(attributes.replace("&", "&amp;"))
        elif name in BLOCKS:
            flush()
            in_link = False
            if closing:
                heading = False
                if name != "p" and count.get(name):
                    close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            else:
                heading = name in HEADINGS
                while name == "body" and count.get("head"):
                    close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "head"))
                if name not in VOID and name not in ("p", "html", "body"):
                    _, kind, inside = stack[-1] if stack else ("", "", False)
                    here = container(name, attributes, inside) if kind != BAD else BAD
                    kind = BAD if here == BAD else here or kind
                    stack.append((name, kind, inside or name in ("article", "main") and kind != BAD))
                    count[name] = count.get(name, 0) + 1
        i += 1
    add(html[at:])
    flush()
    return out


def dense(block: Block) -> str:
    """The label by length, links and words alone."""
    n = len(block.text)
    if block.link > MANY_LINKS * n:
        return BAD
    if n < SHORT:
        return SHORT_TEXT
    words = WORD.findall(block.text.lower())
    share = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    sentence = bool(SENTENCE.search(block.text)) and (len(words) >= SENTENCE_WORDS or sum(map(len, words)) >= SENTENCE_LETTERS)
    if share >= MANY_STOP_WORDS or sentence:
        return GOOD if n >= LONG else NEAR
    return NEAR if share >= SOME_STOP_WORDS else SHORT_TEXT


def first_pass(every: list[Block]) -> list[str]:
    """Labels of blocks alone. Inside an article that holds good text, nothing that could be text is bad."""
    labels = [dense(b) for b in every]
    article = any(b.inside and b.kind != BAD and x == GOOD for b, x in zip(every, labels, strict=True))
    if not article and not any(x == GOOD and b.kind != BAD for b, x in zip(every, labels, strict=True)):
        article = any(b.inside and b.kind != BAD for b in every)
    out = []
    for b, x in zip(every, labels, strict=True):
        if b.kind == BAD or b.kind == "weak" and x != GOOD or article and not b.inside:
            out.append(BAD)
        elif article:
            out.append(GOOD if x == NEAR and len(b.text) >= SHORT and not b.link else x)
        else:
            out.append(BAD if x == SHORT_TEXT and (len(b.text) >= SHORT or b.link or "©" in b.text) else x)
    return out


def second_pass(labels: list[str], every: list[Block]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided neighbours on either side;
    where those differ, the nearer one's, and nearly good text and headings the better one."""
    n = len(labels)
    # what is boilerplate by its place says nothing about free text beside it
    speaks = [x == GOOD or x == BAD and b.kind == "" for x, b in zip(labels, every, strict=True)]

    def nearest(places: Iterator[int]) -> list[int]:
        out, seen = [-1] * n, {True: -1, False: -1}  # by whether the neighbour is inside an article
        for i in places:
            both = [j for j in ((seen[True],) if every[i].inside else seen.values()) if j >= 0]
            out[i] = min(both, key=lambda j: abs(i - j), default=-1)
            if speaks[i]:
                seen[every[i].inside] = i
        return out

    before, after = nearest(iter(range(n))), nearest(iter(range(n - 1, -1, -1)))
    keep = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            keep.append(label == GOOD)
            continue
        near = [(abs(i - j), labels[j]) for j in (before[i], after[i]) if j >= 0]
        kinds = {x for _, x in near}
        if len(kinds) == 1:
            keep.append(kinds == {GOOD} or label == NEAR and every[i].inside)
        elif not kinds or label == NEAR or every[i].head or every[i].inside:
            keep.append(True)
        else:
            keep.append(min(near)[1] == GOOD)
    return keep


def main_text(html: str) -> str:
    every = blocks(html)
    labels = first_pass(every)
    return "\n".join(b.text for b, good in zip(every, second_pass(labels, every), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2, 256):
                text = [main_text(h or "") for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
