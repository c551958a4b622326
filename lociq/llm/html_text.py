"""Main text of web pages by two-pass block rules.

A page is cut at block-level tags. The first pass gives each block a class from its
place (inside an article, or inside a menu, footer, form and the like), its link density,
its length and its density of stop words: good, bad, or, where it is short or between the
limits, undecided. The second pass gives undecided blocks the class of the nearest decided
neighbour, the earlier one in a tie, and headings that of the next decided block. A page
that names its article is held to it.

Null html is empty. Scripts, styles, comments and unclosed tails of these are dropped, and
so is a tag that never ends; a quotation mark without its counterpart ends with its tag.
Character references are decoded once; white space within a block becomes one space. A
link that is never closed ends with its block. Hidden blocks are left out.

A class or id marks an advert, a notice or reader comments where all of its word's parts
say so or only name a container; words that begin with a mark, as joined ones do, count as
that mark. Where some part says something else, a mark of comments counts by the form of
what it is on: elements beside each other with the same word, or with an author, a date, a
reply link or a field inside, unless they hold an article or its title. Roles, itemprop and itemtype count as well; an article
element is a comment by these or by a class word that begins with the mark. Words on the
state of comments (`has-comments`, `comments-open`) mark nothing. Marks that would leave an
article without any text do not count in that article. No block is shortened. Pages are
independent; repeated rows give a result each. Time grows with the page's length, whatever
it holds.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg iframe textarea title head".split())
TAG_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9-]*)")
QUOTE_OR_END = re.compile(r"[>\"']")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button label input".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, roles and words of class or id that mark what surrounds the main text.
AROUND = frozenset("nav footer header aside form menu dialog button select label option fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar comment".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent discussion disqus footer gdpr masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination paywall popup promo promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Beginnings of joined words that mark the like, and words of reader comments.
JOINED = re.compile("adsby|advert|breadcrumb|comment(?!ar|at)|cookie|disqus|gdpr|newsletter|paywall|sidebar|sponsor|subscri")
COMMENT = re.compile(r"(?:user|reader|post|blog|wp)?-?(?:comment(?!ar|at)|repl(?:y|ies)\b|respond|discussion|disqus)", re.I)
#: Parts of words that tell of comments' state or number, and of what stands in a comment.
STATES = frozenset("allow allowed closed count disabled enabled has no off on open with without".split())
IN_COMMENTS = frozenset("author avatar byline date fn nickname permalink reply time timestamp upvote user username vote votes".split())
FIELDS = frozenset("time textarea input button form".split())
#: An attribute's ways of hiding what it is on.
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)", re.I)
#: Words that only say that something is a container, of the page or of one of its kinds.
CONTAINERS = frozenset(
    "area articles author avatar bar block body box btn button buttons card cards column container content cta footer form group header holder icons inner items left link links list main media message meta "
    "module node outer panel post posts primary reader right root row secondary section signup site slot stories text thread threaded top bottom tree unit user wrap wrapper overlay policy".split()
)
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))""")
VALUES = re.compile(r"""=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>]++)""")
#: Enclosing elements that may be comments, of which a block remembers the innermost.
MOST_AROUND = 8
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Words so common that running text is full of them (fixed values).
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on as with be by at this are or from an not have you he she they we "
    "der die das und zu den mit von für auf ist im dem nicht ein eine des sich auch es er sie "
    "de la le et les en un une du que est pour qui dans par au sur pas avec il elle "
    "el y los se del las por con no su lo como más pero".split()
)
#: Limits of the first pass.
LINKS_HIGH, STOPS_LOW, STOPS_HIGH, SHORT, LONG = 0.4, 0.12, 0.28, 70, 200


class Block(NamedTuple):
    text: str
    linked: int
    heading: bool
    inside: bool
    around: bool
    marked: bool
    perhaps: tuple  # of what around it may be comments: [looks like one, holds an article]


def is_marked(names: str) -> bool:
    """Whether one of the class or id words marks what surrounds the main text."""
    for name in names.split():
        parts = parts_of(name)
        marks = [p in MARKS or bool(JOINED.match(p)) for p in parts]
        if any(marks) and all(m or p in CONTAINERS for m, p in zip(marks, parts)) and not STATES.intersection(parts):
            return True
    return False


def parts_of(name: str) -> list[str]:
    return [p.lower() for p in WORD_PARTS.findall(name) if not p.isdigit()]


def comment_words(names: str, begin: bool = False) -> list[str]:
    """The class or id words that speak of reader comments, in any of their parts or, where
    asked, from their beginning on."""
    find = COMMENT.match if begin else COMMENT.search
    return [n for n in names.split() if find(n) and not STATES.intersection(parts_of(n))]


class Finder:
    """The next place of a pattern; a place is kept until it is passed, and that there is
    none is found once."""

    def __init__(self, page: str, pattern: re.Pattern):
        self.page, self.pattern, self.at = page, pattern, -1

    def after(self, at: int) -> int:
        if 0 <= self.at < at or self.at == -1:
            m = self.pattern.search(self.page, at)
            self.at = m.start() if m else len(self.page) + 1
        return self.at


class Tags:
    """The page's tags in order: (start, end, name, closing, attributes); name is empty for
    comments and declarations. A mark of quotation counts as one where its counterpart
    ends a value; otherwise the tag ends at its first closing bracket."""

    def __init__(self, page: str):
        self.page, self.ends = page, Finder(page, re.compile(">"))
        self.quotes = {q: Finder(page, re.compile(q)) for q in "\"'"}
        self.raw: dict[str, Finder] = {}

    def end_of(self, at: int) -> int:
        """Past the bracket that ends the tag whose attributes begin at a place."""
        page, n, first = self.page, len(self.page), self.ends.after(at)
        while True:
            m = QUOTE_OR_END.search(page, at)
            if m is None:
                return n + 1
            if m.group() == ">":
                return m.end()
            close = self.quotes[m.group()].after(m.end())
            if close >= n or (page[close + 1 : close + 2] or ">") not in " \t\r\n\f/>":
                return first + 1 if first < n else n + 1
            at = close + 1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        page, n = self.page, len(self.page)
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else n, "", False, ""
            if page[start + 1 : start + 2] in ("!", "?"):
                end = self.ends.after(start)
                return start, min(end + 1, n), "", False, ""
            m = TAG_NAME.match(page, start + 1)
            if m:
                end = self.end_of(m.end())
                return start, min(end, n), m[1].lower(), page[start + 1] == "/", page[m.end() : end - 1]
            at = start + 1
        return None

    def past(self, name: str, at: int) -> int:
        """Past the closing tag of a raw element, or the page's length."""
        if name not in self.raw:
            self.raw[name] = Finder(self.page, re.compile(rf"</{name}\b", re.I))
        close = self.raw[name].after(at)
        return min(self.ends.after(close) + 1, len(self.page)) if close < len(self.page) else len(self.page)


def blocks(page: str) -> list[Block]:
    """The page's text by blocks, in one pass over its tags."""
    out: list[Block] = []
    parts: list[str] = []
    linked, link, heading = 0, "", False  # link: "", "closed" where its end is known, "open"
    # name; article, around, marked, perhaps, all inherited; comment words of its children
    stack: list[tuple[str, bool, bool, bool, tuple, dict]] = []
    held: Counter = Counter()  # open elements by name
    outside: dict = {}
    article = around = marked = False
    perhaps: tuple = ()
    tags, link_ends, link_starts = Tags(page), Finder(page, re.compile(r"</a\b", re.I)), Finder(page, re.compile(r"<a\b", re.I))

    def flush():
        nonlocal parts, linked, link
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, min(linked, len(text)), heading, article, around, marked, perhaps))
        parts, linked = [], 0
        link = "" if link == "open" else link

    def say(piece: str):
        nonlocal linked
        parts.append(piece)
        if link:
            linked += len(html.unescape(piece).strip())

    at, end = 0, len(page)
    while at < end:
        tag = tags.next(at)
        if tag is None:
            say(page[at:])
            break
        start, after, name, closing, attributes = tag
        if start > at:
            say(page[at:start])
        at = after
        if name in RAW and not closing:
            if perhaps and name in FIELDS:
                perhaps[-1][0] = True
            if not attributes.endswith("/"):
                past = tags.past(name, at)
                at = at if name == "head" and past >= end else past
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            link = ""
            if not closing and re.search(r"\bhref\b", attributes, re.I):
                link = "closed" if link_ends.after(at) < min(link_starts.after(at), end) else "open"
        if name in BLOCKS:
            flush()
            heading = name in HEADINGS and not closing
        if closing:
            if held[name]:
                while True:
                    last = stack.pop()[0]
                    held[last] -= 1
                    if last == name:
                        break
        elif name in BLOCKS or name in ("span", "amp-ad", "ins") or (perhaps and name in ("time", "a", "img", "cite", "b", "strong")):
            if perhaps and (name in FIELDS or any(IN_COMMENTS.intersection(parts_of(v)) for k, *v in ATTRIBUTE.findall(attributes) if k.lower() in ("class", "rel", "itemprop") for v in ["".join(v)])):
                perhaps[-1][0] = True
            if name in VOID or (name not in BLOCKS and name not in ("span", "amp-ad", "ins")):
                continue
            if name in ("p", "li") and stack and stack[-1][0] == name:
                held[stack.pop()[0]] -= 1
            _, was_article, was_around, was_marked, was_perhaps, beside = stack[-1] if stack else ("", False, False, False, (), outside)
            own = {a.lower(): (b or c or d) for a, b, c, d in ATTRIBUTE.findall(attributes)}
            role = own.get("role", "").lower()
            is_article = was_article or name in ("article", "main") or role in ("main", "article")
            header_of_article = name == "header" and was_article
            is_around = was_around or (name in AROUND and not header_of_article) or role in ROLES
            if name in ("article", "main", "h1"):
                for one in perhaps:
                    one[1] = True
            names = f"{own.get('class', '')} {own.get('id', '')}"
            typed = own.get("itemprop", "").lower() == "comment" or own.get("itemtype", "").endswith(("Comment", "UserComments", "WPAdBlock"))
            hidden = bool(HIDDEN.search(own.get("style", ""))) or (bool(BARE_HIDDEN.search(attributes)) and bool(BARE_HIDDEN.search(VALUES.sub("", attributes))))
            if name == "article":
                by_name = bool(comment_words(names, begin=True))
            else:
                by_name = name not in ("html", "body", "main") and is_marked(names)
            if name == "article" and (by_name or typed):
                is_article = was_article
            is_perhaps = was_perhaps
            if not by_name and name not in ("html", "body", "main", "article") and (words := comment_words(own.get("class", ""))):
                one = [False, False]
                is_perhaps = (*was_perhaps[-MOST_AROUND:], one)
                for word in words:
                    if word in beside:
                        one[0] = beside[word][0] = True
                    else:
                        beside[word] = one
            stack.append((name, is_article, is_around, was_marked or by_name or typed or hidden, is_perhaps, {}))
            held[name] += 1
        if stack:
            _, article, around, marked, perhaps, _ = stack[-1]
        else:
            article = around = marked = False
            perhaps = ()
    flush()
    out = [b._replace(marked=b.marked or any(sure and not more for sure, more in b.perhaps)) for b in out]
    # Marks that would leave nothing of an article are no marks there.
    if any(b.inside for b in out) and not any(b.inside and not b.around and not b.marked for b in out):
        out = [b._replace(marked=b.marked and not b.inside) for b in out]
    return [b._replace(around=b.around or b.marked) for b in out]


def first_pass(block: Block, has_article: bool) -> str | None:
    """good, bad, or None where the block alone does not tell."""
    length, links = len(block.text), block.linked / len(block.text)
    if block.around or (has_article and not block.inside):
        return "bad"
    if links > LINKS_HIGH:
        return "bad"
    if block.inside:
        return None if block.heading or length < SHORT else "good"
    if block.heading or length < SHORT:
        return "bad" if links > 0 else None
    words = block.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if stops >= STOPS_HIGH or (stops >= STOPS_LOW and length >= LONG):
        return "good"
    return "bad" if stops < STOPS_LOW else None


def second_pass(found: list[Block], classes: list[str | None]) -> list[bool]:
    """Undecided blocks take the nearest decided class; without any, text is kept where
    it lies in an article."""
    n = len(found)
    after: list[tuple[int, str] | None] = [None] * n
    seen = None
    for i in range(n - 1, -1, -1):
        seen = (i, classes[i]) if classes[i] else seen
        after[i] = seen
    out, seen = [], None
    for i, own in enumerate(classes):
        if own is None:
            later = after[i]
            if found[i].inside:  # within the article its own blocks are the neighbours
                near = "good"
            elif seen is None or later is None or found[i].heading:
                near = (later or seen or (0, "good"))[1]  # nothing speaks against it
            else:
                near = seen[1] if i - seen[0] <= later[0] - i else later[1]
            out.append(near == "good")
        else:
            seen = (i, own)
            out.append(own == "good")
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    has_article = any(b.inside and not b.around for b in found)
    kept = second_pass(found, [first_pass(b, has_article) for b in found])
    return "\n".join(b.text for b, good in zip(found, kept) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: its id and url, text, n_chars."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch["h"]]
            yield pd.DataFrame({"k": batch["k"], "u": batch["u"], "text": texts, "n_chars": list(map(len, texts))})

    rows = pages.select(F.col(id_col).alias("k"), F.col(url_col).alias("u"), F.coalesce(html_col, F.lit("")).alias("h"))
    out = rows.mapInPandas(run, f"k {kinds[0]}, u {kinds[1]}, text string, n_chars bigint")
    return out.withColumnsRenamed({"k": id_col, "u": url_col})
