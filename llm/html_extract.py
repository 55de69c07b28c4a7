"""Main text of web pages by line-block distribution.

Markup is read once, left to right.  Block elements break the page into *lines*; inline
elements and ``br`` do not.  A line's length counts its characters (no spaces), but for links of under ``LABEL_WORDS`` words.
Lines of boilerplate elements (menus, headers, footers, sidebars, notices, adverts, forms, comments,
told by element, role, class or id) have length 0 and are never kept, as are scripts, styles
and markup.  A name tells boilerplate as a whole class or id, as its last word, or as its first before a word for a
box (``share-buttons``); paragraphs and headings of an article by the plainest names only.  An end tag left out is implied by the
elements that end it in HTML (``p``, ``li``, ``dt``, ``dd``, ``option``, table rows and cells, ``head``).

*Pardon.*  An element is no boilerplate if all of the page's marked articles (``article`` or ``main``) lie in it, or, on a page
without a marked article, most of its text: more than half where class, role or a form tells it, more than ``ELEMENT_SHARE`` where
the element itself does.  So a page-wide form, a layout class or a menu that is never closed empties no page.

*Windows.*  The lengths of every window of ``WINDOW`` lines are summed; the page's threshold is ``DENSE`` times
the sum around an average character, that is the mean of the sums weighted by themselves.  A block
is a run of windows whose sums are not zero, cut to what lies between its first *surge* above the
threshold and its last *dive* below; a run that never surges is dropped.  So menus and notices of short lines
without a class are left out unless they lie within a window of dense text, and a real section stays
however small it is beside the longest.  Inside a block every line counts, also short ones and links.

*Marks as weights.*  Where a page marks its article, lines outside it have length 0 and every line inside is longer by a bonus
that alone lifts a window above the threshold.  Without the bonus the same windows reproduce 2,065 of the 2,500 articles of sf0.1 and
lose 1,244 of their 26,247 lines, of 50 characters on the mean.

Character references are decoded, white space inside a line becomes one space, lines are
trimmed and joined in page order by two line feeds.  A null, empty or textless page gives
an empty text.  Markup that is cut off or never closed is read as far as it goes; time grows with the
page's length, however deep its elements nest.  Pages are
handled one by one, so ties, repeated rows and empty tables need no rule; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from llm.common import small_batches

WINDOW = 3
DENSE = 0.25
#: Links of fewer words are labels, not text.
LABEL_WORDS = 10
#: The share of a page's text that an element told by class, role or a form, or by itself, must exceed to be its text.
NAMED_SHARE, ELEMENT_SHARE = 0.5, 0.9

SILENT = ("script", "style", "template", "noscript", "svg", "math", "iframe", "object", "textarea", "title", "xmp")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<silent>" + "|".join(SILENT) + r")(?=[\s/>])[^>]*(?:/>|>(?:.*?</(?P=silent)\s*>|.*\Z))"
    r"|</?(?P<name>[a-zA-Z][^\s/>\"']*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split())
#: (openers, ended, stops): an opener ends the outermost open element of *ended* that no element of *stops* shields.
IMPLIED = [(frozenset(openers), frozenset(ended), frozenset(stops)) for openers, ended, stops in (
    (BLOCK - {"html", "head"} | {"body"}, ("head",), ()),
    (("li",), ("li",), BLOCK - {"li", "address", "div", "p"}),
    (("dt", "dd"), ("dt", "dd"), BLOCK - {"dt", "dd", "address", "div", "p"}),
    (("option",), ("option",), ("select", "optgroup", "datalist")),
    (("optgroup",), ("option", "optgroup"), ("select",)),
    (("td", "th"), ("td", "th"), ("tr", "table")),
    (("tr",), ("tr", "td", "th"), ("tbody", "thead", "tfoot", "table")),
    (("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    (BLOCK - {"html", "head", "legend", "option", "optgroup", "select", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"},
     ("p",), ("button", "table", "caption", "td", "th", "select")))]
#: Per element name, the numbers of the rules that it opens, is ended by and shields from.
OPENS, ENDS, SHIELDS = ({name: [k for k, rule in enumerate(IMPLIED) if name in rule[part]]
                         for name in frozenset().union(*(rule[part] for rule in IMPLIED))} for part in range(3))
ZONE = frozenset(("article", "main"))
BOILERPLATE = frozenset("nav footer aside form dialog menu select button head".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar "
    "navigation sidebar footer header masthead topbar breadcrumb breadcrumbs comment comments commentlist disqus respond replies "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login signin share sharing social "
    "related recommended recommendations widget widgets toolbar pagination pager copyright disclaimer alert skip".split())
#: What tells boilerplate even of a paragraph inside the article.
PLAINEST_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies consent gdpr newsletter subscribe "
    "signup share sharing social comment comments disqus pagination".split())
#: Words for boxes: before them the first word of a name tells what the box holds.
BOXES = frozenset(
    "bar block bottom box button buttons container content form group inner item items left link links list main outer panel primary "
    "right row secondary section slot text top unit wrap wrapper".split())
NOT_BOILERPLATE = frozenset(("with", "has", "no", "without"))
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figure figcaption caption".split())
BY_ELEMENT, BY_NAME = 1, 2


def names_boilerplate(value: str, names: frozenset[str], in_zone: bool) -> bool:
    """Whether a class or id, lower-cased, is a name of boilerplate."""
    for part in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", part) if w]
        if not words or NOT_BOILERPLATE.intersection(words) or in_zone and "header" in words:
            continue
        if words[-1] in names or words[0] in names and BOXES.issuperset(words[1:]):
            return True
    return False


def boilerplate(name: str, attributes: str, in_zone: bool) -> int:
    """How an element tells that it holds no main text, or 0.  An article's own header keeps its headline."""
    if name == "form":
        return BY_NAME
    if name in BOILERPLATE or (name == "header" and not in_zone):
        return BY_ELEMENT
    if not attributes or name in ("html", "body"):
        return 0
    names = PLAINEST_NAMES if name in ZONE or in_zone and name in TEXT_LEVEL else BOILERPLATE_NAMES
    for match in ATTRIBUTE.finditer(attributes):
        key = match[1].lower()
        value = (match[2] or match[3] or match[4] or "").lower()
        if (key == "hidden" or key == "aria-hidden" and value == "true"
                or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)
                or key == "role" and value in BOILERPLATE_ROLES
                or key in ("class", "id") and names_boilerplate(value, names, in_zone)):
            return BY_NAME
    return 0


class Line:
    __slots__ = ("length", "scope", "text", "zone")

    def __init__(self, text: str, length: int, zone: bool, scope: int) -> None:
        self.text, self.length, self.zone, self.scope = text, length, zone, scope


class Page:
    """The lines of a page; *scope* numbers the innermost boilerplate element around a line, 0 if there is none."""

    def __init__(self, html: str) -> None:
        self.lines: list[Line] = []
        self.parent, self.told = [0], [0]  # by scope: the scope around it, and how it was told
        self.zones: list[int] = []  # the scopes that the articles lie in
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, bool, bool]] = []  # open elements, whether they are scopes and zones
        count: Counter[str] = Counter()
        ended: list[list[int]] = [[] for _ in IMPLIED]  # by rule: depths of open elements that it ends
        shields: list[list[int]] = [[] for _ in IMPLIED]
        pieces: list[str] = []
        scope = zone = linked = anchor_chars = anchor_words = 0

        def end_anchor() -> None:
            nonlocal linked, anchor_chars, anchor_words
            if anchor_words < LABEL_WORDS:
                linked += anchor_chars
            anchor_chars = anchor_words = 0

        def end_line() -> None:
            nonlocal linked
            end_anchor()
            if pieces:
                words = unescape("".join(pieces)).split()
                if words:
                    length = max(0, sum(map(len, words)) - linked)
                    self.lines.append(Line(" ".join(words), length, zone > 0, scope))
                pieces.clear()
            linked = 0

        def cut(depth: int) -> None:
            nonlocal scope, zone
            if any(is_scope for _, is_scope, _ in stack[depth:]):
                end_line()
            for name, is_scope, is_zone in stack[depth:]:
                count[name] -= 1
                zone -= is_zone
                if is_scope:
                    scope = self.parent[scope]
                if name == "a" and not count[name]:
                    end_anchor()
            del stack[depth:]
            for depths in (*ended, *shields):
                while depths and depths[-1] >= depth:
                    depths.pop()

        for token in TOKEN.finditer(html):
            if token.lastgroup == "text":
                pieces.append(token[0])
                if count["a"]:
                    words = unescape(token[0]).split()
                    anchor_chars += sum(map(len, words))
                    anchor_words += len(words)
                continue
            name = (token["name"] or "").lower()
            if not name:
                continue
            if name == "br":
                pieces.append(" ")
                continue
            if name in BLOCK:
                end_line()
            if token[0][1] == "/":
                if count[name]:
                    depth = len(stack) - 1
                    while stack[depth][0] != name:
                        depth -= 1
                    cut(depth)
                continue
            for rule in OPENS.get(name, ()):
                # The outermost element above the last shield; what is cut was opened once, so time stays linear.
                first = bisect_right(ended[rule], shields[rule][-1]) if shields[rule] else 0
                if first < len(ended[rule]):
                    cut(ended[rule][first])
            if name in VOID or token["rest"].endswith("/"):
                continue
            told = boilerplate(name, token["rest"], zone > 0)
            if told:
                end_line()
                self.parent.append(scope)
                self.told.append(told)
                scope = len(self.parent) - 1
            is_zone = name in ZONE and not told
            if is_zone:
                self.zones.append(scope)
            depth = len(stack)
            stack.append((name, bool(told), is_zone))
            count[name] += 1
            zone += is_zone
            for rule in ENDS.get(name, ()):
                ended[rule].append(depth)
            for rule in SHIELDS.get(name, ()):
                shields[rule].append(depth)
        end_line()

    def _dropped(self, pardoned: set[int]) -> list[bool]:
        """By scope, whether it or a scope around it is boilerplate."""
        dropped = [False] * len(self.parent)
        for k in range(1, len(dropped)):
            dropped[k] = dropped[self.parent[k]] or k not in pardoned
        return dropped

    def article(self) -> list[bool] | None:
        """Which lines a marked article holds; None without such a line."""
        pardoned: set[int] = set()
        if self.zones and 0 not in self.zones:
            for k in self.zones:
                while k and k not in pardoned:
                    pardoned.add(k)
                    k = self.parent[k]
        dropped = self._dropped(pardoned)
        held = [line.zone and not dropped[line.scope] for line in self.lines]
        return held if any(held) else None

    def unmarked(self) -> list[bool]:
        """Which lines lie in no boilerplate, on a page without a marked article."""
        sums = [0] * len(self.parent)
        for line in self.lines:
            sums[line.scope] += line.length
        for k in range(len(sums) - 1, 0, -1):  # a scope comes after the one around it
            sums[self.parent[k]] += sums[k]
        shares = {BY_ELEMENT: ELEMENT_SHARE, BY_NAME: NAMED_SHARE}
        dropped = self._dropped({k for k in range(1, len(sums)) if sums[k] > shares[self.told[k]] * sums[0]})
        return [not dropped[line.scope] for line in self.lines]


def window_sums(lengths: list[int], window: int) -> list[int]:
    below = list(accumulate(lengths, initial=0))
    return [below[min(i + window, len(lengths))] - below[i] for i in range(max(len(lengths) - window, 0) + 1)]


def density(sums: list[int], dense: float) -> float:
    """The threshold of a page: *dense* times the mean of its window sums weighted by themselves."""
    return dense * sum(x * x for x in sums) / max(sum(sums), 1)


def text_blocks(lengths: list[int], window: int = WINDOW, dense: float = DENSE) -> list[tuple[int, int]]:
    """(surge, dive): first and last line with text of every block of windows that holds dense text."""
    sums = window_sums(lengths, window)
    threshold = density(sums, dense)
    blocks: list[tuple[int, int]] = []
    fresh = True
    for i, total in enumerate(sums):
        if not total:
            fresh = True  # the sum fell to zero, so what follows is another block
        elif total > threshold:
            start = i if fresh else blocks.pop()[0]
            blocks.append((start, min(i + window, len(lengths)) - 1))
            fresh = False
    spans = ([k for k in range(s, e + 1) if lengths[k]] for s, e in blocks)
    return [(x[0], x[-1]) for x in spans]


def main_text(html: str | None) -> str:
    page = Page(html or "")
    held = page.article()
    marked = held is not None
    held = held if marked else page.unmarked()
    texts: list[str] = []
    lengths: list[int] = []
    for line, inside in zip(page.lines, held, strict=True):
        if inside:
            texts.append(line.text)
            lengths.append(line.length)
        elif lengths and texts[-1]:  # boilerplate between two lines keeps their windows apart by one line
            texts.append("")
            lengths.append(0)
    if marked:  # a bonus of twice the heaviest window outweighs any threshold, as that is below the heaviest sum
        bonus = 2 * max(window_sums(lengths, WINDOW), default=0) + 1
        lengths = [length + bonus if text else 0 for text, length in zip(texts, lengths, strict=True)]
    return "\n\n".join(text for s, e in text_blocks(lengths) for text in texts[s:e + 1] if text)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of *pages* (page_id, url, html)."""
    small_batches(pages.sparkSession)

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kind = pages.select("page_id").schema[0].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        extract, f"page_id {kind}, url string, text string, n_chars long")
