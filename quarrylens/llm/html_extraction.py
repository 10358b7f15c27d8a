"""HTML extraction by line-block distribution.

1. Strip markup.  Tags become lines: each block element is one line of text, with its length
   less the length of its links.  Scripts, styles, the head, media and drawings are markup and
   go (the head ends where body text or an element not allowed in it begins, buttons, media and
   such at their end tag; without one, a list of options or a drawing holds only its own
   elements).  Lines of elements that are menus, footers, sidebars, forms or dialogs by tag or
   role, of page headers, and of hidden elements have length 0.
2. Weigh names.  A class or id that says ``ad``, ``comments`` or ``share`` is a doubt about its
   element, never a verdict: what the lines of the element hold decides (see ``_believed``).  A
   doubt that is believed makes their lengths 0.
3. Sum the lengths over sliding windows of WINDOW lines.  The text surges at the first window
   whose sum leaves zero and dives at the first that falls back to it.  ``WINDOW`` empty lines
   stand where lines of length 0 for the reasons above begin and end, and at the borders of an
   article or main element.
4. Keep text between a surge and its dive.  The run of the largest sum is the body; lines in an
   article or main element count ``ELEMENT_WEIGHT`` times, lines whose class or id names a body
   ``NAME_WEIGHT`` times.  Other runs stay if their sum is at least ``RUN_SHARE_PCT`` per cent
   of the body's, or if they are within such an element or name as the body is.  Of the rest,
   headings and paragraphs stay that stand in the body's own container or in one around it, so
   a title, a lead or a last paragraph is not lost to the links between; beyond an article
   element, where the body is in one, nothing is looked for.  A body's first and last lines go
   if they are short bare text of another container that shares only the page with it.

Lines keep page order, joined by one newline; white space inside a line is one space;
character references are decoded.

Defined cases: null html is an empty page; a page without text gives the empty text; markup
that is cut off or not closed is read as far as it goes; repeated rows are extracted each;
pages of any length are read whole; columns of the input pass through, and result columns
whose names are taken get underscores in front.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarrylens.llm.common import fresh_name

WINDOW = 3
RUN_SHARE_PCT = 30
ELEMENT_WEIGHT, NAME_WEIGHT = 4, 2
FEW_CHARS = 80

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_PART = re.compile(r"[a-z]+")

_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption td th".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("b i em strong u s small big sub sup font code kbd samp var cite q mark abbr acronym tt strike del ins bdi bdo dfn time data ruby rt rp label".split())
_CUT_TAGS = frozenset("nav aside footer form menu dialog".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of names that raise a doubt, the surer ones first.
_SURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer footnav gdpr"
    " masthead menu menus nav navbar navigation newsletter pager pagination promo promoted promotion sidebar sidebars signup sponsor sponsored subscribe subscription topbar".split()
)
_UNSURE = frozenset("alert banner discussion dropdown header login modal notice notices overlay popup recommended related replies respond search share sharing skip social toolbar widget widgets".split())
#: Parts that only say where or of what shape: with one of these a doubtful part still means what it says.
_SHAPES = frozenset(
    "area article bar block body bottom box btn button buttons card col column container content count desktop element entry field first fixed form full global group head holder icon icons info inner item items js"
    " last layout left line link links list main meta mobile module outer page pane panel placeholder post primary region right row secondary section single site slot small sticky text thread title top unit view wide wrap wrapper".split()
)
_BODY_PARTS = frozenset("article entry post story content main".split())
#: How much is believed of a name: a part among words of another meaning (``ad-hoc``), an unsure part, a sure one.
_HINT, _DOUBT, _STRONG = 1, 2, 3
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of text, which belong to the container around them.
_TEXT_BLOCKS = _HEADINGS | frozenset("p li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption address hgroup".split())
_NOTICE = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
#: How surely a line is inside the article: by an element of that meaning, or by a name.
_BY_ELEMENT, _BY_NAME = 2, 1
#: Closing one of these does not reach beyond a sectioning element.
_SECTIONS = frozenset("article main nav aside header footer section form body td th table".split())
_SELF_ENDING = frozenset("p li dt dd tr td th option".split())
#: Cut without a gap, so that the text around them stays one line.
_HELD = frozenset("noscript template svg math object canvas audio video select button".split())
_SINGLE = frozenset("select button".split())  # these do not nest: the next start closes the one before
_FOREIGN = frozenset("svg math".split())
#: Without an end tag these hold only their own elements, and end before any other; the rest of _HELD hold nothing then.
_OWN_ONLY = frozenset("select svg math".split())
_IN_SELECT = frozenset("option optgroup hr".split())
_CONTROLS = frozenset("form input select button".split())
_HEAD_TAGS = frozenset("head html base basefont bgsound link meta noscript template".split())


class _Open:
    __slots__ = ("main", "cut", "name", "held", "loose", "block", "below", "mute", "doubt")

    def __init__(self, name: str, cut: bool, main: int, held: bool = False, loose: bool = False):
        self.name, self.cut, self.main, self.held, self.loose = name, cut, main, held, loose
        self.block: _Open = self  # the block element around its text
        self.below: _Open | None = None  # the element that it stands in
        self.mute = held  # its text is markup
        self.doubt: tuple[int, int, int] | None = None  # grade of the doubt, lines and form controls before it

    def within(self, below: "_Open") -> "_Open":
        self.mute = self.mute or below.mute
        self.below = below
        self.block = self if self.name in _BLOCKS else below.block
        return self

    def container(self) -> "_Open":
        """The block around a block of text, or the block itself."""
        at = self
        while at.below is not None and (at.name in _TEXT_BLOCKS or at.name not in _BLOCKS):
            at = at.below
        return at


def _grade(token: str) -> int:
    """How much a doubt about one word of a class or an id counts; 0 where it raises none."""
    parts = set(_PART.findall(token))
    if parts & _BODY_PARTS:
        parts.discard("header")  # the header of an article is part of it
    bad = parts & (_SURE | _UNSURE)
    if not bad:
        return 0
    if parts - bad - _SHAPES:
        return _HINT
    return _STRONG if bad & _SURE else _DOUBT


def _facts(attributes: str) -> tuple[set[str], str, bool]:
    """Words of class and id, the role, and whether the element is hidden."""
    parts: set[str] = set()
    role, hidden = "", False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            parts.update(value.split())
        elif name == "role":
            role = value
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return parts, role, hidden


class _Line(NamedTuple):
    text: str
    chars: int  # without spaces
    linked: int  # of its links
    main: int  # how surely inside the article
    cut: bool
    block: _Open


class _Doubt(NamedTuple):
    first: int  # lines from here
    end: int  # to before here
    grade: int
    controls: bool
    heading: bool
    inside: bool  # of an article or main element


class _Lines:
    """Lines of a page and doubts about some of them."""

    def __init__(self):
        self.lines: list[_Line] = []
        self.doubts: list[_Doubt] = []
        self.pieces: list[str] = []
        self.linked = self.controls = 0

    def text(self, raw: str, in_link: bool) -> None:
        raw = references.unescape(raw) if "&" in raw else raw
        self.pieces.append(raw)
        if in_link:
            self.linked += len("".join(raw.split()))

    def end(self, top: _Open) -> None:
        if self.pieces:
            line = " ".join("".join(self.pieces).split())
            if line:
                self.lines.append(_Line(line, len(line.replace(" ", "")), self.linked, top.main, top.cut, top.block))
            self.pieces, self.linked = [], 0

    def settle(self, top: _Open) -> None:
        """Note the lines of an element whose name is in doubt."""
        grade, first, controls = top.doubt
        if first < len(self.lines):
            self.doubts.append(_Doubt(first, len(self.lines), grade, self.controls > controls, top.name in _HEADINGS, top.main == _BY_ELEMENT))


def _believed(lines: list[_Line], doubts: list[_Doubt]) -> list[bool]:
    """Whether each line is in an element that is what its name says.

    A name is believed if half of the element's text or more is links or if it holds controls
    of a form.  Unless it is a mere part among words of another meaning, it is also believed of
    a few words without a sentence that are no heading.  Sure names inside an article are
    believed of elements of at most a third as much text as the lines in no doubt, and of those
    after its last such line; outside of one, all names are believed on a page with such lines,
    and else of elements that do not hold most of its text.
    """

    def sums(numbers: Iterable[int]) -> list[int]:
        return [0, *accumulate(numbers)]

    chars = sums(0 if x.cut else x.chars for x in lines)
    linked = sums(0 if x.cut else x.linked for x in lines)
    sentences = sums(not x.cut and x.text[-1] in ".!?:…。" for x in lines)
    covered = [0] * (len(lines) + 1)
    for d in doubts:
        if d.grade > _HINT:
            covered[d.first] += 1
            covered[d.end] -= 1
    free = [not n and not x.cut for n, x in zip(accumulate(covered), lines)]
    clear = sum(x.chars for x, f in zip(lines, free) if f and x.main == _BY_ELEMENT)
    last_clear = max((i for i, x in enumerate(lines) if free[i] and x.main == _BY_ELEMENT), default=-1)
    cut = [0] * (len(lines) + 1)
    for d in doubts:
        own = chars[d.end] - chars[d.first]
        good = 2 * (linked[d.end] - linked[d.first]) >= own or d.controls
        if not good and d.grade > _HINT:
            good = own < FEW_CHARS and sentences[d.end] == sentences[d.first] and not d.heading
            if not d.inside:
                good = good or clear > 0 or 2 * own <= chars[-1]
            elif d.grade == _STRONG:
                good = good or 3 * own <= clear or 0 <= last_clear < d.first
        if good:
            cut[d.first] += 1
            cut[d.end] -= 1
    return [n > 0 for n in accumulate(cut)][: len(lines)]


def _closed(tokens: list[re.Match], page: str) -> set[int]:
    """Where those elements of _HELD start that have an end tag of their own."""
    out: set[int] = set()
    waiting: dict[str, list[int]] = {}
    for m in tokens:
        name = (m["name"] or m["name2"] or "").lower()
        if name in _HELD:
            starts = waiting.setdefault(name, [])
            if page.startswith("</", m.start()):
                if starts:
                    out.add(starts.pop())
            elif not (name in _FOREIGN and (m["attrs"] or m["attrs2"] or "").endswith("/")):
                if name in _SINGLE:
                    starts.clear()
                starts.append(m.start())
    return out


def _strip(page: str) -> _Lines:
    out = _Lines()
    tokens = list(_TOKEN.finditer(page))
    closed = _closed(tokens, page)
    stack: list[_Open] = [_Open("", False, 0)]
    in_link = False
    at = 0

    whole = loose = 0  # open elements of _HELD with and without an end tag

    def leave(until: int) -> None:
        nonlocal whole, loose
        while len(stack) > until:
            gone = stack.pop()
            if gone.held and gone.name != "head":
                whole, loose = whole - (not gone.loose), loose - gone.loose
            if gone.doubt:
                out.end(gone)
                out.settle(gone)
            elif gone.cut != stack[-1].cut or gone.main != stack[-1].main:
                if not gone.held:
                    out.end(gone)

    for m in tokens:
        if m.start() > at:
            if stack[-1].name == "head" and not page[at : m.start()].isspace():
                leave(len(stack) - 1)
            if not stack[-1].mute:
                out.text(page[at : m.start()], in_link)
        at = m.end()
        out.controls += m["raw"] is not None and m["raw"].lower() == "textarea"
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing = page.startswith("</", m.start())
        if stack[-1].name == "head" and (name in ("body", "html") if closing else name not in _HEAD_TAGS):
            leave(len(stack) - 1)
        while loose and not closing and not whole:
            while not stack[-1].held:
                leave(len(stack) - 1)
            if name in _IN_SELECT if stack[-1].name == "select" else name not in _BLOCKS and name not in _INLINE:
                break
            leave(len(stack) - 1)
        top = stack[-1]
        if name == "a" and not whole and not loose:
            in_link = not closing
        if name == "br" or name == "wbr":
            if name == "br" and not top.mute:
                out.text(" ", False)
            continue
        if name in _BLOCKS and not top.mute:
            out.end(top)
        if not closing and name in _CONTROLS:
            out.controls += 1
        if name in _VOID or name in _INLINE or name == "a":
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    leave(i)
                    break
                if stack[i].held and not stack[i].loose or stack[i].name in _SECTIONS and name not in _SECTIONS and name not in _HELD:
                    break
            continue
        attributes = m["attrs"] or m["attrs2"] or ""
        if name == "head":
            if len(stack) == 1 or top.name == "html":
                out.end(top)
                stack.append(_Open(name, True, 0, held=True, loose=True))
            continue
        if name in _HELD:
            if m.start() in closed:
                stack.append(_Open(name, True, 0, held=True))
                whole += 1
            elif name in _OWN_ONLY and not (name in _FOREIGN and attributes.endswith("/")):
                stack.append(_Open(name, True, 0, held=True, loose=True))
                loose += 1
            continue
        if attributes.endswith("/") and name not in _BLOCKS:
            continue
        if name in _SELF_ENDING or name in _BLOCKS:
            closes = {"p"} if name not in ("li", "dt", "dd", "tr", "td", "th", "option") else {"p", name}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in closes:
                    leave(i)
                    break
                if stack[i].name in _BLOCKS or stack[i].held:
                    break
            top = stack[-1]
        words, role, hidden = _facts(attributes) if attributes else (set(), "", False)
        root = name in ("html", "body")
        named = not root and any(set(_PART.findall(w)) & _BODY_PARTS and not _grade(w) for w in words)
        main = _BY_ELEMENT if name in ("article", "main") or role in ("main", "article") else max(top.main, _BY_NAME if named else 0)
        cut = top.cut or hidden or name in _CUT_TAGS or role in _CUT_ROLES or name == "header" and main < _BY_ELEMENT
        grade = 0 if cut or root or name == "main" or not words else max(map(_grade, words))
        if grade or cut != top.cut or main != top.main:
            out.end(top)
        stack.append(_Open(name, cut, 0 if cut else main).within(top))
        if grade:
            stack[-1].doubt = grade, len(out.lines), out.controls
    if stack[-1].name == "head" and at < len(page) and not page[at:].isspace():
        leave(len(stack) - 1)
    if at < len(page) and not stack[-1].mute:
        out.text(page[at:], in_link)
    out.end(stack[-1])
    leave(1)
    return out


def runs(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """From surge to dive: spans of lines whose window sums stay above zero, without empty lines at their ends."""
    out = []
    begin = last = None
    total = 0
    for i in range(len(lengths) + window - 1):
        total += lengths[i] if i < len(lengths) else 0
        total -= lengths[i - window] if i >= window else 0
        if total > 0:
            if i < len(lengths) and lengths[i] > 0:
                begin = i if begin is None else begin
                last = i
        elif begin is not None:
            out.append((begin, last + 1))
            begin = None
    if begin is not None:
        out.append((begin, last + 1))
    return out


def _laid_out(page: str) -> tuple[list[_Line | None], list[int]]:
    """Lines, and empty lines (None) where kinds of lines meet, each with its length."""
    stripped = _strip(page)
    believed = _believed(stripped.lines, stripped.doubts)
    if all(gone or line.cut for line, gone in zip(stripped.lines, believed)):
        believed = [False] * len(stripped.lines)  # names that leave nothing of a page say nothing
    lines: list[_Line | None] = []
    lengths: list[int] = []
    before = None
    for line, gone in zip(stripped.lines, believed):
        out = line.cut or gone
        kind = out, line.main == _BY_ELEMENT
        if before not in (None, kind):
            lines += [None] * WINDOW
            lengths += [0] * WINDOW
        before = kind
        own = line.chars - line.linked
        if line.main == _BY_ELEMENT:
            length = line.chars  # links in an article are text
        else:
            length = own if 2 * own > line.linked and not (_NOTICE.match(line.text) and line.chars < 2 * FEW_CHARS) else 0
        lines.append(line._replace(cut=out))
        lengths.append(0 if out else length)
    return lines, lengths


def _path(element: _Open) -> list[_Open]:
    """An element and all around it, outwards."""
    out, at = [], element
    while at is not None:
        out.append(at)
        at = at.below
    return out


def main_text(page: str | None) -> str:
    """The article of a page."""
    lines, lengths = _laid_out(page or "")
    weights = [n and n * (1, NAME_WEIGHT, ELEMENT_WEIGHT)[line.main] for n, line in zip(lengths, lines)]
    found = runs(lengths)
    if not found:
        return ""
    mass = [sum(weights[a:b]) for a, b in found]
    body = max(range(len(found)), key=mass.__getitem__)
    first, end = found[body]
    surest = max(line.main for line in lines[first:end] if line)
    by_container: dict[int, list] = {}
    for i in range(first, end):
        if lengths[i]:
            container = lines[i].block.container()
            by_container.setdefault(id(container), [0, container])[0] += lengths[i]
    container = max(by_container.values(), key=lambda x: x[0])[1]
    above = set(map(id, _path(container)))
    kept = []
    for k, (a, b) in enumerate(found):
        if k == body:
            spare = sum(lengths[a:b]) // 10

            def foreign(i: int) -> bool:
                """Short bare text of a container that shares only the page with the body's."""
                block = lines[i].block
                shared = [x for x in _path(block) if id(x) in above]
                return block.name not in _TEXT_BLOCKS and id(block) not in above and all(x.name in ("", "html", "body") for x in shared) and lengths[i] <= spare

            while surest < _BY_ELEMENT and b - a > 1 and lines[a] and foreign(a):
                a += 1
            while surest < _BY_ELEMENT and b - a > 1 and lines[b - 1] and foreign(b - 1):
                b -= 1
            kept += range(a, b)
        elif 100 * mass[k] >= RUN_SHARE_PCT * mass[body] or max(line.main for line in lines[a:b] if line) >= max(surest, _BY_NAME):
            kept += range(a, b)
        elif surest < _BY_ELEMENT:
            kept += [i for i in range(a, b) if lengths[i] and (lines[i].block.name in _TEXT_BLOCKS or lines[i].block is container) and id(lines[i].block.container()) in above]
    return "\n".join(lines[i].text for i in kept if lines[i])


def extract_pages(pages: DataFrame, *, html_col: str = "html", keep_columns: list[str] | None = None) -> DataFrame:
    """The kept columns of every row of pages (all unless named) with text and n_chars (its code points)."""
    carried = pages.columns if keep_columns is None else keep_columns
    text_name = fresh_name(carried, "text")
    size_name = fresh_name([*carried, text_name], "n_chars")
    page_name = fresh_name([*carried, text_name, size_name], "page_to_read")
    schema = T.StructType([*(pages.schema[c] for c in carried), T.StructField(text_name, T.StringType()), T.StructField(size_name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*carried, text_name, size_name])

    return pages.select(*(pages[c] for c in carried), pages[html_col].alias(page_name)).mapInArrow(run, schema)
