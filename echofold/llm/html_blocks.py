"""Pages as sequences of leaf blocks: text between block-level tags, with the path of open tags."""

from __future__ import annotations

import html
import re
import zlib

#: Elements that open a block of their own, that have no end tag, and whose content is no text.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe label legend li main menu nav ol p pre section select summary table tbody td tfoot th thead tr ul input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title svg iframe select".split())
#: Fallback contents: blocks of their own, so that the labeller decides on them.
FALLBACK = frozenset("noscript object canvas audio video".split())
#: Tags that a path tells apart, and buckets of the words of class, id and role.
TAGS = "html body div section article main header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption a b span button label address details".split()
HINTS = 128
_TAG = {t: i for i, t in enumerate(TAGS)}
#: Start tags that end an open element: name -> the elements ended, and those that bar the search.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "body": (frozenset(["head"]), frozenset()),
}
_P_ENDERS = BLOCK - frozenset("button label legend body html td th caption thead tbody tfoot tr summary input select".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: The same for pages of very many quotes that do not end: a tag is over at the next >. Only open comments go on without one.
_PLAIN_TOKEN = re.compile(_TOKEN.pattern.replace("""(?:[^>\\"']++|\\"[^\\"]*\\"|'[^']*')*+""", "[^>]*+"), re.S)
_OPEN_TOKEN = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
_ATTR = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-zA-Z]{2,}")


def _hints(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role."""
    if "=" not in attributes:
        return ()
    return tuple(w.lower() for m in _ATTR.findall(attributes) for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[0] or m[1] or m[2])))


class Open:
    """An open element: its name, hints and parent, and what its path has: sets of tags and hints as bits, the innermost known tag."""

    __slots__ = ("parent", "name", "hints", "tags", "words", "inner")

    def __init__(self, parent: Open | None, name: str, hints: tuple[str, ...]):
        self.parent, self.name, self.hints = parent, name, hints
        self.tags, self.words, self.inner = (parent.tags, parent.words, parent.inner) if parent else (0, 0, -1)
        if name in _TAG:
            self.inner = _TAG[name]
            self.tags |= 1 << self.inner
        for h in hints:
            self.words |= 1 << zlib.crc32(h.encode()) % HINTS

    def key(self) -> tuple[int, int, int]:
        return self.tags, self.words, self.inner

    def elements(self) -> list[tuple[str, tuple]]:
        """(tag, hints) from the outermost to this one."""
        out, at = [], self
        while at.parent:
            out.append((at.name, at.hints))
            at = at.parent
        return out[::-1]


class _Stack:
    """Open elements, with the places of each name, so that the nearest is found without a walk."""

    def __init__(self):
        self.open = [Open(None, "", ())]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, hints: tuple[str, ...]) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        if name in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(Open(self.open[-1], name, hints))

    def nearest(self, names) -> int:
        """The place of the innermost open element of ``names``, or 0."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def close_to(self, place: int) -> None:
        while len(self.open) > place:
            name = self.open.pop().name
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()


def _tokens(page: str):
    """Matches of tags and comments from left to right, in time proportional to the page."""
    at, n, pattern = 0, len(page), _TOKEN
    last, tries = page.rfind(">"), 64
    while at < n:
        start = page.find("<", at)
        if start < 0:
            return
        m = (pattern if start <= last else _OPEN_TOKEN).match(page, start)
        if m is None:
            # a tag whose quotes do not end has been read to the end of the page
            if start <= last and pattern is _TOKEN and page[start + 1 : start + 2] not in ("", " ", "="):
                tries -= 1
                pattern = _TOKEN if tries else _PLAIN_TOKEN
            at = start + 1
            continue
        at = yield m
        at = m.end() if at is None else at


def blocks(page: str | None) -> list[tuple[str, Open, int]]:
    """(text, path, characters within links) of each leaf block that has text, in page order.

    White space inside a block is one space; references are decoded. Comments, scripts,
    styles and other contents that are not shown are no text; fallback contents are blocks
    of their own. A path is the innermost open element, which knows those around it. Open
    paragraphs, items and cells end where the next begins; end tags without a start are
    ignored. Time and memory follow the page's length, however deep its elements are.
    """
    page = page or ""
    out: list = []
    stack = _Stack()
    text: list[str] = []
    path = stack.open[0]
    links, at, n = 0, 0, len(page)

    def flush() -> None:
        nonlocal links
        if text:
            joined = "".join(text)
            words = (html.unescape(joined) if "&" in joined else joined).split()
            if words:
                out.append((" ".join(words), path, links))
            text.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal path, links
        if not text:
            path = stack.open[-1]
        text.append(piece)
        if stack.places.get("a"):
            links += len(piece)

    tokens = _tokens(page)
    m = next(tokens, None)
    while at < n:
        start = m.start() if m else n
        if start > at:
            add(page[at:start])
        if m is None:
            break
        at, name, skip = m.end(), m[2] if m.re.groups else None, None
        if name is None:
            if page.startswith("<![CDATA[", m.start()):
                add(page[m.start() + 9 : at].removesuffix("]]>"))
        elif m[1]:
            name = name.lower()
            if name in BLOCK or name == "p" or name in FALLBACK:
                flush()
            place = stack.nearest((name,))
            # an inline end tag does not reach out of a block
            if place and (name in BLOCK or not stack.blocks or stack.blocks[-1] <= place):
                stack.close_to(place)
        elif (name := name.lower()) == "br":
            text.append(" ") if text else None
        elif name in RAW:
            if name in BLOCK:
                flush()
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
                at = skip = (page.find(">", end.end()) + 1 or n) if end else n
        else:
            if name in BLOCK or name in FALLBACK:
                flush()
                if name in _P_ENDERS:
                    place = stack.nearest(("p",))
                    if place > stack.nearest(("td", "th", "button", "body")):
                        stack.close_to(place)
                if name in _CLOSES:
                    ended, bars = _CLOSES[name]
                    place = stack.nearest(ended)
                    if place > stack.nearest(bars):
                        stack.close_to(place)
            if name not in VOID and not m[3].endswith("/"):
                stack.push(name, (*_hints(m[3]), *((name,) if name in FALLBACK else ())))
        try:
            m = tokens.send(skip)
        except StopIteration:
            m = None
    flush()
    return out
