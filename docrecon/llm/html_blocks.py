"""Leaf blocks of a web page: runs of text between block-level tags, with their ancestors."""

import re
from dataclasses import dataclass
from html import unescape

# Fixed values of HTML: elements without content, elements whose content is no text of the page, and block-level ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that end an open one of the same kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body div dl fieldset footer form header html main nav ol section table ul menu td th".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|canvas|audio|video)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# What is kept of a block's ancestors, tags and words of their names.
TAGS = "article main section nav header footer aside form p h1 h2 h3 h4 li ul ol td table blockquote pre figure figcaption button label select option dl dd dt address div body summary details".split()
KNOWN_NAMES = (
    "ad ads advert advertisement sponsor sponsored promo promotion banner nav navigation menu navbar breadcrumb breadcrumbs header top masthead footer bottom copyright legal sidebar side aside widget rail "
    "comment comments reply replies disqus discussion respondent cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search form share social sharing related recommended trending popular tags tag meta byline author date pagination pager toolbar skip "
    "content article post entry main body text story page container wrapper prose markdown blog news title headline lead".split()
)
_TAGS, _NAMES = frozenset(TAGS), frozenset(KNOWN_NAMES)


@dataclass(frozen=True)
class Block:
    """text: references decoded, white space folded. tags: which of TAGS its ancestors have; leaf: the nearest of them, or
    none. names: which of KNOWN_NAMES stand in their class, id and role. linked: share of its characters inside links."""

    text: str
    tags: frozenset[str]
    leaf: str
    names: frozenset[str]
    linked: float


class _Open:
    """Open elements. What a block keeps of its ancestors is bounded and handed down from parent to child, and open
    elements are found by tag, so a page costs the same however deep it nests."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset[str], str, frozenset[str]]] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def top(self) -> tuple[str, frozenset[str], str, frozenset[str]]:
        return self.stack[-1] if self.stack else ("", frozenset(), "none", frozenset())

    def push(self, tag: str, names: frozenset[str]) -> None:
        _, tags, leaf, above = self.top()
        if tag in _TAGS:
            tags, leaf = (tags if tag in tags else tags | {tag}), tag
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, tags, leaf, above if names <= above else above | names))

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def close(self, tag: str) -> None:
        """Ends the innermost element of the tag and what is in it; without one nothing happens."""
        if self.has(tag):
            self.cut(self.places[tag][-1])

    def close_within(self, tags) -> None:
        """Ends the innermost element of the tags unless a scope stands between."""
        at = max((self.places[t][-1] for t in tags if self.has(t)), default=-1)
        if at >= 0 and at >= (self.scopes[-1] if self.scopes else -1):
            self.cut(at)


def leaf_blocks(html: str | None) -> list[Block]:
    """Blocks with a text, in page order. Broken markup is read as browsers do in the main: unknown ends are ignored, a
    block ends an open paragraph, and what is open at the end ends there. What stands in the head is left out."""
    elements, found, parts, linked = _Open(), [], [], 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text and not (elements.has("head") or elements.has("title")):
            _, tags, leaf, names = elements.top()
            found.append(Block(text, tags, leaf, names, linked / max(1, sum(map(len, parts)))))
        parts.clear()
        linked = 0

    for m in TOKEN.finditer(html or ""):
        if m["text"] is not None:
            parts.append(m["text"])
            if any(x[0] == "a" for x in elements.stack[-4:]):
                linked += len(m["text"])
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if m["end"]:
            elements.close(tag)
            continue
        if tag in BLOCK:
            if tag == "body":
                elements.close("head")
            if tag not in ("button", "label", "option", "select"):
                elements.close_within(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
            elements.close_within(CLOSES.get(tag, ()))
        if tag not in VOID and not m["attributes"].rstrip().endswith("/"):
            names = "".join("".join(x) + " " for x in NAMES.findall(m["attributes"]))
            elements.push(tag, _NAMES & {w.lower() for w in WORD.findall(names)})
    flush()
    return found
