"""The visible blocks of a web page, with their tag paths."""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass

# Elements of the HTML standard.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HIDDEN = frozenset(
    "script style noscript template head title svg math iframe object canvas audio video "
    "textarea select option button datalist".split()
)
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
SIBLINGS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FOREIGN = frozenset(["svg", "math"])  # elements in which a tag may close itself
SCOPES = frozenset("ul ol table tbody thead dl div article section body html".split())

# a quote counts at the start of a value only; one that is never closed is a character
_VALUE = r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
_ATTRS = rf"(?:[^>=]|{_VALUE}|=)*+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])(?P<raw_attrs>{_ATTRS})>(?P<inside>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<[!?][^>]*>"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRS})>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_VALUES = re.compile(_VALUE)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NEAR, FAR = 8, 5  # elements of a path next to the text and next to the root


@dataclass(slots=True)
class Block:
    """A run of text between block borders."""

    text: str
    path: tuple[str, ...]  # tags, and .words of class, id and role, of its elements
    linked: int  # characters inside links


def _words(attrs: str) -> list[str]:
    found = []
    for m in _NAMES.finditer(attrs):
        found += ["." + w for w in _PART.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower())[:6]]
    return found


def _closed(attrs: str) -> bool:
    """Whether a tag ends in a slash that is no part of a value."""
    return attrs.endswith("/") and _VALUES.sub("", attrs).endswith("/")


def blocks(page: str | None) -> list[Block]:
    """The blocks in page order, character references decoded, white space made single spaces.

    Comments, scripts, styles and controls of forms are no text. Elements that
    are not closed end where HTML says, or with the element around them; an end
    tag without element only ends the block, and one in a template ends nothing
    outside it; an unfinished tag at the end is no text.
    The head ends at the first element or text that cannot stand in it; within
    svg and math, and for both, a tag that ends in a slash opens nothing.
    """
    out: list[Block] = []
    names: list[str] = []  # open elements
    where: dict[str, list[int]] = {}  # and their places, by name
    parts: list[tuple[str, ...]] = []
    pieces: list[str] = []
    state = {"linked": 0, "links": 0, "hidden": 0}

    def flush() -> None:
        if pieces:
            text = " ".join(references.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                path = parts if len(parts) <= NEAR + FAR else parts[:FAR] + parts[-NEAR:]
                out.append(Block(text, tuple(x for p in path for x in p), min(state["linked"], len(text))))
        state["linked"] = 0

    def close(to: int) -> None:
        for name in names[to:]:
            where[name].pop()
            state["links"] -= name == "a"
            state["hidden"] -= name in HIDDEN
        del names[to:], parts[to:]

    page, at = page or "", 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        text = m["text"]
        if text is not None:
            if text == "<" and m.end() < len(page) and page[m.end()] in "/!?" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
                at = page.find(">", at) + 1
                if not at:
                    break  # a tag that never ends
                flush()
                continue
            if names[-1:] == ["head"] and text.strip():
                close(len(names) - 1)
            if not state["hidden"]:
                pieces.append(text)
                if state["links"]:
                    state["linked"] += len(text)
            continue
        if m["tag"] is None:
            if m["raw"] and _closed(m["raw_attrs"]) and any(where.get(n) for n in FOREIGN):
                at = m.start("inside")
            continue
        tag = m["tag"].lower()
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m["end"]:
            last = (where.get(tag) or [-1])[-1]
            if last >= 0 and last >= (where.get("template") or [-1])[-1]:
                close(last)
            continue
        if names[-1:] == ["head"] and tag not in IN_HEAD:
            close(len(names) - 1)
        if tag in VOID:
            continue
        if _closed(m["attrs"]) and (tag in FOREIGN or any(where.get(n) for n in FOREIGN)):
            continue
        if tag in SIBLINGS:
            for i in range(len(names) - 1, -1, -1):
                if names[i] in SIBLINGS[tag]:
                    close(i)
                    break
                if names[i] in SCOPES and not (tag in ("td", "th", "tr") and names[i] in ("tbody", "thead")):
                    break
        if tag not in INLINE and "p" in names[-6:]:
            close(len(names) - 1 - names[::-1].index("p"))
        where.setdefault(tag, []).append(len(names))
        names.append(tag)
        parts.append((tag, *_words(m["attrs"])) if m["attrs"] else (tag,))
        state["links"] += tag == "a"
        state["hidden"] += tag in HIDDEN
    flush()
    return out
