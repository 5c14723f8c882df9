"""Readable text of markup, in Arrow batches.

One regular expression cuts a document into tags, CDATA, comments and text.  What is shown
is laid out as text with rows for its tags; elements are extents between such rows.
Nothing recurses, so hostile nesting costs no stack.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_HTML_DEPTH = 256
MAX_REFERENCE = 12
MIN_MAIN_TEXT_BYTES = 200
#: Named character references that are decoded.
NAMED = {
    "AMP": "&", "GT": ">", "LT": "<", "QUOT": '"', "amp": "&", "apos": "'", "bull": "•", "copy": "©", "deg": "°", "euro": "€", "gt": ">",
    "hellip": "…", "laquo": "«", "ldquo": "“", "lsquo": "‘", "lt": "<", "mdash": "—", "middot": "·", "nbsp": " ", "ndash": "–", "pound": "£",
    "quot": '"', "raquo": "»", "rdquo": "”", "reg": "®", "rsquo": "’", "sbquo": "‚", "times": "×", "trade": "™", "yen": "¥",
}
#: Element names by role.
DROPPED = frozenset("noscript script style svg template".split())
BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
LINES = frozenset("br dd dt li td th tr".split())
VOIDS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside blockquote body div main section td".split())

_REFERENCE = re.compile(rf"&([^&;]{{0,{MAX_REFERENCE - 1}}});")
#: A tag runs to its ">", over quoted attribute values; text is what lies between.
TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?](?P<declared>[^>]*)(?:>|\Z)"
    r"|<(?P<end>/)?(?P<name>[A-Za-z_][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<close>>)"
    r"|<(?P<cut>/?[A-Za-z_!?][^<>]*)\Z"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def local_name(name: str) -> str:
    """Lower-case element name without its prefix."""
    return name.rsplit(":", 1)[-1].lower()


def attribute(attrs: str, name: str) -> str | None:
    """First value of an attribute by local name."""
    for m in _ATTRIBUTE.finditer(attrs):
        if local_name(m[1]) == name:
            return next(v for v in (m[2], m[3], m[4]) if v is not None)
    return None


def decode_references(text: str) -> str:
    """Named, decimal and hexadecimal references decoded once; unknown ones stay as written."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body in NAMED:
            return NAMED[body]
        number = re.fullmatch(r"#(?:[xX]([0-9A-Fa-f]+)|([0-9]+))", body)
        if number:
            code = int(number[1], 16) if number[1] else int(number[2])
            if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
                return chr(code)
        return m[0]

    return _REFERENCE.sub(one, text) if "&" in text else text


class Tag(NamedTuple):
    """A tag in the visible markup: where it stands in the text, and how many start tags there are up to it."""

    name: str
    at: int
    nth: int
    opens: bool


def _visible(html: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, value, alone) of what is shown: text, and start and end tags by local name.

    A dropped element is one start tag without an inside; its own name is counted to find its end.
    """
    hidden, deep = "", 0
    for m in TOKEN.finditer(html):
        kind = m.lastgroup
        if kind == "text" and not hidden:
            yield "text", m["text"], False
        if kind != "close":
            continue
        name, alone = local_name(m["name"]), m["attrs"].rstrip().endswith("/")
        if hidden:
            deep += (name == hidden) * (-1 if m["end"] else 0 if alone else 1)
            hidden = hidden if deep else ""
        elif m["end"]:
            yield "end", name, False
        else:
            if name in DROPPED and not alone:
                hidden, deep = name, 1
            yield "start", name, alone or name in DROPPED or name in VOIDS


def _laid_out(html: str) -> tuple[str, list[Tag]]:
    """The raw text with its line breaks, and the tags that open or end elements, placed in it."""
    pieces, tags, at, nth = [], [], 0, 0
    for kind, value, alone in _visible(html):
        if kind == "text":
            piece = decode_references(value)
        else:
            # block elements break on either side, lines before themselves only
            broken = value in BLOCKS and (kind == "start" or value not in LINES)
            piece = "\n" if broken else ""
            nth += kind == "start"
        pieces.append(piece)
        at += len(piece)
        if kind != "text" and not alone:
            tags.append(Tag(value, at, nth, kind == "start"))
    tags.append(Tag("", at, nth, False))
    return "".join(pieces), tags


def _containers(tags: list[Tag]) -> dict[int, tuple[int, int]]:
    """Extents of container elements: start to (end, tags inside), the outermost of those that start together.

    An end tag ends its nearest open element and all inside that; the last row ends all.
    """
    found: dict[int, tuple[int, int]] = {}
    live: list[Tag] = []
    for tag in tags:
        if tag.opens:
            live += [tag] if len(live) < MAX_HTML_DEPTH else []
            continue
        names = [t.name for t in live]
        keep = len(names) - 1 - names[::-1].index(tag.name) if tag.name in names else len(names) if tag.name else 0
        found |= {t.at: (tag.at, tag.nth - t.nth) for t in reversed(live[keep:]) if t.name in CONTAINERS}
        del live[keep:]
    return found


def _gap(m: re.Match) -> str:
    breaks = m[0].count("\n") + m[0].count("\r")
    return "\n" * min(breaks, 2) if breaks else " "


def tidy(text: str) -> str:
    """White space runs to one space, or to their line breaks, two at most; trimmed."""
    return re.sub(r"\s+", _gap, text).strip()


def html_to_text(html: str | None) -> str | None:
    return None if html is None else tidy(_laid_out(html)[0])


def main_text(html: str | None) -> str | None:
    """Text of the container with most bytes per tag, of those with enough; else all text."""
    if html is None:
        return None
    text, tags = _laid_out(html)
    rated = []
    for start, (end, inside) in _containers(tags).items():
        size = len(text[start:end].strip().encode())
        if size >= MIN_MAIN_TEXT_BYTES:
            rated.append((size / (1 + inside), size, -start, end))
    if not rated:
        return tidy(text)
    *_, start, end = max(rated)
    return tidy(text[-start:end])


def extract_json(text: str | None) -> str | None:
    """The first balanced object in prose if it is JSON, as compact text with sorted keys."""
    start = (text or "").find("{")
    if start < 0:
        return None
    depth = 0
    for m in re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', re.S).finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            try:
                return json.dumps(json.loads(text[start : m.end()]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None
    return None


@F.pandas_udf(StringType())
def html_to_text_udf(html: pd.Series) -> pd.Series:
    return html.map(html_to_text, na_action="ignore")


@F.pandas_udf(StringType())
def main_text_udf(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action="ignore")


@F.pandas_udf(StringType())
def decode_references_udf(text: pd.Series) -> pd.Series:
    return text.map(decode_references, na_action="ignore")


@F.pandas_udf(StringType())
def extract_json_udf(text: pd.Series) -> pd.Series:
    return text.map(extract_json, na_action="ignore")
