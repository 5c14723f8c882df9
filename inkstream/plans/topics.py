"""Boolean topic queries: text to a tree on the driver, tree to a Column for Catalyst.

    query := all (OR all)*        all := not (AND? not)*       not := (NOT | -)* atom
    atom  := ( query ) | field:(word | phrase) | word | phrase

Operators are upper case; words side by side are joined by AND.  A word of several
tokens is a phrase.  A bare term looks in title and body, each on its own.
"""

from __future__ import annotations

import functools
import json
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.text import tokens_norm

MAX_QUERY_BYTES = 2048
MAX_DEPTH = 32
FIELDS = ("title", "body", "source", "author", "url")
_TOKEN = re.compile(r'\s+|(?P<open>\()|(?P<close>\))|(?P<colon>:)|(?P<minus>-)|"(?P<quoted>[^"]*)(?P<done>"?)|(?P<word>[^\s():"]+)')


class QueryParseError(ValueError):
    """What is wrong with a query, and at which character (from 1)."""

    def __init__(self, message: str, column: int):
        super().__init__(f"{message} (column {column})")
        self.message, self.column = message, column


@dataclass(frozen=True)
class Node:
    """kind: term, phrase, and, or, not."""

    kind: str
    field: str | None = None
    words: tuple[str, ...] = ()
    parts: tuple[Node, ...] = ()

    def to_dict(self) -> dict:
        if self.kind in ("term", "phrase"):
            return {"kind": self.kind, "field": self.field or "any", **({"word": self.words[0]} if self.kind == "term" else {"words": list(self.words)})}
        return {"kind": self.kind, "node": self.parts[0].to_dict()} if self.kind == "not" else {"kind": self.kind, "nodes": [p.to_dict() for p in self.parts]}

    @staticmethod
    def from_dict(d: dict) -> Node:
        field = None if d.get("field", "any") == "any" else d["field"]
        if d["kind"] == "term":
            return Node("term", field, (d["word"],))
        if d["kind"] == "phrase":
            return Node("phrase", field, tuple(d["words"]))
        return Node(d["kind"], parts=tuple(map(Node.from_dict, [d["node"]] if d["kind"] == "not" else d["nodes"])))


def dumps(node: Node) -> str:
    return json.dumps(node.to_dict(), ensure_ascii=False, separators=(",", ":"))


def loads(text: str | None) -> Node | None:
    """A stored tree; None if it cannot be read, which matches nothing."""
    try:
        return Node.from_dict(json.loads(text))
    except (TypeError, ValueError, KeyError, AttributeError):
        return None


def query_tokens(text: str) -> list[str]:
    """The driver's counterpart of ``tokens_norm``."""
    low = re.sub(r"\s+", " ", text.lower()).strip()
    return re.findall(r"[^\W_]+", low)


def _lex(query: str) -> list[tuple[str, str, int]]:
    out = []
    for m in _TOKEN.finditer(query):
        kind, column = m.lastgroup, m.start() + 1
        if kind == "done":
            if not m["done"]:
                raise QueryParseError("unterminated quoted phrase", column)
            out.append(("quoted", m["quoted"], column))
        elif kind == "word" and m[0] in ("AND", "OR", "NOT"):
            out.append((m[0].lower(), m[0], column))
        elif kind:
            out.append(({"minus": "not"}.get(kind, kind), m[0], column))
    return out


def _leaf(text: str, field: str | None, column: int) -> Node:
    words = tuple(query_tokens(text))
    if not words:
        raise QueryParseError("nothing searchable in this term", column)
    return Node("term" if len(words) == 1 else "phrase", field, words)


def parse(query: str) -> Node:
    """The tree of a query; raises QueryParseError before any job runs."""
    if len(query.encode()) > MAX_QUERY_BYTES:
        raise QueryParseError(f"a query has at most {MAX_QUERY_BYTES} bytes", 1)
    tokens = _lex(query)
    if not tokens:
        raise QueryParseError("the query is empty", 1)
    end = len(query) + 1
    at = 0

    def peek(k: int = 0) -> tuple[str, str, int]:
        return tokens[at + k] if at + k < len(tokens) else ("end", "", end)

    def take() -> tuple[str, str, int]:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def group(kind: str, parts: list[Node]) -> Node:
        return parts[0] if len(parts) == 1 else Node(kind, parts=tuple(parts))

    def either(depth: int) -> Node:
        parts = [every(depth)]
        while peek()[0] == "or":
            take()
            parts.append(every(depth))
        return group("or", parts)

    def every(depth: int) -> Node:
        parts = [negated(depth)]
        while peek()[0] not in ("or", "close", "end"):
            if peek()[0] == "and":
                take()
            parts.append(negated(depth))
        return group("and", parts)

    def negated(depth: int) -> Node:
        flips = 0
        while peek()[0] == "not":
            take()
            flips += 1
        node = atom(depth)
        for _ in range(flips):
            node = Node("not", parts=(node,))
        return node

    def atom(depth: int) -> Node:
        kind, text, column = peek()
        if depth >= MAX_DEPTH:
            raise QueryParseError(f"the query nests deeper than {MAX_DEPTH} levels", column)
        if kind == "open":
            take()
            node = either(depth + 1)
            if peek()[0] != "close":
                raise QueryParseError("a closing parenthesis is missing", peek()[2])
            take()
            return node
        if kind == "word" and peek(1)[0] == "colon":
            field = text.lower()
            if field not in FIELDS:
                raise QueryParseError(f"unknown field '{text}'; fields are {', '.join(sorted(FIELDS))}", column)
            take(), take()
            if peek()[0] not in ("word", "quoted"):
                raise QueryParseError(f"a word or phrase must follow {field}:", peek()[2])
            kind, text, column = take()
            return _leaf(text, field, column)
        if kind in ("word", "quoted"):
            take()
            return _leaf(text, None, column)
        raise QueryParseError("a word, phrase or parenthesis is missing", column)

    node = either(0)
    if peek()[0] != "end":
        raise QueryParseError("what follows is not part of the query", peek()[2])
    return node


def document(df: DataFrame, **fields: Column) -> DataFrame:
    """Adds ``q_<field>`` token arrays, empty where a field is null or not given."""
    none = F.array().cast("array<string>")
    return df.withColumns({f"q_{f}": tokens_norm(fields[f]) if f in fields else none for f in FIELDS})


def matches(node: Node) -> Column:
    """Two-valued predicate over the columns of ``document``."""
    if node.kind in ("and", "or"):
        return functools.reduce(operator.and_ if node.kind == "and" else operator.or_, map(matches, node.parts))
    if node.kind == "not":
        return ~matches(node.parts[0])
    fields = (node.field,) if node.field else ("title", "body")
    if node.kind == "term":
        tests = [F.array_contains(f"q_{f}", node.words[0]) for f in fields]
    else:  # tokens hold no spaces, so a phrase is a substring between spaces
        needle = F.lit(f" {' '.join(node.words)} ")
        tests = [F.contains(F.concat(F.lit(" "), F.array_join(f"q_{f}", " "), F.lit(" ")), needle) for f in fields]
    return functools.reduce(operator.or_, tests)


def match_topics(docs: DataFrame, topics: dict[str, Node], keep: list[str]) -> DataFrame:
    """One row per document and topic it matches: ``keep`` and ``topic_id``.  All topics are one projection."""
    hits = F.array(*(F.when(matches(n), F.lit(t)) for t, n in sorted(topics.items())))
    return docs.select(*keep, F.explode(F.array_compact(hits)).alias("topic_id"))
