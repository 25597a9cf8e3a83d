"""Vectors written as text: '[x1, x2, ...]', and several of them parted by semicolons.

A text is cut into tokens by one pattern; a vector is the tokens '[' number (',' number)* ']' and nothing else.
"""

from __future__ import annotations

import re

import numpy as np

_TOKEN = re.compile(r"(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<mark>[\[\],])|(?P<blank>[ \t\n\r]+)|(?P<other>.)", re.DOTALL)


class VectorTextError(ValueError):
    """Says what is wrong and at which character, counted from 1."""

    def __init__(self, why: str, at: int):
        super().__init__(f"query vector text: {why} at character {at + 1}")


def parse_vector(text: str) -> list[float]:
    """Elements as float32 values; an empty list, words like nan and numbers beyond float32 are errors."""
    tokens = [(m.group() if m.lastgroup == "mark" else m.lastgroup, m.start(), m.group()) for m in _TOKEN.finditer(text) if m.lastgroup != "blank"]
    tokens.append(("end", len(text), ""))
    out: list[float] = []
    # state -> what may come, what is said otherwise
    expected = {"open": ("[", "expected '['"), "first": ("number", "expected a number"), "number": ("number", "expected a number"), "next": (",", "expected ',' or ']'"), "done": ("end", "unexpected text after ']'")}
    state = "open"
    for kind, at, word in tokens:
        wanted, complaint = expected[state]
        if state == "first" and kind == "]":
            raise VectorTextError("the list is empty", at)
        if state == "next" and kind == "]":
            state = "done"
            continue
        if kind != wanted:
            raise VectorTextError(complaint, at)
        if kind == "number":
            with np.errstate(over="ignore"):
                out.append(float(np.float32(float(word))))
            if not np.isfinite(out[-1]):
                raise VectorTextError("the number is not a finite float32 value", at)
        state = {"open": "first", "first": "next", "number": "next", "next": "number", "done": "done"}[state]
    return out


def parse_queries(query: str | None = None, queries: str | None = None) -> list[tuple[int, list[float]]]:
    """(qid, vector): `query` has qid 0, those of `queries` count from 1; blanks are skipped, lengths must agree."""
    texts = [t for t in (queries or "").split(";") if t.strip(" \t\n\r")]
    vectors = [parse_vector(t) for t in ([] if query is None else [query]) + texts]
    if not vectors:
        raise ValueError("a query is required: the parameter query='[...]' or queries='[...];[...]'")
    odd = next((i for i, v in enumerate(vectors) if len(v) != len(vectors[0])), None)
    if odd is not None:
        raise ValueError(f"query {odd + 1} has {len(vectors[odd])} elements, the first has {len(vectors[0])}")
    first = 1 if query is None else 0
    return [(first + i, v) for i, v in enumerate(vectors)]
