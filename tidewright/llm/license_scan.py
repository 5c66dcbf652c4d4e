"""License scans by template markup.

A template is licence wording with optional regions `{?...?}` and replaceable regions `{name:k}`, which stand for up to
k words of any kind. It is compiled to a token automaton: states joined by word edges, epsilon edges past optional
regions, and wildcard edges. A place of a text is accepted if the automaton reads the words from there with all
mandatory words matching exactly, whatever the optional and replaceable regions hold.

scan() also reports the base phrases: places where their words stand consecutively.

Defined results: a null or empty text has no words, no places, null positions, empty labels and score 0; a very long text is read whole; rows are
independent, so ties and repeated rows don't matter; an empty table gives no rows; extra columns are ignored.
score: 1 where a template is accepted, 0.5 where only a base phrase stands, else 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .common import map_rows, use
from .words import alnum_words

# Phrases with labels, and public licence wording as templates.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "mit-notice": "released under {?the terms of?} the mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0 {?the license?}",
    "gpl-notice": "{?this?} {?program work:1?} {?is?} licensed under the gnu general public license {?version {version:2}?}",
    "gpl-3.0-notice": "licensed under the gnu general public license version 3",
    "gpl-2.0-notice": "licensed under the gnu general public license version 2",
    "cc-by-notice": "licensed under {?a creative commons attribution?} cc by {?{version:2}?}",
    "cc-by-4.0": "cc by 4 0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice {?including the next paragraph?} shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {holders:12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {holders:12} disclaims all warranties with regard to this software",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {?1?} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {?2?} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {address:8} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {version:1} of the license or at your option any later version",
}

_MARK = re.compile(r"\{\?|\?\}|\{[a-z ]+:\d+\}|[^\s{}?]+")


def parse(template: str) -> list:
    """Words, ("any", k), or ("opt", [...]), nested."""
    stack: list[list] = [[]]
    for t in _MARK.findall(template):
        if t == "{?":
            stack.append([])
        elif t == "?}":
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        elif t[0] == "{":
            stack[-1].append(("any", int(t[1:-1].rpartition(":")[2])))
        else:
            stack[-1].append(t)
    if len(stack) != 1:
        raise ValueError(f"regions are not closed: {template}")
    return stack[0]


class Automaton:
    """Word edges {word: state}, wildcard edges and epsilon edges by state; the last state accepts."""

    def __init__(self, parts: list):
        self.edges: list[tuple[dict[bytes, int], list[int], list[int]]] = []
        end = self._build(parts, self._state())
        self.accept = end
        self.starts: set[bytes] | None = set()
        for s in self._closed({0}):
            words, wild, _ = self.edges[s]
            if wild or s == end:
                raise ValueError("a template must begin with a word")
            self.starts |= set(words)

    def _state(self) -> int:
        self.edges.append(({}, [], []))
        return len(self.edges) - 1

    def _build(self, parts: list, at: int) -> int:
        for p in parts:
            if isinstance(p, str):
                to = self._state()
                self.edges[at][0][p.encode()] = to
            elif p[0] == "any":
                run = [at, *(self._state() for _ in range(p[1]))]
                to = self._state()
                for a, b in zip(run, run[1:], strict=False):
                    self.edges[a][1].append(b)
                for a in run:
                    self.edges[a][2].append(to)
            else:
                inner, to = self._state(), self._state()
                self.edges[at][2].extend((inner, to))
                self.edges[self._build(p[1], inner)][2].append(to)
            at = to
        return at

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for b in self.edges[todo.pop()][2]:
                if b not in states:
                    states.add(b)
                    todo.append(b)
        return states

    def accepts(self, words: list[bytes], at: int) -> bool:
        """Whether the automaton accepts some run of words that begins at `at`."""
        states = self._closed({0})
        while self.accept not in states:
            if at == len(words) or not states:
                return False
            w, step = words[at], set()
            for s in states:
                edges, wild, _ = self.edges[s]
                if w in edges:
                    step.add(edges[w])
                step.update(wild)
            states, at = self._closed(step), at + 1
        return True


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES):
        self.base: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in base.items():
            words = phrase.encode().split()
            self.base.setdefault(words[0], []).append((words, label))
        self.by_start: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, template in templates.items():
            a = Automaton(parse(template))
            for w in a.starts:
                self.by_start.setdefault(w, []).append((label, a))
        self.first = frozenset(self.base) | frozenset(self.by_start)

    def scan(self, text: str | None) -> tuple:
        words = alnum_words(text)
        places, base, more = [], set(), set()
        if not self.first.isdisjoint(words):
            first = self.first
            for i in [i for i, w in enumerate(words) if w in first]:
                for phrase, label in self.base.get(words[i], ()):
                    if words[i : i + len(phrase)] == phrase:
                        places.append(i)
                        base.add(label)
                for label, a in self.by_start.get(words[i], ()):
                    if label not in more and a.accepts(words, i):
                        more.add(label)
        return (
            len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if more else 0.5 if base else 0.0,
        )


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per row of docs(doc_id, text); no shuffle."""

    def start() -> Callable:
        use()
        scanner = Scanner(base, templates)
        return lambda ids, texts: [ids, *map(list, zip(*map(scanner.scan, texts), strict=True))] if ids else [[] for _ in range(8)]

    return map_rows(docs, ["doc_id", "text"], SCHEMA, start)


def template_regex(template: str) -> str:
    """The template as a regular expression over `|word||word|`, for checks in SQL."""

    def part(p) -> str:
        if isinstance(p, str):
            return rf"\|{p}\|"
        if p[0] == "any":
            return rf"(\|[^|]+\|){{0,{p[1]}}}"
        return f"({''.join(map(part, p[1]))})?"

    return "".join(map(part, parse(template)))
