"""Licence scans: matching statistics over a generalised suffix automaton."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrymill.llm.texts import WORD, bound_batches, raw_texts, word_blocks, worker_state

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Licence notices and the label that each stands for.
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "licensed under the gnu general public license": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under the bsd license": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: Matches of fewer words are no evidence; a chain may skip so many words of the
#: text between two matches; a template counts as present from this covered part.
MIN_MATCH, GAP, COVERED = 3, 8, 0.75


@dataclass
class _State:
    length: int = 0
    link: int = -1
    step: dict = field(default_factory=dict)
    ends: set = field(default_factory=set)


class SuffixAutomaton:
    """Generalised suffix automaton over token sequences.

    Each state knows the (template, end) places of its strings, so one walk over
    a text gives, at every word, the longest substring of any template that ends
    there and where in the templates it stands.
    """

    def __init__(self, sequences: list[list[int]]):
        self.states = [_State()]
        self.sizes = [len(s) for s in sequences]
        for number, tokens in enumerate(sequences):
            last = 0
            for at, token in enumerate(tokens):
                last = self._append(last, token)
                self.states[last].ends.add((number, at))
        for s in sorted(self.states[1:], key=lambda s: -s.length):
            self.states[s.link].ends |= s.ends
        self.states[0].ends = set()
        #: Sequences that end, as wholes, where a text is in the state and its match is as long.
        self.whole: list[list[int]] = [[] for _ in self.states]
        for k in sorted(range(1, len(self.states)), key=lambda k: self.states[k].length):
            s = self.states[k]
            own = {n for n, at in s.ends if at + 1 == self.sizes[n] and self.states[s.link].length < self.sizes[n] <= s.length}
            self.whole[k] = sorted(own | set(self.whole[s.link]))

    def _append(self, last: int, token: int) -> int:
        states = self.states
        known = states[last].step.get(token)
        if known is not None:
            if states[known].length == states[last].length + 1:
                return known
            return self._split(last, token, known)
        new = len(states)
        states.append(_State(states[last].length + 1))
        p = last
        while p >= 0 and token not in states[p].step:
            states[p].step[token] = new
            p = states[p].link
        if p < 0:
            states[new].link = 0
        else:
            q = states[p].step[token]
            states[new].link = q if states[q].length == states[p].length + 1 else self._split(p, token, q)
        return new

    def _split(self, p: int, token: int, q: int) -> int:
        states, clone = self.states, len(self.states)
        states.append(_State(states[p].length + 1, states[q].link, dict(states[q].step)))
        while p >= 0 and states[p].step.get(token) == q:
            states[p].step[token] = clone
            p = states[p].link
        states[q].link = clone
        return clone

    def advance(self, state: int, length: int, token: int | None) -> tuple[int, int]:
        """State and length of the longest match that ends with ``token``."""
        states = self.states
        if token is None:
            return 0, 0
        while token not in states[state].step:
            state = states[state].link
            if state < 0:
                return 0, 0
            length = states[state].length
        return states[state].step[token], length + 1


@dataclass
class Scan:
    """What one text holds: word count, phrase places (start, label), template spans (label, first word, last word, coverage)."""

    n_words: int
    places: list[tuple[int, str]]
    spans: list[tuple[str, int, int, float]]


class LicenceScanner:
    """Streams a text's words through the automaton and chains its long matches."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES):
        self.phrases, self.labels = list(phrases.values()), [*phrases.values(), *templates.values()]
        split = [WORD.findall(t.encode().lower()) for t in (*phrases, *templates)]
        self.vocabulary: dict[bytes, int] = {}
        for words in split:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.automaton = SuffixAutomaton([[self.vocabulary[w] for w in words] for words in split])

    def scan(self, text: bytes | None) -> Scan:
        base, automaton = len(self.phrases), self.automaton
        sizes, whole, known = automaton.sizes, automaton.whole, self.vocabulary.get
        state = length = first = 0
        last, places, matches = -2, [], []
        for words in word_blocks((text or b"").lower()):
            tokens = list(map(known, words))
            for at in [k for k, t in enumerate(tokens) if t is not None]:
                here = first + at
                if here != last + 1:
                    if length >= MIN_MATCH:
                        matches.append((last, length, state))
                    state = length = 0
                was = state, length
                state, length = automaton.advance(state, length, tokens[at])
                if was[1] >= MIN_MATCH and length <= was[1]:
                    matches.append((last, was[1], was[0]))
                last = here
                for n in whole[state]:
                    if n < base and length >= sizes[n]:
                        places.append((here - sizes[n] + 1, self.labels[n]))
            first += len(words)
        if length >= MIN_MATCH:
            matches.append((last, length, state))
        return Scan(first, places, self._chain(matches))

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Matches in order, joined per template while they move forward in it."""
        base, sizes, spans = len(self.phrases), self.automaton.sizes, []
        open_: dict[int, list[int]] = {}  # template: first word, last word, its last end, words covered

        def close(n: int) -> None:
            start, end, _, covered = open_.pop(n)
            if covered >= COVERED * sizes[n]:
                spans.append((self.labels[n], start, end, covered / sizes[n]))

        for end, length, state in matches:
            for n, at in sorted(self.automaton.states[state].ends):
                if n < base:
                    continue
                chain = open_.get(n)
                if chain and end - length + 1 - chain[1] <= GAP and at > chain[2]:
                    new = min(length, at - chain[2], end - chain[1])
                    chain[1], chain[2], chain[3] = end, at, chain[3] + new
                elif not chain or chain[1] < end - length + 1 or length > chain[3]:
                    if chain:
                        close(n)
                    open_[n] = [end - length + 1, end, at, length]
        for n in list(open_):
            close(n)
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


_KIND = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])))])


_DDL = "struct<n_words:long,places:array<struct<start:long,label:string>>,spans:array<struct<label:string,first:long,last:long,coverage:double>>>"


def licence_scan(texts: pa.Array) -> pa.Array:
    """Word count, phrase places and covered template spans of each text."""
    scanner, rows = worker_state("licences", LicenceScanner), []
    for text in raw_texts(texts):
        found = scanner.scan(text)
        rows.append({"n_words": found.n_words, "places": [{"start": s, "label": x} for s, x in found.places], "spans": [{"label": x, "first": a, "last": b, "coverage": min(c, 1.0)} for x, a, b, c in found.spans]})
    return pa.array(rows, _KIND)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_words, places, spans) per row of ``docs``.

    Null and empty texts have no words, places or spans.  Ids may be null or
    repeated; each row is judged alone.  Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.arrow_udf(licence_scan, _DDL)(F.col(text_col)).alias("_scan")).select(id_col, "_scan.*")
