"""Licence scan: matching statistics of texts against a generalised suffix automaton of templates."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._ship import arrow
from ._words import ALNUM, hashed_words
from .licence_texts import TEXTS

# Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Sentences of public licence notices, by the label that a covered one gives.
TEMPLATES = {
    "apache-notice": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ],
    "bsd-notice": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "cc-notice": [
        "licensed under cc by nc 4 0",
        "licensed under cc by 4 0",
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ],
    "gpl-notice": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "mit-notice": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the software is provided as is without warranty of any kind express or implied",
    ],
    "mpl-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
} | {label: [text] for label, text in TEXTS.items()}

LEAST = 3  # words of a match that a chain may use
GAP = 8  # words between the matches of a chain, in the text and in the template
COVER = 0.8  # covered part of a template that gives its label


@dataclass
class Automaton:
    """The states of all substrings of the templates; all arrays are bounded by twice their words."""

    step: list[dict[int, int]]
    link: list[int]
    length: list[int]
    ends: list[list[tuple[int, int]]]  # (template, words up to here) of every place of a state's substrings
    whole: list[tuple[tuple[int, int], ...]]  # (template, words) of whole phrases and templates that end a state's substring
    size: list[int]  # words of each template
    label: list[str]
    n_phrases: int
    words: np.ndarray  # sorted hashes of the templates' words


def build(phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> Automaton:
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    texts = [(t, label) for t, label in phrases.items()] + [(t, label) for label, some in templates.items() for t in some]
    made = list(hashed_words(pa.array([t for t, _ in texts], pa.string()), ALNUM))
    hashed = np.concatenate([np.zeros(0, np.uint64), *(w for *_, w in made)])
    at = np.cumsum([0, *(n for _, _, cuts, _ in made for n in np.diff(cuts).tolist())])
    words = np.unique(hashed)
    numbers = np.searchsorted(words, hashed).tolist()
    step: list[dict[int, int]] = [{}]
    link, length, ends = [-1], [0], [[]]

    def state(n: int, up: int, by: dict[int, int]) -> int:
        step.append(dict(by))
        link.append(up)
        length.append(n)
        ends.append([])
        return len(step) - 1

    def split(p: int, q: int, c: int) -> int:
        """q, or a copy of q for the substrings that p reaches by c."""
        if length[p] + 1 == length[q]:
            return q
        copy = state(length[p] + 1, link[q], step[q])
        link[q] = copy
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    for k in range(len(texts)):
        last = 0
        for i, c in enumerate(numbers[at[k] : at[k + 1]], 1):
            if c in step[last]:
                last = split(last, step[last][c], c)
            else:
                new, p = state(length[last] + 1, -1, {}), last
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                link[new] = 0 if p < 0 else split(p, step[p][c], c)
                last = new
            ends[last].append((k, i))
    order = sorted(range(1, len(step)), key=lambda s: -length[s])
    for s in order:  # a place of a substring is one of its suffixes too
        if link[s] > 0:
            ends[link[s]] = sorted({*ends[link[s]], *ends[s]})
    own: dict[int, list[tuple[int, int]]] = {}
    for k in range(len(texts)):
        s = 0
        for c in numbers[at[k] : at[k + 1]]:
            s = step[s][c]
        if s:
            own.setdefault(s, []).append((k, int(at[k + 1] - at[k])))
    found: list[tuple[tuple[int, int], ...]] = [()] * len(step)
    for s in reversed(order):
        found[s] = (*found[link[s]], *own.get(s, ()))
    return Automaton(step, link, length, ends, found, np.diff(at).tolist(), [label for _, label in texts], len(phrases), words)


def statistics(auto: Automaton, words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(position, state, length): the longest suffix of the words up to a position that a template has."""
    s, n = 0, 0
    for i, c in enumerate(words):
        while s and c not in auto.step[s]:
            s = auto.link[s]
            n = auto.length[s]
        if c in auto.step[s]:
            s, n = auto.step[s][c], n + 1
        yield i, s, n


def chains(auto: Automaton, matches: list[tuple[int, int, int]], whole: list[tuple[int, int]] = ()) -> list[tuple[int, int, int, float]]:
    """Covered spans (template, first word, word after the last, covered part) of maximal matches.

    matches: (position of the last word, state, length); whole: (template, first word) of whole
    templates, which a longer match may hide if another template has them in it.  A chain's matches follow each other in text
    and template, at most GAP words apart; an overlap counts once.  Each match takes the predecessor
    that covers most, and of chains that overlap in the text the one that covers most is reported,
    of equal ones the first.
    """
    placed: dict[int, list[tuple[int, int, int]]] = {}
    for i, s, n in matches:
        for k, at in auto.ends[s]:
            if at >= n and n >= min(LEAST, auto.size[k]):
                placed.setdefault(k, []).append((i + 1 - n, at - n, n))
    for k, start in whole:
        placed.setdefault(k, []).append((start, 0, auto.size[k]))
    out = []
    for k, some in placed.items():
        ends: list[tuple[int, int, int, int]] = []  # best chain up to each match: first word, end in text, in template, covered words
        for start, inner, n in sorted(set(some)):
            best = (start, start + n, inner + n, n)
            for first, end, at, covered in reversed(ends):
                if start - end > 2 * GAP + auto.size[k]:
                    break
                cut = max(0, end - start, at - inner)  # what overlaps, in the text or the template, counts once
                if start - end <= GAP and inner - at <= GAP and cut < n and first <= start and covered + n - cut > best[3]:
                    best = (first, start + n, inner + n, covered + n - cut)
            ends.append(best)
        taken: list[tuple[int, int]] = []  # in order, and apart from each other
        for first, end, _, covered in sorted(ends, key=lambda c: (-c[3], c)):
            i = bisect(taken, (first, end))
            if (i == 0 or taken[i - 1][1] <= first) and (i == len(taken) or end <= taken[i][0]):
                taken.insert(i, (first, end))
                out.append((k, first, end, min(1.0, covered / auto.size[k])))
    return sorted(out)


def scan(auto: Automaton, words: np.ndarray) -> dict:
    """What one text's word hashes hold: phrase places, covered spans, labels, score."""
    n_base, first, last, base, spans, whole, score = 0, None, None, set(), [], [], 0.0
    at = np.searchsorted(auto.words, words)
    at[at == len(auto.words)] = 0
    known = np.flatnonzero(auto.words[at] == words) if len(auto.words) else np.zeros(0, int)
    # runs of template words as long as the shortest template; any other word takes the automaton back to its start
    breaks = np.flatnonzero(np.diff(known) > 1) + 1
    opens, closes = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(known)]])
    least = min((n for n in auto.size if n), default=1)
    for k in np.flatnonzero(closes - opens >= least).tolist():
        run = known[opens[k] : closes[k]]
        offset, matches, before = int(run[0]), [], (0, 0, 0)
        for i, s, n in statistics(auto, at[run].tolist()):
            for k, size in auto.whole[s]:
                if size <= n:
                    place = offset + i + 1 - size
                    whole.append((k, place))
                    if k >= auto.n_phrases:
                        continue
                    n_base += 1
                    first, last = place if first is None else min(first, place), place if last is None else max(last, place)
                    base.add(auto.label[k])
            if before[2] and n <= before[2]:
                matches.append(before)
            before = (offset + i, s, n)
        matches.append(before)
        spans += [m for m in matches if m[2] >= least]
    covered = chains(auto, spans, whole)
    score = max((c for *_, c in covered), default=0.0)
    more = {auto.label[k] for k, _, _, c in covered if k >= auto.n_phrases and c >= COVER}
    return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | more)), "score": float(score), "spans": [(auto.label[k], a, b, c) for k, a, b, c in covered if k >= auto.n_phrases and c >= COVER]}


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SCHEMA = f"doc_id long, {FIELDS}, spans array<struct<label: string, first_word: long, end_word: long, covered: double>>"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): phrase places, labels, score and covered spans.

    score is the largest covered part of a template, phrases being templates of their own; a
    template covered by COVER or more gives its label.  Null and empty texts have no words: counts 0,
    places null, labels empty, score 0, no spans.  Texts are taken whole.  Repeated rows give repeated
    rows, an empty table none; a null doc_id stays null.  spans are those of covered templates, by
    template, then place: label, first_word, end_word (the word after the last), covered.
    """
    auto = build(phrases, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
             ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())])))]
        )
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for lo, hi, at, words in hashed_words(batch.column(1), ALNUM):
                for i in range(lo, hi):
                    row = scan(auto, words[at[i - lo] : at[i - lo + 1]])
                    row["spans"] = [dict(zip(("label", "first_word", "end_word", "covered"), s, strict=True)) for s in row["spans"]]
                    rows.append({"doc_id": ids[i], **row})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").transform(arrow, run, SCHEMA)


__all__ = ["Automaton", "build", "chains", "scan", "scan_licenses", "statistics"]
