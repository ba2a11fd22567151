"""License scans by template-markup matching.

A template is license wording with regions marked as in public license lists:
``[[...]]`` may be left out, ``{n}`` stands for any n words at most (a version, a name).
Each template becomes a token automaton whose states are positions in the compiled
token list; it accepts a run of words whose mandatory wording is exactly the
template's.  Runs start only where a template's first word can stand, and only in texts that
have a word without which no template can be accepted, so other texts cost no more than their
tokenisation; the rest is linear in the text.

Base phrases are found beside the templates.  Words are maximal runs of ASCII letters
and digits and of bytes above 0x7F, with A-Z lower-cased.

Defined results: empty and null texts have no words and no labels; each row has its own result, so repeated
rows and equal keys keep theirs; an empty table gives an empty result; of matches at one place
each label's longest run counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

#: fixed values: base phrases and their labels
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MARKUP = r"\[\[|\]\]|\{\d+\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Automaton(NamedTuple):
    label: str
    tokens: list[bytes | int]  # a word, or how many words at most a replaceable region takes
    skips: list[tuple[int, ...]]  # states that a state leads to without a word
    words: int  # mandatory words
    needed: bytes  # the longest of them


def compile_template(label: str, markup: str) -> Automaton:
    tokens: list[bytes | int] = []
    jumps: dict[int, list[int]] = {}
    opened: list[int] = []
    for part in re.findall(MARKUP, markup.lower()):
        if part == "[[":
            opened.append(len(tokens))
        elif part == "]]":
            jumps.setdefault(opened.pop(), []).append(len(tokens))
        else:
            tokens.append(int(part[1:-1]) if part[0] == "{" else part.encode())
    for i, t in enumerate(tokens):
        if isinstance(t, int):
            jumps.setdefault(i, []).append(i + 1)
    optional = {i for start, ends in jumps.items() for end in ends for i in range(start, end)}
    must = [t for i, t in enumerate(tokens) if i not in optional]
    return Automaton(label, tokens, [tuple(jumps.get(i, ())) for i in range(len(tokens) + 1)], len(must), max(must, key=len))


def first_words(a: Automaton) -> set[bytes]:
    """Words that an accepted run can begin with; a template may not begin with a replaceable region."""
    todo, out = [0], set()
    while todo:
        i = todo.pop()
        todo += a.skips[i]
        if i < len(a.tokens) and isinstance(a.tokens[i], bytes):
            out.add(a.tokens[i])
    return out


def accept(a: Automaton, words: list[bytes], at: int) -> int:
    """End of the longest accepted run of ``words`` from ``at``; 0 if there is none.

    A state is (position, words that the replaceable region there has taken)."""
    tokens, end = a.tokens, 0

    def closed(states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo = list(states)
        while todo:
            i, _ = todo.pop()
            for j in a.skips[i]:
                if (j, 0) not in states:
                    states.add((j, 0))
                    todo.append((j, 0))
        return states

    states, i = closed({(0, 0)}), at
    while states:
        if any(s == len(tokens) for s, _ in states):
            end = i
        if i == len(words):
            break
        step, word = set(), words[i]
        for s, taken in states:
            if s == len(tokens):
                continue
            t = tokens[s]
            if isinstance(t, int):
                if taken < t:
                    step.add((s, taken + 1))
                    if taken + 1 == t:
                        step.add((s + 1, 0))
            elif t == word:
                step.add((s + 1, 0))
        states, i = closed(step), i + 1
    return end


class Compiled(NamedTuple):
    by_word: dict[bytes, list[Automaton]]  # by the words that runs begin with
    first: re.Pattern  # those words
    needed: re.Pattern  # words one of which every template has
    base: re.Pattern  # a base phrase; phrases may overlap
    table: bytes  # leaves words and spaces


@lru_cache(maxsize=1)
def compiled() -> Compiled:
    by_word: dict[bytes, list[Automaton]] = {}
    needed = set()
    for label, texts in TEMPLATES.items():
        for text in texts:
            a = compile_template(label, text)
            needed.add(a.needed)
            for w in first_words(a):
                by_word.setdefault(w, []).append(a)
    table = bytes(b if b > 127 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
    either = lambda words: b"|".join(sorted(map(re.escape, words), reverse=True))
    return Compiled(by_word, re.compile(b"(?<= )(?:" + either(by_word) + b")(?= )"), re.compile(b" (?:" + either(needed) + b") "), re.compile(b"(?<= )(?=(" + either(p.encode() for p in BASE) + b") )"), table)


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """(words, base places as (first word, label), template matches as (first word, end, label, share of the words)).

    Null counts as empty."""
    c = compiled()
    words = (text or "").encode().translate(c.table).split()
    line = b" " + b" ".join(words) + b" "
    phrases = [(m.start(), BASE[m[1].decode()]) for m in c.base.finditer(line)]
    starts = [(m.start(), m[0]) for m in c.first.finditer(line)] if c.needed.search(line) else []
    if not phrases and not starts:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)  # each word is after one
    number = lambda found: np.searchsorted(spaces, [at for at, _ in found]) - 1
    base = [(int(i), label) for i, (_, label) in zip(number(phrases), phrases)]
    found = []
    for i, (_, word) in zip(number(starts), starts):
        best: dict[str, tuple[int, float]] = {}
        for a in c.by_word[word]:
            if end := accept(a, words, int(i)):
                best[a.label] = max(best.get(a.label, (0, 0.0)), (end, min(1.0, a.words / (end - int(i)))))
        found += [(int(i), end, label, share) for label, (end, share) in best.items()]
    return len(words), base, found


def scan_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: key, n_words, n_base, first_word and last_word (of base places;
    null if none), base_labels, labels (with those of templates), score, and matches, the templates'
    spans.  The score is 1 if a template matches, 0.5 for base phrases alone, else 0, times what the
    matched wording is of its span."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    schema = f"{key} {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<first:bigint,last:bigint,label:string>>"
    match = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for t in batch.column(1):
                n, base, found = scan(t.as_py())
                places = [p for p, _ in base]
                plain = {x for _, x in base}
                score = max([f[3] for f in found] + [0.5] * bool(base) + [0.0])
                for c, v in zip(cols, (n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(plain)), ",".join(sorted(plain | {f[2] for f in found})), score, [{"first": a, "last": b - 1, "label": x} for a, b, x, _ in found])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, types)]], names=[key, *names])

    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)
