"""Licence scan: identifier tags, notice phrases and the licence expressions they introduce.

An Aho-Corasick automaton over words finds all phrases of a text in one pass.  After an identifier
tag or a lead such as "licensed under", a shunting-yard parser reads the licence expression and
evaluates it as it goes: ``or`` leaves the choice (the freer side counts), ``and`` binds to both
(the stricter side counts), ``with`` relaxes its licence by an exception.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinetrace.llm.common import texts_of

SPAN = 1 << 20  # bytes of a text whose words are held at once
FILLERS = 12  # words a lead may have before its first licence, and between a licence and what follows

# Phrases of the base, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Names and sentences of notices, with their licences.
NAMES = {
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu free documentation license": "gfdl",
    "apache software license": "apache",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "microsoft public license": "ms-pl",
    "python software foundation license": "psf",
    "postgresql license": "postgresql",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "boost",
    "artistic license": "artistic",
    "open font license": "ofl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "gnu agpl": "agpl",
}
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software": "unlicense",
    "this program is free software you can redistribute it": "gpl",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAGS = ["spdx license identifier", "license identifier", "license expression"]
LEADS = [f"{v} under" for v in ("licensed", "licenced", "released", "distributed", "available", "relicensed", "published")]

# How licence identifiers begin, longest first where one begins another.
IDENTIFIERS = [
    ("cc-by-nc-sa", "cc-by-nc-sa"),
    ("cc-by-nc-nd", "cc-by-nc-nd"),
    ("cc-by-nc", "cc-by-nc"),
    ("cc-by-sa", "cc-by-sa"),
    ("cc-by-nd", "cc-by-nd"),
    ("cc-by", "cc-by"),
    ("cc0", "cc0"),
    ("agpl", "agpl"),
    ("lgpl", "lgpl"),
    ("gfdl", "gfdl"),
    ("gpl", "gpl"),
    ("apache", "apache"),
    ("mit-0", "mit"),
    ("mit", "mit"),
    ("0bsd", "bsd"),
    ("bsd", "bsd"),
    ("bsl", "boost"),
    ("isc", "isc"),
    ("mpl", "mpl"),
    ("epl", "epl"),
    ("eupl", "eupl"),
    ("cddl", "cddl"),
    ("ms-pl", "ms-pl"),
    ("psf", "psf"),
    ("python", "psf"),
    ("postgresql", "postgresql"),
    ("zlib", "zlib"),
    ("artistic", "artistic"),
    ("ofl", "ofl"),
    ("unlicense", "unlicense"),
    ("wtfpl", "wtfpl"),
    ("licenseref", "custom"),
]

# How freely a text under a licence may be used, 1 without any condition.
FREE, PERMISSIVE, WEAK, COPYLEFT, NETWORK, RESTRICTED, CLOSED = 1.0, 0.9, 0.6, 0.4, 0.3, 0.2, 0.0
OPENNESS = {
    "public-domain": FREE,
    "unlicense": FREE,
    "cc0": FREE,
    "wtfpl": FREE,
    "mpl": WEAK,
    "epl": WEAK,
    "cddl": WEAK,
    "lgpl": WEAK,
    "ms-pl": WEAK,
    "eupl": COPYLEFT,
    "gpl": COPYLEFT,
    "gfdl": COPYLEFT,
    "cc-by-sa": COPYLEFT,
    "agpl": NETWORK,
    "cc-by-nd": RESTRICTED,
    "cc-by-nc": RESTRICTED,
    "cc-by-nc-sa": RESTRICTED,
    "cc-by-nc-nd": RESTRICTED,
    "custom": RESTRICTED,
    "proprietary": CLOSED,
}
#: How sure a finding of each kind makes that the text carries a licence.
WEIGHT = {"tag": 0.9, "lead": 0.7, "notice": 0.8, "base": 0.6, "name": 0.5}

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Lowers A-Z and puts a space in place of every byte outside words.
SPACED = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: What follows a tag: identifiers and brackets, up to the end of the line or remark.
TOKEN = re.compile(rb"(?P<end>[\r\n;\"'`<]|\*/|--)|[()]|[0-9A-Za-z\x80-\xff][0-9A-Za-z\x80-\xff.:\-]*\+?")
#: What follows a lead: words and brackets, up to the end of the line or sentence.
PROSE_TOKEN = re.compile(rb"(?P<end>[\r\n;\"'`<]|\.(?!\S))|[()]|[0-9A-Za-z\x80-\xff]+")


class Phrase(NamedTuple):
    kind: str  # base, name, notice, tag or lead
    label: str | None
    words: int


class Automaton:
    """Aho-Corasick over words: ``go`` holds each state's transitions, ``found`` what ends there."""

    def __init__(self, phrases: dict[str, Phrase]):
        self.go: list[dict[bytes, int]] = [{}]
        self.found: list[list[Phrase]] = [[]]
        for text, phrase in phrases.items():
            state = 0
            for word in text.encode().split():
                if word not in self.go[state]:
                    self.go[state][word] = len(self.go)
                    self.go.append({})
                    self.found.append([])
                state = self.go[state][word]
            self.found[state].append(phrase)
        self.fail = [0] * len(self.go)
        waiting = deque(self.go[0].values())
        while waiting:  # level by level, so a state's suffix is settled before the state
            state = waiting.popleft()
            for word, target in self.go[state].items():
                self.fail[target] = self.step(self.fail[state], word)
                self.found[target] = self.found[target] + self.found[self.fail[target]]
                waiting.append(target)
        self.alphabet = frozenset(w for moves in self.go for w in moves)

    def step(self, state: int, word: bytes) -> int:
        while word not in self.go[state]:
            if not state:
                return 0
            state = self.fail[state]
        return self.go[state][word]

    def scan(self, text: bytes) -> Iterator[int | tuple[Phrase, int]]:
        """(phrase, first word) of every place, in the order of their ends; the number of words last."""
        text, at, before, state, last = text.translate(SPACED), 0, 0, 0, -2
        while at < len(text):
            end = text.find(b" ", at + SPAN)
            words = text[at : end if end >= 0 else len(text)].split()
            at = end if end >= 0 else len(text)
            for i, word in enumerate(words, before):
                if word in self.alphabet:
                    state = self.step(state if last == i - 1 else 0, word)
                    last = i
                    for phrase in self.found[state]:
                        yield phrase, i + 1 - phrase.words
            before += len(words)
        yield before


def _phrases() -> dict[str, Phrase]:
    kinds = [("base", BASE), ("name", NAMES), ("notice", NOTICES)]
    kinds += [("tag", dict.fromkeys(TAGS)), ("lead", dict.fromkeys(LEADS))]
    return {text: Phrase(kind, label, len(text.split())) for kind, table in kinds for text, label in table.items()}


AUTOMATON = Automaton(_phrases())


def identify(token: str) -> str | None:
    """The label of a licence identifier; a longer word that merely begins like one is none."""
    for start, label in IDENTIFIERS:
        if token.startswith(start):
            rest = token[len(start) :]
            if not rest or rest[0] in "-+.0123456789":
                return label
    return None


class Value(NamedTuple):
    """What an expression, or a part of it, comes to."""

    openness: float
    labels: frozenset[str]


#: How tightly the operators bind.
BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass
class Expression:
    """Shunting yard: operands and operators come one by one, and parts are evaluated once they are whole."""

    values: list[Value] = field(default_factory=list)
    operators: list[str] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    operand_next: bool = True

    def take(self, token: str, label: str | None) -> bool:
        """Whether the token continues the expression; operands come with a label, exceptions need none."""
        excepts = bool(self.operators) and self.operators[-1] == "with"
        if token == "(" and self.operand_next and not excepts:
            self.operators.append(token)
        elif token == ")" and not self.operand_next and "(" in self.operators:
            while self.operators[-1] != "(":
                self._apply()
            self.operators.pop()
        elif token in BINDS and not self.operand_next:
            while self.operators and BINDS.get(self.operators[-1], 0) >= BINDS[token]:
                self._apply()
            self.operators.append(token)
            self.operand_next = True
        elif self.operand_next and token not in BINDS and token not in ("(", ")") and (label or excepts):
            self.values.append(Value(FREE, frozenset()) if excepts else Value(OPENNESS.get(label, PERMISSIVE), frozenset([label])))
            self.operand_next = False
        else:
            return False
        self.tokens.append(token)
        return True

    def _apply(self) -> None:
        operator, right, left = self.operators.pop(), self.values.pop(), self.values.pop()
        if operator == "with":
            self.values.append(left._replace(openness=max(left.openness, (left.openness + PERMISSIVE) / 2)))
        else:
            side = max if operator == "or" else min
            self.values.append(Value(side(left.openness, right.openness), left.labels | right.labels))

    def end(self) -> tuple[str, Value] | None:
        """Text and value of what was read; operators without an operand and open brackets fall away."""
        while self.operand_next and self.operators:
            self.tokens.pop()
            self.operand_next = self.operators.pop() == "("
        while self.operators:
            if self.operators[-1] == "(":
                self.operators.pop()
            else:
                self._apply()
        return (self._text(), self.values[-1]) if self.values else None

    def _text(self) -> str:
        closed, left = set(), []
        for i, token in enumerate(self.tokens):
            if token == "(":
                left.append(i)
            elif token == ")":
                closed |= {i, left.pop()}
        kept = [t for i, t in enumerate(self.tokens) if t not in "()" or i in closed]
        return " ".join(kept).replace("( ", "(").replace(" )", ")")


def evaluate(text: bytes, at: int = 0) -> tuple[str, Value] | None:
    """The licence expression that stands at a place of a text, None without one."""
    expression = Expression()
    for match in TOKEN.finditer(text, at):
        token = match.group().rstrip(b".:-").decode("utf-8", "replace").lower()
        if match["end"] or not expression.take(token, identify(token)):
            break
    return expression.end()


#: Words of prose that neither end an expression nor belong to it.
PROSE = frozenset("the a an terms term of your choice either both dual version versions v license licence only later any".split())


def _prose(text: bytes, at: int, number: int, names: dict[int, Phrase]) -> tuple[str, Value] | None:
    """The expression that a lead introduces: names and identifiers, linked by and, or and with.

    ``number`` is that of the first word after ``at``, and ``names`` are known by their first words.
    """
    expression, idle, skip = Expression(), 0, 0
    for match in PROSE_TOKEN.finditer(text, at):
        token = match.group().decode("utf-8", "replace").lower()
        if match["end"]:
            break
        if token in "()":
            if not expression.take(token, None):
                break
            continue
        name, number, skip = names.get(number), number + 1, skip - 1
        if skip >= 0:  # inside a name
            continue
        label = name.label if name else identify(token)
        if name or label or token in BINDS:
            if not expression.take(label or token, label):
                break
            idle, skip = 0, name.words - 1 if name else 0
        elif (token in PROSE or token[0].isdigit()) and idle < FILLERS:
            idle += 1
        else:
            break
    return expression.end()


@dataclass
class Report:
    n_words: int = 0
    base: list[tuple[str, int]] = field(default_factory=list)
    labels: set[str] = field(default_factory=set)
    kinds: set[tuple[str, str]] = field(default_factory=set)
    expressions: list[tuple[str, Value]] = field(default_factory=list)

    @property
    def score(self) -> float:
        doubt = 1.0
        for kind, _ in sorted(self.kinds):
            doubt *= 1 - WEIGHT[kind]
        return 1 - doubt

    @property
    def openness(self) -> float | None:
        """All that stands in a text binds: its least free part counts."""
        own = [v.openness for _, v in self.expressions]
        told = {label for _, v in self.expressions for label in v.labels}
        own += [OPENNESS.get(label, PERMISSIVE) for label in self.labels - told]
        return min(own) if own else None


def read(text: bytes) -> Report:
    """All findings of one text."""
    report, opens, names = Report(), [], []
    for place in AUTOMATON.scan(text):
        if isinstance(place, int):
            report.n_words = place
            continue
        phrase, at = place
        if phrase.kind == "base":
            report.base.append((phrase.label, at))
        if phrase.label:
            names.append((at, phrase))
        else:
            opens.append((at + phrase.words, phrase.kind))
    if not names and not opens:
        return report
    # a longer name takes the place of those inside it, but base labels stay
    longest, reach = [], -1
    for at, phrase in sorted(names, key=lambda x: (x[0], -x[1].words)):
        if at + phrase.words > reach:
            longest.append((at, phrase))
            reach = at + phrase.words
    report.labels = {label for label, _ in report.base} | {p.label for _, p in longest}
    report.kinds = {("base", label) for label, _ in report.base} | {(p.kind, p.label) for _, p in longest}
    for kind, found in _opened(text, opens, dict(longest)):
        report.expressions.append(found)
        report.labels |= found[1].labels
        report.kinds.add((kind, found[0]))
    return report


def _opened(text: bytes, opens: list[tuple[int, str]], names: dict[int, Phrase]) -> Iterator[tuple[str, tuple[str, Value]]]:
    """The expression after each tag and lead; one pass over the words gives their places in the text."""
    words, number, upto = WORD.finditer(text), 0, 0
    for first, kind in sorted(set(opens)):
        while number < first:
            upto, number = next(words).end(), number + 1
        found = evaluate(text, upto) if kind == "tag" else _prose(text, upto, first, names)
        if found:
            yield kind, found


SCHEMA = """n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,
openness double, expressions array<string>, places array<struct<label: string, word: long>>"""


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    for part, texts in texts_of(batches, "text"):
        found = [read(t) for t in texts]
        starts = [[at for _, at in r.base] for r in found]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("id"),
                pa.array([r.n_words for r in found], pa.int64()),
                pa.array([len(s) for s in starts], pa.int64()),
                pa.array([min(s) if s else None for s in starts], pa.int64()),
                pa.array([max(s) if s else None for s in starts], pa.int64()),
                pa.array([",".join(sorted({x for x, _ in r.base})) for r in found], pa.string()),
                pa.array([",".join(sorted(r.labels)) for r in found], pa.string()),
                pa.array([r.score for r in found], pa.float64()),
                pa.array([r.openness for r in found], pa.float64()),
                pa.array([[text for text, _ in r.expressions] for r in found], pa.list_(pa.string())),
                pa.array([[{"label": x, "word": at} for x, at in r.base] for r in found], place),
            ],
            ["id", *[f.split()[0] for f in SCHEMA.replace("\n", " ").split(", ")[:9]], "places"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, words, base places, labels, score, openness and licence expressions.

    ``score`` tells how sure it is that the text carries a licence (0 without findings), ``openness``
    how freely all its licences together let it be used (null without).  A document stands on its own,
    so rows with null or repeated ids are rows like others.  Null and empty texts have no words, no
    places and empty labels.  Texts are read whole, a stretch of words at a time.  Other columns are not
    read.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scan, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
