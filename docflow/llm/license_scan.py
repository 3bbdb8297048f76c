"""License scans: Aho-Corasick over tags and notice phrases, and licence expressions.

Notice phrases are found in the text's word sequence (words joined with single spaces), identifier
tags in the lower-cased text itself, each by one automaton in one pass. The expression behind an
identifier tag is read by a shunting-yard parser over AND, OR and WITH with parentheses and
evaluated to the licences it names and the sets of licences that satisfy it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.arrow import map_rows, utf8

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Further notice phrases of public licences and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}

#: Tags that introduce a licence expression, in lower case.
TAGS = ("spdx-license-identifier:", "license-expression:")

_SPACED = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_TOKEN = re.compile(r"\s*(\(|\)|[a-z0-9][a-z0-9.+\-]*(?::[a-z0-9][a-z0-9.+\-]*)?)", re.IGNORECASE)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


class ExpressionError(ValueError):
    """The tokens are not a licence expression."""


@dataclass(frozen=True)
class Expression:
    """names: every licence and exception named; choices: the least sets of licences that satisfy
    it, none if they are too many to list; formula: the expression itself, in lower case."""

    names: frozenset[str]
    choices: frozenset[frozenset[str]]
    formula: str

    def __str__(self) -> str:
        return "|".join(sorted("+".join(sorted(c)) for c in self.choices)) or self.formula


def tokens(source: str) -> list[str]:
    """Tokens of the expression that begins a line; the line's rest after them is not read."""
    out, place, depth, operand = [], 0, 0, True
    while match := _TOKEN.match(source, place):
        token = match[1].lower()
        opens = token == "("
        if operand and (token == ")" or token in _PRECEDENCE) or not operand and (opens or token not in (")", *_PRECEDENCE)):
            break
        if token == ")" and depth == 0:
            break
        depth += opens - (token == ")")
        operand = opens or token in _PRECEDENCE
        out.append(token)
        place = match.end()
    while out and out[-1] in _PRECEDENCE:
        out.pop()
    return out


def postfix(parts: list[str]) -> list[str]:
    """Reverse Polish order by the shunting-yard algorithm; WITH binds before AND before OR."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for part in parts:
        if part in _PRECEDENCE:
            if operand:
                raise ExpressionError(f"operator {part!r} without a left side")
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[part]:
                out.append(held.pop())
            held.append(part)
            operand = True
        elif part == "(":
            if not operand:
                raise ExpressionError("two operands in a row")
            held.append(part)
        elif part == ")":
            if operand:
                raise ExpressionError("empty parentheses")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ExpressionError("unopened parenthesis")
            held.pop()
        else:
            if not operand:
                raise ExpressionError("two operands in a row")
            out.append(part)
            operand = False
    if operand:
        raise ExpressionError("no right side")
    while held:
        if (top := held.pop()) == "(":
            raise ExpressionError("unclosed parenthesis")
        out.append(top)
    return out


def least_sets(sets: set[frozenset[str]], most: int) -> frozenset[frozenset[str]] | None:
    """The sets that hold no other of them; None if there are more than ``most``."""
    kept: list[frozenset[str]] = []
    for one in sorted(sets, key=len):
        if not any(k <= one for k in kept):
            if len(kept) == most:
                return None
            kept.append(one)
    return frozenset(kept)


def evaluate(parts: list[str], most_choices: int = 256) -> Expression:
    """Names, choices and formula of an expression; AND multiplies choices, of which the least stay.

    With more than ``most_choices`` of them at any step, no choices are listed: the formula alone
    says, exactly, what satisfies the expression.
    """
    stack: list[tuple[frozenset[str], frozenset[frozenset[str]] | None]] = []
    for part in postfix(parts):
        if part not in _PRECEDENCE:
            stack.append((frozenset([part]), frozenset([frozenset([part])])))
            continue
        right, left = stack.pop(), stack.pop()
        names = left[0] | right[0]
        if part == "with":
            if len(left[0]) != 1 or len(right[0]) != 1:
                raise ExpressionError("WITH joins one licence and one exception")
            joined = f"{next(iter(left[0]))} with {next(iter(right[0]))}"
            stack.append((frozenset([joined]), frozenset([frozenset([joined])])))
        elif left[1] is None or right[1] is None:
            stack.append((names, None))
        else:
            sets = set(left[1] | right[1]) if part == "or" else {a | b for a in left[1] for b in right[1]}
            stack.append((names, least_sets(sets, most_choices)))
    names, choices = stack[0]
    return Expression(names, choices or frozenset(), " ".join(parts).replace("( ", "(").replace(" )", ")"))


@dataclass
class Scan:
    """What one text holds. base and notices: (first word, label); expressions: by tag."""

    n_words: int = 0
    base: list[tuple[int, str]] = field(default_factory=list)
    notices: list[tuple[int, str]] = field(default_factory=list)
    expressions: list[Expression] = field(default_factory=list)
    broken: int = 0

    @property
    def base_labels(self) -> set[str]:
        return {label for _, label in self.base}

    @property
    def labels(self) -> set[str]:
        named = {f"spdx:{name}" for e in self.expressions for name in e.names}
        return self.base_labels | {label for _, label in self.notices} | named

    @property
    def score(self) -> float:
        """Evidence that the text is licensed: each tag halves the doubt twice, a notice once."""
        return 1.0 - 0.5 ** min(50, len(self.base) + len(self.notices) + 2 * len(self.expressions))


class Scanner:
    def __init__(self, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, tags: tuple[str, ...] = TAGS):
        self.words, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for is_base, phrases in ((False, NOTICES if notices is None else notices), (True, BASE if base is None else base)):
            for phrase, label in phrases.items():
                self.words.add_word(f" {phrase} ", (is_base, len(phrase) + 1, label))
        for tag in tags:
            self.tags.add_word(tag, tag)
        self.words.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: bytes) -> Scan:
        """Scan a whole text in UTF-8. Letters A-Z are lower-cased, other bytes stay."""
        lower = text.lower()
        words = lower.translate(_SPACED).split()
        out = Scan(n_words=len(words))
        sequence = f" {b' '.join(words).decode()} "
        counted, place = 0, 0
        starts = sorted((end - length, is_base, label) for end, (is_base, length, label) in self.words.iter(sequence))
        for start, is_base, label in starts:
            counted += sequence.count(" ", place, start)
            place = start
            (out.base if is_base else out.notices).append((counted, label))
        if b"license" in lower:
            whole = lower.decode()
            for end, _ in self.tags.iter(whole):
                line = whole[end + 1 : (whole + "\n").index("\n", end + 1)]
                try:
                    out.expressions.append(evaluate(tokens(line)))
                except ExpressionError:
                    out.broken += 1
        return out


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    """The default scanner, made once in each Python worker."""
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


#: Columns of `scan_licenses` after doc_id.
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_notices long, n_expressions long, n_broken long, choices string"


def scan_licenses(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id and the contract's columns, then the method's own.

    Words: runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. n_base counts all places
    of base phrases, overlapping ones too; first_word and last_word are null without one.
    Labels are distinct, sorted and comma-joined. n_notices, n_expressions, n_broken: places of
    further phrases, expressions read, tags without a readable expression; choices: the least
    sets of licences that satisfy each expression (a+b|c), or where these are over 256 the whole
    expression, as (a or b) and c. Null and empty texts have no words and no labels.
    Whole texts are read, one at a time; rows are independent, so nothing is shuffled.
    """
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    out = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        own = scanner()
        found = [own.scan(t or b"") for t in utf8(batch.column(1))]
        return {
            "doc_id": batch.column(0),
            "n_words": [s.n_words for s in found],
            "n_base": [len(s.base) for s in found],
            "first_word": [s.base[0][0] if s.base else None for s in found],
            "last_word": [s.base[-1][0] if s.base else None for s in found],
            "base_labels": [",".join(sorted(s.base_labels)) for s in found],
            "labels": [",".join(sorted(s.labels)) for s in found],
            "score": [s.score for s in found],
            "n_notices": [len(s.notices) for s in found],
            "n_expressions": [len(s.expressions) for s in found],
            "n_broken": [s.broken for s in found],
            "choices": [";".join(map(str, s.expressions)) for s in found],
        }

    return map_rows(documents.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], SCHEMA, work, out)


def op5_license_scan(documents: DataFrame) -> DataFrame:
    return scan_licenses(documents)
