"""License scans: Aho-Corasick over words for notices and tags, a shunting-yard parser for tag expressions.

The text is lower-cased in A-Z and every ASCII character but letters and digits becomes a space, so a phrase
is a run of words whatever stands between them. One automaton finds all phrases, words whole, overlapping ones too.
Where it finds the tag "spdx license identifier", the expression after it is parsed from the text as it is; an open bracket
or operator at a line's end goes on in the next line.

labels: those of the phrases found and of the identifiers in the tags' expressions. score: how free the use is that
the strictest finding allows, 1 for none found or a public-domain dedication, down to 0 for reserved rights; an
expression counts as its best side for `or`, its worse side for `and`, and its licence for `with`. A notice within a longer one
("general public license" in "lesser general public license") gives its label, but only the longer one counts for the score.

Defined results: a null text is empty; a broken expression gives its identifiers up to there as labels and no score of its own;
very long texts are read whole, one at a time in a task; an empty table gives an empty result; repeated rows each get their result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: The base phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further phrases of this scan.
MORE = {
    "apache license": "apache", "mit license": "mit", "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "mozilla public license": "mpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "eclipse public license": "epl", "isc license": "isc",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0",
    "creative commons": "cc", "public domain": "public-domain", "the unlicense": "unlicense", "proprietary and confidential": "proprietary",
}
TAG = "spdx license identifier"
#: How free the use is that a label allows.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "mit": 0.9, "isc": 0.9, "bsd": 0.9, "apache": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5,
    "cc": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "proprietary": 0.0, "reserved": 0.0,
}
#: Of a licence that isn't known.
UNKNOWN = 0.5

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TAG = re.compile(r"(?i:spdx)[^0-9A-Za-z\x80-\U0010ffff]+(?i:license)[^0-9A-Za-z\x80-\U0010ffff]+(?i:identifier)[\x20\t]*:?[\x20\t]*([^\r\n]*)")
_LINE = re.compile(r"(?:\r\n|\r|\n)([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_PRIORITY = {"or": 1, "and": 2, "with": 3}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def family(identifier: str) -> str:
    """The label of a licence identifier: the longest known label that starts it, else itself in lower case."""
    low = identifier.lower().rstrip("+")
    known = [k for k in FREEDOM if low == k or low.startswith(k + "-")]
    return max(known, key=len) if known else low


class Parser:
    """Shunting-yard over the tokens of an expression, line by line: what a line leaves open is kept, and the next one goes on from there.

    rpn: the expression so far in reverse Polish order; operands: its licences; broken: it can't be one; ended: words after it, which aren't part of it.
    """

    def __init__(self):
        self.rpn, self.held, self.operands = [], [], []
        self.brackets, self.operand_due, self.broken, self.ended = 0, True, False, False

    def feed(self, line: str) -> Parser:
        for token in _TOKEN.findall(line):
            if self.broken or self.ended:
                break
            low = token.lower()
            if low in _PRIORITY:
                self._operator(low)
            elif token == "(" and self.operand_due:
                self.held.append(token)
                self.brackets += 1
            elif token == ")" and self.operand_due:
                self.broken = True
            elif token == ")" and self.brackets:
                self._close()
            elif self.operand_due:
                self.rpn.append(token)
                if not (self.held and self.held[-1] == "with"):
                    self.operands.append(token)
                self.operand_due = False
            elif self.brackets:
                self.broken = True
            else:
                self.ended = True
        return self

    def _operator(self, name: str) -> None:
        if self.operand_due:
            self.broken = True
            return
        while self.held and self.held[-1] != "(" and _PRIORITY[self.held[-1]] >= _PRIORITY[name]:
            self.rpn.append(self.held.pop())
        self.held.append(name)
        self.operand_due = True

    def _close(self) -> None:
        while self.held[-1] != "(":
            self.rpn.append(self.held.pop())
        self.held.pop()
        self.brackets -= 1

    @property
    def open(self) -> bool:
        """A bracket or an operator waits for the next line."""
        return not self.broken and not self.ended and (self.operand_due or self.brackets > 0)

    def result(self) -> tuple[set[str], float | None]:
        """Labels of the licences, and the freedom of the whole. None if it is broken or ends too early: then the labels are those up to there."""
        if self.broken or self.operand_due or self.brackets:
            return {family(t) for t in self.operands}, None
        stack: list[float] = []
        for token in self.rpn + self.held[::-1]:
            if token in _PRIORITY:
                y, x = stack.pop(), stack.pop()
                stack.append(x if token == "with" else max(x, y) if token == "or" else min(x, y))
            else:
                stack.append(FREEDOM.get(family(token), UNKNOWN))
        return {family(t) for t in self.operands}, stack[0]


def evaluate(expression: str) -> tuple[set[str], float | None]:
    return Parser().feed(expression).result()


def expressions(text: str) -> Iterator[tuple[set[str], float | None]]:
    """Labels and freedom of what follows each tag up to its line's end; further lines as long as a bracket or an operator is open there.

    A line that goes on an expression is parsed once for it. A tag within such lines is one of its own, and where those lines are many and all have
    tags, each tag's expression ends where the next one's begins.
    """
    for tag in _TAG.finditer(text):
        parser, at = Parser().feed(tag[1]), tag.end()
        while parser.open and tag[1].strip():
            line = _LINE.match(text, at)
            if not line or not _TOKEN.search(line[1]) or _TAG.search(line[1]):
                break
            parser.feed(line[1])
            at = line.end()
        yield parser.result()


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**MORE, **BASE, TAG: ""}.items():
        found.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
    found.make_automaton()
    return found


def scan_text(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a whole text."""
    words = words_of(text)
    joined = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    base, starts, labels, spans, tagged = set(), [], set(), [], False
    counted, at = 0, 0
    for end, (phrase, label, is_base) in automaton().iter(joined):
        begin = end - len(phrase) - 1
        if is_base:
            # starts come in the order of ends; a longer phrase may start before the last one
            counted += joined.count(" ", at, begin) if begin >= at else -joined.count(" ", begin, at)
            at = begin
            starts.append(counted)
            base.add(label)
        if label:
            labels.add(label)
            spans.append((begin, -end, label))
        tagged |= not label
    # a notice that lies within a longer one is part of that one's name
    scores, reach = [], -1
    for _, end, label in sorted(spans):
        if -end > reach:
            scores.append(FREEDOM[label])
            reach = -end
    if tagged:
        for more, score in expressions(text):
            labels |= more
            scores += [] if score is None else [score]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=1.0)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan(docs: DataFrame) -> DataFrame:
    """scan_text for every row of docs, with its doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = zip(*(scan_text(x.as_py()) for x in b.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, _SCHEMA.types[1:], strict=True))], schema=_SCHEMA)

    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return keyed.mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
