"""Boolean trigram queries, derived from regular expressions.

A pattern is parsed into literals, character classes, concatenation, alternation and repetition. Of each part four things
are known: all its strings, if they are few; else what its strings may start and end with; and a query that every one of them
satisfies. Where two parts meet, the trigrams over the seam are added. All in lower case of A-Z, so the query
holds whatever the case. A query is a set of alternatives, each a set of trigrams that are all there; the
empty alternative asks for nothing, so its rule has to scan all texts.

The syntax is what Java, RE2 and Python share: literals, escapes \\xHH and of punctuation, classes, (...), (?:...), |, ?, *, +, {m,n}.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

#: So many strings, or alternatives of a query, are told apart at most; beyond that a part says less, never something wrong.
MOST = 64
#: A class or a seam of over so many possibilities is left out of the query: it would tell little and multiply the alternatives.
SPELT = 8

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def simplified(query: Query) -> Query:
    """Without alternatives that hold another one; all if they are too many."""
    least = frozenset(a for a in query if not any(b < a for b in query))
    return least if len(least) <= MOST else ANY


def both(a: Query, b: Query) -> Query:
    return simplified(frozenset(x | y for x, y in product(a, b)))


def either(a: Query, b: Query) -> Query:
    return simplified(a | b)


def grams(strings: frozenset[str]) -> Query:
    """That one of the strings is there."""
    return simplified(frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings))


@dataclass(frozen=True)
class Part:
    """whole: all strings, or None; starts, ends: one of them begins, or ends, each string; query: what each string satisfies;
    held: each string holds one of these (the empty one: that says nothing)."""

    whole: frozenset[str] | None
    starts: frozenset[str]
    ends: frozenset[str]
    query: Query
    held: frozenset[str]


NOTHING = frozenset([""])
SOMETHING = Part(None, NOTHING, NOTHING, ANY, NOTHING)


def of_strings(strings: frozenset[str]) -> Part:
    return Part(strings, strings, strings, grams(strings), strings) if len(strings) <= MOST else SOMETHING


def telling(held: frozenset[str]) -> tuple[int, int]:
    """The longer the shortest string and the fewer they are, the better."""
    return min(map(len, held)), -len(held)


def few(strings: frozenset[str], at_start: bool) -> frozenset[str]:
    """As many as may be kept: shortened to what a seam needs, or the empty one."""
    for n in (8, 3, 2, 1):
        if len(strings) <= MOST:
            return strings
        strings = frozenset(s[:n] if at_start else s[-n:] for s in strings)
    return strings if len(strings) <= MOST else NOTHING


def concatenation(a: Part, b: Part) -> Part:
    if a.whole is not None and b.whole is not None and len(a.whole) * len(b.whole) <= MOST:
        return of_strings(frozenset(x + y for x, y in product(a.whole, b.whole)))
    query = both(a.query, b.query)
    if len(a.ends) * len(b.starts) <= SPELT:
        query = both(query, grams(frozenset(x[-2:] + y[:2] for x, y in product(a.ends, b.starts))))
    starts = a.starts if a.whole is None or len(a.whole) * len(b.starts) > MOST else frozenset(x + y for x, y in product(a.whole, b.starts))
    ends = b.ends if b.whole is None or len(b.whole) * len(a.ends) > MOST else frozenset(x + y for x, y in product(a.ends, b.whole))
    return Part(None, few(starts, True), few(ends, False), query, max(a.held, b.held, key=telling))


def alternation(a: Part, b: Part) -> Part:
    if a.whole is not None and b.whole is not None and len(a.whole | b.whole) <= MOST:
        return of_strings(a.whole | b.whole)
    return Part(None, few(a.starts | b.starts, True), few(a.ends | b.ends, False), either(a.query, b.query), a.held | b.held)


def repeated(a: Part, least: int, most: int | None) -> Part:
    if most == 1 and least == 0:
        return alternation(of_strings(NOTHING), a)
    if least == 0:
        return SOMETHING
    out = a
    for _ in range(min(least, 4) - 1):
        out = concatenation(out, a)
    return out if most == least <= 4 else Part(None, out.starts, out.ends, out.query, out.held)


class _Parser:
    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def ahead(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.pattern[self.at - 1]

    def alternatives(self) -> Part:
        out = self.sequence()
        while self.ahead() == "|":
            self.take()
            out = alternation(out, self.sequence())
        return out

    def sequence(self) -> Part:
        parts = [of_strings(NOTHING)]
        while self.ahead() not in ("", "|", ")"):
            part, last = self.counted(), parts[-1]
            # neighbours that are spelt out come together first, whatever stands before them
            if part.whole is not None and last.whole is not None and len(part.whole) * len(last.whole) <= MOST:
                parts[-1] = concatenation(last, part)
            else:
                parts.append(part)
        return reduce(concatenation, parts)

    def counted(self) -> Part:
        part = self.atom()
        while (c := self.ahead()) and c in "?*+{":
            self.take()
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, None)}[c]
            if c == "{":
                end = self.pattern.index("}", self.at)
                low, comma, high = self.pattern[self.at : end].partition(",")
                self.at = end + 1
                least = int(low)
                most = int(high) if high else None if comma else least
            part = repeated(part, least, most)
        return part

    def atom(self) -> Part:
        c = self.take()
        if c == "(":
            if self.pattern.startswith("?:", self.at):
                self.at += 2
            elif self.ahead() == "?":
                raise ValueError(f"not a plain group: {self.pattern!r}")
            part = self.alternatives()
            if self.ahead() != ")":
                raise ValueError(f"a bracket is missing: {self.pattern!r}")
            self.take()
            return part
        if c == "[":
            return self.characters()
        if c == ".":
            return SOMETHING
        if c in "^$":
            return of_strings(NOTHING)
        return of_strings(frozenset([lower(self.escaped() if c == "\\" else c)]))

    def escaped(self) -> str:
        c = self.take()
        if c == "x":
            self.at += 2
            return chr(int(self.pattern[self.at - 2 : self.at], 16))
        if c.isalnum():
            raise ValueError(f"not a plain escape: {self.pattern!r}")
        return c

    def characters(self) -> Part:
        negated = self.ahead() == "^"
        if negated:
            self.take()
        found: set[str] = set()
        first = True
        while first or self.ahead() != "]":
            first = False
            c = self.take()
            c = self.escaped() if c == "\\" else c
            last = c
            if self.ahead() == "-" and self.pattern[self.at + 1] != "]":
                self.take()
                last = self.take()
                last = self.escaped() if last == "\\" else last
            found |= {lower(chr(k)) for k in range(ord(c), ord(last) + 1)}
        self.take()
        return SOMETHING if negated or len(found) > SPELT else of_strings(frozenset(found))


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def parsed(pattern: str) -> Part:
    parser = _Parser(pattern)
    part = parser.alternatives()
    if parser.ahead():
        raise ValueError(f"a bracket too many: {pattern!r}")
    return part


def query_of(pattern: str) -> Query:
    """The trigram query of a pattern: any of these sets, each wholly. A set that is empty: every text may match."""
    part = parsed(pattern)
    return both(part.query, both(grams(part.starts), grams(part.ends)))


def held_by(pattern: str) -> frozenset[str]:
    """Strings of which every match holds one, in lower case; none of them holds another."""
    held = parsed(pattern).held
    return frozenset(x for x in held if not any(y != x and y in x for y in held))
