"""Token ids by the tokenizers library, with the ids of words that come again kept.

Both vocabularies that are used here split a text, before any merge, at places that depend on neighbouring
characters alone. So a text is cut at some of those places, each piece's ids come from the library once,
and pieces that come again are looked up. A cut is made only where the split is certain:

* byte vocabulary (a word carries the space before it): before a space that follows no white space, around single
  newlines between other characters, and before a last full stop or comma of a word that follows an ASCII letter;
* word vocabulary (white space is dropped): at white space, and before such a full stop or comma.

A text with control characters that engines class differently, or with the string of a special token, goes to the
library in one piece. The cache is bounded; so is what is held at a time.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces of the present generation in a worker's cache; the one before is kept too until the next begins.
KEPT = 250_000
#: Characters of texts that are encoded together.
TOGETHER = 1 << 22

#: Pieces that are encoded as one text.
GROUP = 200
#: How byte vocabularies write a space.
_SPACE = "\u0120"
_SEPARATOR = "\x01"
_CONTROL = "\0\x1c\x1d\x1e\x1f"
#: White space besides that of ASCII.
_RARE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BEFORE_SPACE = [c + " " for c in " \n\t\r\v\f"]
_BESIDE_LINE = [x for c in "\n\t\r\v\f" for x in (c + "\n", "\n" + c)] + [" \n"]
_RUNS = re.compile(r"\s+\S*|\S+")
_LAST_STOP, _LAST_COMMA = (re.compile(rf"{c}(?<=[A-Za-z]{c})(?= |\Z)") for c in (r"\.", ","))


class WordEncoder:
    """encode_many(texts): for each text the ids of Tokenizer.encode(text, add_special_tokens=False), as unsigned 32-bit integers."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.set_threshold(200_000, 50, 100)  # nothing here is cyclic, and the cache is large
        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: ids with which a piece starts where pieces are encoded together
        self.first = np.zeros(max(vocabulary.values()) + 1, bool)
        if spaced:
            self.first[[k for x, k in vocabulary.items() if x.startswith(_SPACE)]] = True
        else:
            self.first[self.tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _asked(self, pieces: list[str]) -> list[bytes]:
        """The library's ids of the pieces. Printable ones hold no white space and no separator, so many of them are
        encoded as one text: with spaces before them, ids that start with a space tell them apart, else a separator's id."""
        ids: dict[str, bytes] = {}
        plain = [x for x in pieces if x and x.isprintable()]
        before = " " if self.spaced else f" {_SEPARATOR} "
        groups = [plain[k : k + GROUP] for k in range(0, len(plain), GROUP)]
        made = self.tokenizer.encode_batch_fast([before + before.join(g) for g in groups], add_special_tokens=False)
        for group, x in zip(groups, made, strict=True):
            flat = np.array(x.ids, "<u4")
            cuts = [*np.flatnonzero(self.first[flat]).tolist(), len(flat)]
            if len(cuts) == len(group) + 1:
                raw, skip = flat.tobytes(), 0 if self.spaced else 4
                at = [4 * k for k in cuts]
                ids.update(zip(group, [raw[lo + skip : hi] for lo, hi in zip(at, at[1:], strict=False)], strict=True))
        rest = [x for x in pieces if x not in ids]
        ids.update(zip(rest, self.library([self._said(x) for x in rest]), strict=True))
        return [ids[x] for x in pieces]

    def _pieces(self, text: str) -> list[str] | None:
        """The pieces of a text; None if they are the parts of _joined(text) between spaces.

        Spaced: a piece has a space before it that isn't written, or starts with a mark, which isn't part of it."""
        if any(x in text for x in self.special) or any(c in text for c in _CONTROL):
            return ["\0" * self.spaced + text]
        if self.spaced and (any(x in text for x in _BEFORE_SPACE) or not text.isascii() and any(c in text for c in _RARE)):
            return ["\0" + x for x in _RUNS.findall(text)]
        return None

    def _joined(self, text: str) -> str:
        mark = "\0" * self.spaced
        if not self.spaced:
            text = " ".join(text.split())
        else:
            if "\n" in text and text[0] != "\n" != text[-1] and not any(x in text for x in _BESIDE_LINE):
                text = text.replace("\n", " \0\n \0")
            text = text[1:] if text[:1] == " " else "\0" + text
        return _LAST_COMMA.sub(f" {mark},", _LAST_STOP.sub(f" {mark}.", text))

    def _said(self, piece: str) -> str:
        return piece if not self.spaced else piece[1:] if piece[:1] == "\0" else " " + piece

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of the pieces, which differ. What only the last generation of the cache has moves to this one."""
        if len(self.known) > KEPT:
            self.known, self.before = {}, self.known
        ids = list(map(self.known.get, pieces))
        at = [k for k, x in enumerate(ids) if x is None]
        ask = []
        for k, x in zip(at, map(self.before.get, [pieces[k] for k in at]), strict=True):
            if x is None:
                ask.append(k)
            else:
                ids[k] = self.known[pieces[k]] = x
        for k, x in zip(ask, self._asked([pieces[k] for k in ask]), strict=True):
            ids[k] = x
            if len(pieces[k]) < 64:
                self.known[pieces[k]] = x
        return ids

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size < TOGETHER or end == at):
                size += len(texts[end])
                end += 1
            yield from self._encode_block(texts[at:end])
            at = end

    def _encode_block(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Pieces are split and numbered by Arrow, so Python sees each different piece of a block once."""
        listed = list(map(self._pieces, texts))
        joined = [self._joined(t) for t, x in zip(texts, listed, strict=True) if x is None]
        split = pc.split_pattern(pa.array(joined, pa.large_string()), " ")
        odd = [x for x in listed if x is not None]
        counts = np.empty(len(texts), np.int64)
        is_odd = np.fromiter((x is not None for x in listed), bool, len(texts))
        counts[~is_odd] = np.diff(split.offsets.to_numpy())
        counts[is_odd] = list(map(len, odd))
        pieces = pa.concat_arrays([split.flatten(), pa.array(chain.from_iterable(odd), pa.large_string())]).dictionary_encode()
        ids = self._ids_of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(ids), "<u4")
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        # places of the texts' pieces: the joined texts' come first
        order = np.argsort(is_odd, kind="stable")
        ends = np.empty(len(texts), np.int64)
        ends[order] = np.cumsum(counts[order])
        codes = pieces.indices.to_numpy()
        n = lengths[codes]
        stops = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(starts[codes] - stops[:-1], n) + np.arange(stops[-1])]
        for lo, hi in zip(stops[ends - counts].tolist(), stops[ends].tolist(), strict=True):
            yield out[lo:hi]


@lru_cache(maxsize=4)
def word_encoder(path: str, spaced: bool) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path, spaced)
