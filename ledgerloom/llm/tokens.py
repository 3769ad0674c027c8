"""Tokens of whole texts as the `tokenizers` library gives them, with a bounded memo of what single words give.

Words recur, so a worker asks the library once for each distinct word and joins the answers. This is exact only where
the library treats words independently, which holds for the texts that SAFE admits; all others go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np

#: Characters on whose class (letter, number, white space, case, normal form) Python and the library agree.
SAFE = re.compile(r"[\t\n\r -~\xa1-\xac\xae-\xff]*")
#: A blank beside other white space: the split at blanks does not give the library's words.
ODD = re.compile(r" [ \t\n\r]|[\t\n\r] ")
#: White space as the library's patterns have it, but for two that older ones count and newer ones do not.
SPACES, UNSURE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000", "\u180e\u200b"
#: Words that a worker remembers for good; those beyond are asked for anew in every group of texts.
MEMO = 250_000
#: Words that the library is asked for at once; words of a text that it is given for them.
ASK, JOINED = 20_000, 200
#: A mark after letters is a word of its own to either kind of tokenizer here.
TAILS = ".,;:!?"


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Memo(dict):
    """What the library gives for a word, by word."""

    tails: dict = {}

    def learn(self, words, ask) -> list[str]:
        """Ask for the words that are missing; those that forget() is to take out again are returned."""
        missing = [w for w in words if w not in self]
        ends = [w for w in missing if w[-1:] in TAILS and w[:-1].isalpha()] if self.tails else []
        need = list(set(missing).difference(ends) | {c for w in ends if (c := w[:-1]) not in self})
        full = len(self) > MEMO
        for i in range(0, len(need), ASK):
            self.update(zip(need[i : i + ASK], ask(need[i : i + ASK]), strict=True))
        self.update((w, self[w[:-1]] + self.tails[w[-1]]) for w in ends)
        return [*need, *ends] if full else []

    def forget(self, words: list[str]) -> None:
        for w in words:
            del self[w]


class WordIds:
    """Ids of texts by a tokenizer that lower-cases, drops white space and treats words apart."""

    def __init__(self, path: str):
        self.tokenizer, self.memo = load(path), _Memo()
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo.tails = dict(zip(TAILS, self._ask(list(TAILS)), strict=True))

    def _ask(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ask_words(self, words: list[str]) -> list[bytes]:
        """The same for lower-cased words without blanks and special strings: texts of many words cost the library less
        than as many texts, and the ids of a word are those that start in it."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out, size = [], self.kind.itemsize
        for own, e in zip(groups, self.tokenizer.encode_batch(list(map(" ".join, groups)), add_special_tokens=False), strict=True):
            starts = np.array([s for s, _ in e.offsets], np.int64)
            begins = np.cumsum([0, *(len(w) + 1 for w in own)])
            cuts, data = (np.searchsorted(starts, begins) * size).tolist(), np.array(e.ids, self.kind).tobytes()
            out += [data[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian numbers of `kind`."""
        # The lower-cased words must hold no special string either, which the library sees in texts as they are.
        split = [low.split() if SAFE.fullmatch(t) and not any(s in low or s in t for s in self.special) else None for t, low in zip(texts, map(str.lower, texts), strict=True)]
        extra = self.memo.learn(set().union(*(w for w in split if w is not None)), self._ask_words)
        get = self.memo.__getitem__
        out = [b"".join(map(get, w)) if w is not None else self._ask([t])[0] for t, w in zip(texts, split, strict=True)]
        self.memo.forget(extra)
        return out


@functools.cache
def kind_of(c: str) -> str:
    """L (letter), N (number), S (white space), O (other) or "" (unsure): what a character is to the library's patterns.
    A category that has been the same from Unicode 3.2 to Python's version is taken to be the library's too."""
    if c in SPACES:
        return "S"
    now = unicodedata.category(c)[0]
    if now != unicodedata.ucd_3_2_0.category(c)[0] or c in UNSURE or now in "CZ":
        return ""
    return now if now in "LN" else "O"


def stable(text: str, p: int) -> bool:
    """Whether no word of a byte-level tokenizer spans place p of text, whatever is around it.

    Words are letters, numbers or other characters, each kind apart and with a blank before them at most, or white
    space, or an apostrophe with the letters of a contraction. So a word ends before white space and where the kind
    changes, but for a change from white space or from an apostrophe.
    """
    left, right = kind_of(text[p - 1]), kind_of(text[p])
    return bool(left and right) and left not in ("S", right) and (right == "S" or text[p - 1] != "'")


class ByteCounts:
    """Token counts of texts by a byte-level tokenizer whose words take the blank before them."""

    def __init__(self, path: str):
        self.tokenizer, self.first, self.later = load(path), _Memo(), _Memo()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first.tails = self.later.tails = dict(zip(TAILS, self._ask(list(TAILS)), strict=True))

    def _ask(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _words(self, text: str) -> list[str] | None:
        return text.split(" ") if SAFE.fullmatch(text) and not ODD.search(text) and not any(s in text for s in self.special) else None

    def _learn(self, split: list[list[str]]) -> tuple[list[str], list[str]]:
        first = self.first.learn({w[0] for w in split}, self._ask)
        return first, self.later.learn(set().union(*(w[1:] for w in split)), lambda x: self._ask([" " + w for w in x]))

    def _forget(self, extra: tuple[list[str], list[str]]) -> None:
        self.first.forget(extra[0])
        self.later.forget(extra[1])

    def whole(self, texts: list[str]) -> list[int]:
        split = [self._words(t) for t in texts]
        extra = self._learn([w for w in split if w is not None])
        first, later = self.first.__getitem__, self.later.__getitem__
        out = [first(w[0]) + sum(map(later, w[1:])) if w is not None else self._ask([t])[0] for t, w in zip(texts, split, strict=True)]
        self._forget(extra)
        return out

    def bounds(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Places in text where a token starts (ascending; some, at least), the tokens before each, and all tokens."""
        if (words := self._words(text)) is not None:
            extra = self._learn([words])
            n = np.array([self.first[words[0]], *map(self.later.__getitem__, words[1:])], np.int64).cumsum()
            at = np.array([len(w) + 1 for w in words], np.int64).cumsum()[:-1] - 1
            self._forget(extra)
            return at, n[:-1], int(n[-1])
        starts = np.array([s for s, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets], np.int64)
        keep = np.diff(starts, prepend=-1) > 0
        return starts[keep], np.flatnonzero(keep), len(starts)


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@functools.cache
def byte_counts(path: str) -> ByteCounts:
    return ByteCounts(path)
