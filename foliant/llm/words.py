"""Words in a form that ignores case, outer punctuation and look-alike characters (as problem 5), with a bounded memo."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from foliant.llm.unify import LOOKALIKE

LOOK = str.maketrans(LOOKALIKE)
GONE = str.maketrans("", "", "​‌‍⁠﻿­")
NUMBERING = re.compile(r"\(?(?:\d{1,2}|[ivxIVX]{1,4}|[a-z])[.)]$")
EDGES = "".join(c for c in map(chr, range(0x21, 0x2E80)) if not c.isalnum() and unicodedata.category(c)[0] in "PS")
MEMO = 300_000


def plain(token: str) -> str:
    """Lower case, unified characters, no outer punctuation; '' for a token of signs only."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", token.translate(GONE))
        if any(c in LOOKALIKE for c in token) and (any("a" <= c.lower() <= "z" for c in token) or all(c in LOOKALIKE or not c.isalpha() for c in token)):
            token = token.translate(LOOK)
    return token.strip(EDGES).lower()


class Memo(dict):
    """token -> key(token), kept for at most ``MEMO`` tokens at a time."""

    def __init__(self, key):
        super().__init__()
        self.key = key

    def __missing__(self, token: str):
        if len(self) >= MEMO:
            self.clear()
        value = self[token] = self.key(token)
        return value


BROKEN = re.compile(r"[-\u00ac\u00ad][ \t]*\r?\n[ \t]*(?=[^\W\d_])")


def whole(text: str) -> list[str]:
    """The text's tokens, words cut at line ends joined."""
    return (BROKEN.sub("", text) if "-\n" in text or "\u00ac" in text or "-\r" in text else text).split()


NO = 0  # the number of a word outside the vocabulary


def flags(token: str) -> tuple[str, int]:
    """The plain word, and whether the token ends a sentence (2) or may begin one (1)."""
    p = plain(token)
    core = token.rstrip("\"'»”’)]")
    end = core[-1:] in (".", "!", "?", ";") and not (core[-1:] == "." and (len(p) == 1 and p.isalpha() or p.rsplit("'", 1)[-1] in ("fig", "eq", "al", "vol", "tab", "no", "abb", "gl", "dr")))
    return ("" if any(map(str.isdigit, p)) else p), 2 * end + (token[:1].isupper() or not token[:1].islower() and token[:1] in "¿¡«\"'“(")


class Corpus:
    """Tokens of many texts with their sentence and text numbers."""

    def __init__(self, texts: list[str | None], memo: Memo):
        flat: list[int] = []
        ends = [0]
        for t in texts:
            flat += map(memo.__getitem__, whole(t)) if t else ()
            ends.append(len(flat))
        code = np.array(flat, dtype=np.int64)
        self.word, marks = code >> 2, code & 3
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        new = np.zeros(len(code), dtype=bool)
        if len(code):
            new[1:] = (((marks[:-1] & 2) > 0) & ((marks[1:] & 1) > 0)) | (text[1:] != text[:-1])
        self.sentence = np.cumsum(new)
        self.first = np.flatnonzero(np.concatenate([[True], new[1:]])) if len(code) else np.zeros(0, dtype=np.int64)
        self.text = text[self.first]
        last = np.concatenate([self.first[1:], [len(code)]]) - 1 if len(code) else self.first
        #: whether a sentence begins like one and ends with a stop
        self.whole = ((marks[self.first] & 1) > 0) & ((marks[last] & 2) > 0)
        self.size = np.diff(np.concatenate([self.first, [len(code)]]))
        prev = np.concatenate([[NO], self.word[:-1]]) if len(code) else self.word
        prev[self.first] = NO
        self.prev = prev
