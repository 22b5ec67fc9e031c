"""Problem 1: noise of scanned pages, found and repaired.

Method

* A vocabulary of the corpus: words whose share of all words is at least ``MIN_SHARE``, so there are at most
  ``1 / MIN_SHARE`` of them however large the corpus is; that bounded table goes to every worker as a trie. Words below that
  share that are seen ``MIN_COUNT`` times are looked up for all misread words by a join on a key that misreadings leave alone
  (``rare_readings``); only the misread words so found, with their right words, go to the workers.
* Every unknown word gives a Levenshtein automaton (``Automaton``: all insertions, deletions and substitutions, ``EDITS`` of
  them), which is intersected with the trie for many words at once; all words of the trie within that distance are found.
  Scanning merges and splits letters, which are two edits or more, and a long word may hold several misreadings; so the
  automaton generalised by such moves (``candidates``: a letter, or a group of letters, read for another) is intersected with
  the trie as well. Candidates are ranked by cost, then by context (the word occurs elsewhere in the same text), then by
  frequency. A misreading of the table costs 1, another edit ``OTHER``. A word may cost as much as its length allows; one
  that holds an edit of the other sort is taken only if its text has the right word ``TOLD`` times or more. Words of names
  that hold a digit are repaired by a letter model.
* Page furniture: lines at the edges of a document's pages that come again on other pages (digits and misreadings ignored),
  and lines that hold a number only and count up with the pages.
* Lines are then reflowed: furniture goes, cut words are joined across lines and pages (a hyphen stays if the word is
  known with it), lines become paragraphs.

Null texts and pages give nothing; empty pages keep their number. Repeated rows give repeated findings (``distinct``
removes them). ``find_pages`` and ``find_chunks`` give ``(id, page_num int, noise string, token string)``; the row of
noise 'text' holds the repaired text, if asked for.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._arrow import id_schema, map_batches
from foliant.llm.names import edit
from foliant.llm.words import EDGES, Memo, plain
from foliant.session import cut

MIN_SHARE, MIN_COUNT, SALTS, MAX_UNKNOWN, HEADING, RARER = 5e-6, 4, 8, 0.4, "\n", 10
EDITS, OTHER, TOLD, LONGEST, ASKED, MEMO = 1, 4, 3, 62, 4096, 300_000
HYPHENS = "-¬­‐"
# What is read for what. Left: as printed, right: as read.
MISREAD = (
    ("a", "o"), ("o", "0"), ("o", "a"), ("o", "c"), ("e", "c"), ("c", "e"), ("i", "l"), ("i", "1"), ("l", "1"), ("l", "i"), ("t", "f"), ("f", "t"), ("s", "5"), ("h", "b"), ("b", "h"), ("b", "6"), ("é", "6"), ("g", "9"), ("g", "q"),
    ("v", "y"), ("y", "v"), ("z", "2"), ("u", "ii"), ("u", "v"), ("n", "ri"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("d", "cl"), ("cl", "d"), ("ti", "h"), ("li", "h"), ("h", "li"), ("ri", "n"), ("nn", "m"), ("in", "m"), ("m", "in"), ("e", "o"), ("r", "i"), ("n", "u"), ("u", "n"),
)
UNDO: dict[str, list[tuple[str, str]]] = {}
for _printed, _read in MISREAD:
    UNDO.setdefault(_read[0], []).append((_read, _printed))
NUMBER_LINE = re.compile(r"(?:([^\W\d_]{1,7}\.?)(?:\s+|(?=\d)))?(?:(?P<o>[-–—\[(])\s*)?(?P<n>\d{1,4}|[ivxlcdm]{1,15})(?:\s*(?P<c>[-–—\])]))?", re.I)
NUMBERED = re.compile(r"(?:\d+(?:\.\d+)*\.?|[IVX]{1,5}\.)\s+[^\W\d_]")
PAGE_WORD = frozenset("page pagc poge pag pag. p p. pg pg. seite seitc página pagina página. pág pág. s s. folio".split())
PARTED = re.compile(r"[-'’]")


class Trie(dict):
    """Nested dictionaries; the empty string marks a word's end and holds its count."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        for w, n in words.items():
            at = self
            for ch in w:
                at = at.setdefault(ch, {})
            at[""] = n


class Automaton:
    """Levenshtein automata of many words, run over one trie of all vocabulary words at the same time.

    The trie is three arrays: the children of a node are numbered one after another. An automaton's state is a bit set for
    each number of edits: bit i says that i letters of the word are read. A step reads a letter of the trie; branches whose
    states are all empty are left.
    """

    def __init__(self, words: list[str], edits: int = EDITS):
        self.words, self.edits = sorted(w for w in words if 0 < len(w) <= LONGEST), edits
        n = len(self.words)
        size = np.array([len(w) for w in self.words], dtype=np.int64)
        width = int(size.max(initial=1))
        letters = np.zeros((n, width), dtype=np.uint32)
        if n:
            letters = np.array(self.words, dtype=f"U{width}").view(np.uint32).reshape(n, width)
        same = np.ones(n, dtype=np.int64) * -1  # letters in common with the word before
        if n > 1:
            differ = letters[1:] != letters[:-1]
            same[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        self.letters, code = np.unique(letters, return_inverse=True)
        code = code.reshape(letters.shape)
        node = np.zeros(n, dtype=np.int64)
        total, codes, parents, ends = 1, [np.zeros(1, dtype=np.int64)], [np.full(1, -1)], np.full(1, -1)
        for d in range(1, width + 1):
            has = np.flatnonzero(size >= d)
            new = same[has] < d
            at = total - 1 + np.cumsum(new)
            parents.append(node[has][new])
            codes.append(code[has, d - 1][new])
            node[has] = at
            total += int(new.sum())
            ends = np.concatenate([ends, np.full(total - len(ends), -1)])
            full = size[has] == d
            ends[at[full]] = has[full]
        self.code, self.ends = np.concatenate(codes), ends
        parent = np.concatenate(parents)[1:]
        self.count = np.bincount(parent, minlength=total)
        self.first = np.concatenate([[1], 1 + np.cumsum(self.count)[:-1]])

    def within(self, asked: list[str]) -> list[list[tuple[str, int]]]:
        """For each word all vocabulary words within the number of edits, with their distance."""
        out: list[list[tuple[str, int]]] = [[] for _ in asked]
        for a in range(0, len(asked) if self.words else 0, ASKED):
            for k, i, e in self._within(asked[a : a + ASKED]):
                out[a + k].append((self.words[i], e))
        return out

    def _within(self, asked: list[str]) -> list[tuple[int, int, int]]:
        asked = [w if len(w) <= LONGEST else "" for w in asked]
        masks = np.zeros((len(asked), len(self.letters)), dtype=np.uint64)
        place = {chr(c): k for k, c in enumerate(self.letters.tolist())}
        for k, w in enumerate(asked):
            for i, ch in enumerate(w):
                if ch in place:
                    masks[k, place[ch]] |= np.uint64(1 << i)
        size = np.array([len(w) for w in asked], dtype=np.uint64)
        one = np.uint64(1)
        who = np.flatnonzero(size > 0)
        node = np.zeros(len(who), dtype=np.int64)
        state = [np.full(len(who), (1 << (e + 1)) - 1, dtype=np.uint64) for e in range(self.edits + 1)]
        found = []
        while len(who):
            many = self.count[node]
            back = np.repeat(np.arange(len(who)), many)
            child = np.repeat(self.first[node] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(back))
            who, node = who[back], child
            hit = masks[who, self.code[child]]
            old = [r[back] for r in state]
            state = [(old[0] & hit) << one]
            for e in range(1, self.edits + 1):
                state.append(((old[e] & hit) << one) | old[e - 1] | ((old[e - 1] | state[e - 1]) << one))
            alive = (state[-1] & ((one << (size[who] + one)) - one)) != 0
            who, node, state = who[alive], node[alive], [r[alive] for r in state]
            end = np.flatnonzero((self.ends[node] >= 0) & ((state[-1] >> size[who]) & one).astype(bool))
            for k in end.tolist():
                e = next(e for e in range(self.edits + 1) if (int(state[e][k]) >> int(size[who[k]])) & 1)
                found.append((int(who[k]), int(self.ends[node[k]]), e))
        return found


def candidates(trie: dict, word: str, most: int) -> dict[str, tuple[int, int]]:
    """All words of the trie that are read as ``word`` with at most ``most`` misreadings: word -> (misreadings, count)."""
    found: dict[str, tuple[int, int]] = {}
    stack = [(trie, 0, 0, "")]
    n = len(word)
    while stack:
        node, i, used, got = stack.pop()
        if i == n:
            if "" in node and used and (got not in found or found[got][0] > used):
                found[got] = (used, node[""])
            continue
        ch = word[i]
        nxt = node.get(ch)
        if nxt is not None:
            stack.append((nxt, i + 1, used, got + ch))
        if used < most and ch in UNDO:
            for read, printed in UNDO[ch]:
                if word.startswith(read, i):
                    at: dict | None = node
                    for p in printed:
                        at = at.get(p)  # type: ignore[union-attr]
                        if at is None:
                            break
                    if at is not None:
                        stack.append((at, i + len(read), used + 1, got + printed))
    return found


def most_misreadings(word: str) -> int:
    """How many misreadings a word may hold; none if it is too short or has too few letters to tell."""
    return 0 if len(word) < 3 or sum(map(str.isalpha, word)) < 2 else 1 if len(word) < 6 else 2 if len(word) < 12 else 3


def may_be_misread(word: str) -> bool:
    """Whether a word holds digits, but as few as misread letters may give."""
    digits = sum(map(str.isdigit, word))
    return 0 < digits <= max(1, len(word) // 3) and word.isalnum() and most_misreadings(word) > 0


class Letters:
    """A letter-trigram model of the vocabulary, for names that are in no vocabulary."""

    def __init__(self, words: dict[str, int]):
        self.tri: Counter[str] = Counter()
        self.bi: Counter[str] = Counter()
        for w in words:
            p = f"^^{w}$"
            for i in range(len(p) - 2):
                self.tri[p[i : i + 3]] += 1
                self.bi[p[i : i + 2]] += 1

    def of(self, two: str, ch: str) -> float:
        """Log-probability of a letter behind two others."""
        return math.log((self.tri[two + ch] + 0.1) / (self.bi[two] + 3))

    def score(self, w: str) -> float:
        p = f"^^{w}$"
        return sum(self.of(p[i : i + 2], p[i + 2]) for i in range(len(p) - 2))


class Reader:
    """Knows the vocabulary, and for a token says what was printed."""

    def __init__(self, words: dict[str, int], caps: dict[str, int], headings: frozenset[str] = frozenset(), rare: dict[str, list[tuple[int, int, int, str]]] | None = None):
        """``rare``: misread word -> (misreadings, count, times with a capital, right word), the right words being in no trie."""
        self.words, self.headings = words, headings
        self.rare = {w: {right: (used, n) for used, n, _, right in got} for w, got in (rare or {}).items()}
        seen = [x for got in (rare or {}).values() for x in got]
        self.count = words | {right: n for _, n, _, right in seen}
        self.caps = caps | {right: c for _, _, c, right in seen}
        self.trie, self.letters = Trie(words), Letters(words)
        self.plain = Memo(plain)
        self.known = Memo(self._known)
        self.options = Memo(self._options)
        self.near: dict[str, list[tuple[str, int]]] = {}
        self._automaton: Automaton | None = None

    @property
    def automaton(self) -> Automaton:
        """Made where it is used, of the words sent."""
        if self._automaton is None:
            self._automaton = Automaton(list(self.words))
        return self._automaton

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "near": {}}

    def _known(self, token: str) -> bool:
        w = self.plain[token]
        if len(w) < 2 or not any(map(str.isalpha, w)) or w in self.words:
            return True
        return all(len(p) < 2 and not p.isdigit() or p in self.words for p in PARTED.split(w))

    def _options(self, word: str) -> list[tuple[int, int, str]]:
        """(cost, -count, word) of what may have been read as the word, the cheapest and those of other edits."""
        if not (most := most_misreadings(word)):
            return []
        if word not in self.near:
            self.near[word] = self.automaton.within([word])[0]
        got = candidates(self.trie, word, most) | self.rare.get(word, {})
        other = {w: (OTHER * e, self.count[w]) for w, e in self.near[word] if e and w not in got}
        least = min((u for u, _ in got.values()), default=OTHER)
        return sorted((u, -n, w) for w, (u, n) in (got | other).items() if u == least or u >= OTHER)

    def ask(self, tokens: Iterable[str]) -> None:
        """Looks up all words of some texts at once."""
        asked = {p for t in set(tokens) if not self.known[t] for p in re.split("[-'’]", self.plain[t]) if p not in self.words and p not in self.near and most_misreadings(p)}
        if len(self.near) > MEMO:
            self.near.clear()
        todo = sorted(asked)
        self.near.update(zip(todo, self.automaton.within(todo)))

    def digits_out(self, word: str, context: dict[str, int] | set[str]) -> str | None:
        """A name with digits among its letters, letters put for them: a reading that the text has, else the one the letter model likes best."""
        puts = [[ch] if not ch.isdigit() else [p for r, p in UNDO.get(ch, ()) if r == ch] for ch in word]
        if not all(puts):
            return None
        there = [f for f in context if len(f) == len(word) and all(ch in p for ch, p in zip(f, puts))]
        if there:
            return max(there, key=lambda f: (self.letters.score(f), f))
        best = {"^^": (0.0, "")}  # the best reading that ends in each two letters
        for p in [*puts, ["$"]]:
            step: dict[str, tuple[float, str]] = {}
            for two, (score, text) in best.items():
                for ch in p:
                    now = (score + self.letters.of(two, ch), text + ch)
                    step[two[1] + ch] = max(step.get(two[1] + ch, now), now)
            best = step
        return max(best.values())[1][:-1]

    def printed(self, token: str, context: dict[str, int] | set[str], starts: bool, guess: bool = True) -> str | None:
        """The right word of a misread token, or None. ``starts``: the token begins a sentence. ``guess``: names may be read by the letter model."""
        w = self.plain[token]
        seen = context if isinstance(context, Counter) else Counter()
        told = lambda right, part: part.isalpha() and len(part) == len(right) and seen[right] >= TOLD and seen[part] == 1
        bare = token.strip(EDGES)
        cap = bare[:1].isupper()
        out = []
        changed = False
        for k, part in enumerate(re.split(r"([-'’])", w)):
            if k % 2 or len(part) < 2 and not part.isdigit() or part in self.words:
                out.append(part)
                continue
            digits = any(map(str.isdigit, part))
            if digits and sum(map(str.isdigit, part)) > max(1, len(part) // 3):
                return None
            options = self.options[part]
            if cap and not starts and not digits:
                options = [x for x in options if self.caps.get(x[2], 0) * 2 >= self.count[x[2]]]
            elif not cap and not digits:
                options = [x for x in options if self.caps.get(x[2], 0) < 0.9 * self.count[x[2]]]
            options = [x for x in options if x[0] < OTHER or told(x[2], part)]
            if options:
                out.append(min(options, key=lambda x: (x[0], x[2] not in context, x[1]))[2])
                changed = True
            elif guess and digits and len(part) > 4 and not part[:1].isdigit() | part[-1:].isdigit() and (fixed := self.digits_out(part, context)):
                out.append(fixed)
                changed = True
            else:
                return None
        return "".join(out) if changed else None


def tail_word(line: str) -> str | None:
    """The cut word's first part if the line ends in a hyphen after a letter."""
    s = line.rstrip()
    if len(s) < 2 or s[-1] not in HYPHENS or not s[-2].isalpha():
        return None
    return s[:-1].split()[-1].lstrip(EDGES)


def whole_word(reader: Reader, first: str, hyphen: str, second: str) -> tuple[str, bool]:
    """The whole word of two parts, lower case without outer punctuation, and whether the hyphen belongs to it."""
    joined, kept = reader.plain[first + second], reader.plain[f"{first}-{second}"]
    if hyphen in "¬­":
        return joined, False
    a, b = reader.words.get(kept, 0), reader.words.get(joined, 0)
    if a or b:
        return (kept, True) if a > b else (joined, False)
    if second[:1].isupper() and first[:1].isupper():
        return kept, True
    x, y = reader.plain[first], reader.plain[second]
    if "-" in first or reader.printed(joined, (), True):
        return joined, False
    if x in reader.words and y in reader.words and len(x) > 2 and len(y) > 2 and not first[:1].isupper():
        return (kept, True) if min(reader.words[x], reader.words[y]) > 50 * (b + 1) and not reader.printed(joined, (), False) else (joined, False)
    return joined, False


FOLD = str.maketrans({"0": "o", "a": "o", "c": "e", "é": "e", "í": "l", "i": "l", "1": "l", "f": "t", "5": "s", "b": "h", "6": "h", "9": "g", "q": "g", "y": "v", "2": "z"})


def fold_line(line: str) -> str:
    """A line's key: numbers and letters read for one another ignored."""
    s = re.sub(r"(?<![^\W\d_])\d+(?![^\W\d_])", "#", line.lower())
    return " ".join(re.sub(r"[^\w#\s]", "", s.translate(FOLD)).split())


def near_key(key: str, keys) -> str | None:
    """The key among ``keys`` that differs by misread groups of letters at most (one edit in ten letters, three at most)."""
    if key in keys:
        return key
    most = min(3, len(key) // 10)
    if most:
        for k in keys:
            if abs(len(k) - len(key)) <= most and (k[:4] == key[:4] or k[-4:] == key[-4:]) and edit(k, key, most) <= most:
                return k
    return None


ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(s: str) -> int | None:
    """The value of a numeral in its usual form, else None."""
    values = [ROMAN[c] for c in s.lower()]
    total = sum(-v if any(w > v for w in values[k + 1 : k + 2]) else v for k, v in enumerate(values))
    forms = (("m", 1000), ("cm", 900), ("d", 500), ("cd", 400), ("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1))
    rest, usual = total, ""
    for letters, v in forms:
        while rest >= v:
            usual, rest = usual + letters, rest - v
    return total if usual == s.lower() else None


def number_of(line: str) -> tuple[int, bool] | None:
    """The number of a line that holds one only, and whether it is dressed (Page 9, - 9 -, [ 9 ])."""
    s = line.strip()
    if not s or len(s) > 18:
        return None
    m = NUMBER_LINE.fullmatch(s)
    if not m or m[1] and m[1].lower() not in PAGE_WORD:
        if not any(map(str.isdigit, s)) or len(s) > 8:
            return None
        m = NUMBER_LINE.fullmatch(s.translate(str.maketrans("olOISB", "010158")))
        if not m or m[1]:
            return None
    o, c = m["o"], m["c"]
    if (o is None) != (c is None) or o in ("[", "(") and c not in ("]", ")") or o in ("-", "–", "—") and c not in ("-", "–", "—"):
        return None
    n = int(m["n"]) if m["n"].isdigit() else roman(m["n"])
    return None if n is None else (n, bool(m[1] or o and (o != "(" and " " in s)))


EDGE = 3


def page_edges(lines: list[str]) -> tuple[list[int], list[int]]:
    """Indexes of the first and last non-blank lines."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return full[:2], [i for i in full[-EDGE:] if i not in full[:2]]


def is_heading(line: str, headings: frozenset[str] | set[str]) -> bool:
    s = line.strip()
    return bool(NUMBERED.match(s)) and len(s.split()) <= 6 and not re.search(r"\s{3,}|\d$", s) or fold_line(s) in headings


def furniture(pages: list[list[str]], headings: frozenset[str] | set[str] = frozenset()) -> tuple[dict[tuple[int, int], str], dict[str, int], list[int]]:
    """(page, line) -> 'running_line' or 'page_number'; keys of running lines with their counts; offsets of the numbers."""
    seen: Counter[str] = Counter()
    where: list[tuple[int, int, str, int]] = []
    numbers: list[tuple[int, int, int, bool]] = []
    for p, lines in enumerate(pages):
        top, bottom = page_edges(lines)
        mine = set()
        for rank, i in [*((r, i) for r, i in enumerate(top)), *((r, i) for r, i in enumerate(reversed(bottom)))]:
            if (got := number_of(lines[i])) is not None:
                numbers.append((p, i, got[0], got[1]))
            elif len(lines[i].strip()) <= 120 and any(map(str.isalpha, lines[i])) and not (p == 0 and rank == 0 and i in top) and not is_heading(lines[i], headings):
                key = fold_line(lines[i])
                where.append((p, i, key, rank))
                mine.add(key)
        seen.update(mine)
    out: dict[tuple[int, int], str] = {}
    offsets = Counter(n - p for p, _, n, _ in numbers)
    good = {o for o, n in offsets.items() if n >= 2}
    per_page: dict[int, set] = {}
    for p, i, n, dressed in numbers:
        if n - p in good:
            out[p, i] = "page_number"
            per_page.setdefault(p, set()).add(i)
    main = offsets.most_common(1)[0][0] if good else None
    for p, i, n, dressed in numbers:
        if (p, i) not in out and dressed and (main is None or abs(n - p - main) <= 1) and p not in per_page:
            out[p, i] = "page_number"
    keys: dict[str, int] = {}
    for key in [k for k in seen if len(k) > 3]:  # a misread copy counts for the key it is near
        if seen[key] >= 2:
            keys[key] = seen[key]
        elif (other := near_key(key, [k for k in seen if k != key])) is not None:
            keys[key] = seen[key] + seen[other]
    for p, i, key, rank in where:
        if key in keys:
            out[p, i] = "running_line"
    return out, keys, sorted(good)


def sentence_start(tokens: list[str], k: int) -> bool:
    return k == 0 or tokens[k - 1].rstrip("\"'»”’)]")[-1:] in (".", "!", "?", ":", ";") or not any(map(str.isalnum, tokens[k - 1]))


def read_lines(reader: Reader, numbered: list[tuple[int, str]], want_text: bool) -> tuple[list[tuple[int, str, str]], str | None]:
    """Findings (page, noise, token) of body lines, and the repaired text. ``numbered``: lines with their pages, furniture left out."""
    found: list[tuple[int, str, str]] = []
    context: Counter[str] = Counter()
    plain_of = reader.plain
    for _, x in numbered:
        context.update(map(plain_of.__getitem__, x.split()))
    last_full = max((k for k, (_, x) in enumerate(numbered) if x.strip()), default=-1)
    known = [reader.known[t] for _, x in numbered for t in x.split()]
    readable = sum(known) >= (1 - MAX_UNKNOWN) * len(known)  # else it is no text, and nothing can be said of its words
    out: list[str] = []
    carry: tuple[int, str, str] | None = None  # page, first part with what stands before it, hyphen
    before: list[str] = []
    for at, (page, line) in enumerate(numbered):
        tokens = line.split()
        if not tokens:
            if carry is None and out and out[-1] != "\n\n":
                out.append("\n\n")
            continue
        fixed = tokens[:] if want_text else tokens
        skip = 0
        if carry is not None:
            first_page, first, hyphen = carry
            raw, second = tokens[0], tokens[0].rstrip(EDGES)
            if second[:1].isalpha() and (second[:1].islower() or first.lstrip(EDGES)[:1].isupper() or first.isupper()):
                word, kept = whole_word(reader, first.lstrip(EDGES), hyphen, second)
                right = word
                if not reader.known[word]:
                    fix = reader.printed(word, context, sentence_start([*before, first], len(before)))
                    if fix:
                        right = fix
                        found.append((first_page, "misread", fix))
                found.append((first_page, "broken_word", right))
                if want_text:
                    fixed[0] = like(first + ("-" if kept else "") + raw, right if right != word else None)
                skip = 1
            elif want_text:
                fixed[0] = first + hyphen + " " + raw
            carry = None
        last = len(tokens)
        part = tail_word(line)
        if part is not None and at < last_full:
            last -= 1
            carry = (page, tokens[-1].rstrip()[:-1], tokens[-1].rstrip()[-1])
        for k in range(skip, last):
            t = tokens[k]
            if readable and not reader.known[t]:
                fix = reader.printed(t, context, sentence_start(tokens, k) if k else not before or sentence_start(before + tokens, len(before)))
                if fix:
                    found.append((page, "misread", fix))
                    if want_text:
                        fixed[k] = like(t, fix)
        before = tokens[-2:]
        if want_text:
            out.append(" ".join(fixed[:last]) if last else "")
    if want_text and carry is not None:
        out.append(carry[1] + carry[2])
    text = re.sub(r" *\n\n *", "\n\n", " ".join(x for x in out if x)).strip() if want_text else None
    return found, text


def like(token: str, word: str | None) -> str:
    """The word in the token's case and punctuation; without a word the token itself."""
    if word is None:
        return token
    core = token.strip(EDGES)
    lead, trail = token[: token.find(core)] if core else "", token[token.find(core) + len(core) :] if core else ""
    word = word.upper() if core.isupper() and len(core) > 1 else word[:1].upper() + word[1:] if core[:1].isupper() else word
    return lead + word + trail


def find_in_pages(reader: Reader, pages: list[str | None], want_text: bool) -> tuple[list[tuple[int, str, str]], str | None]:
    lines = [(p or "").splitlines() for p in pages]
    marks, _, _ = furniture(lines, reader.headings)
    found = [(p + 1, noise, lines[p][i].strip()) for (p, i), noise in marks.items()]
    body = [(p + 1, x) for p, ls in enumerate(lines) for i, x in enumerate(ls) if (p, i) not in marks]
    # blank lines beside furniture at a page's edge are the page's, not the text's
    more, text = read_lines(reader, trim_edges(body), want_text)
    return found + more, text


def trim_edges(body: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Body lines without the blank ones at the pages' edges, unless the page before ends a sentence."""
    out: list[tuple[int, str]] = []
    pages: dict[int, list[str]] = {}
    for p, x in body:
        pages.setdefault(p, []).append(x)
    for p, ls in pages.items():
        while ls and not ls[0].strip():
            ls.pop(0)
        while ls and not ls[-1].strip():
            ls.pop()
        if out and ls and out[-1][1].rstrip()[-1:] in ".!?" and ls[0][:1].isupper():
            out.append((p, ""))
        out += [(p, x) for x in ls]
    return out


def find_in_chunk(reader: Reader, text: str, keys: set[str], offsets: list[int], n_pages: int, first_page: int, last_page: int, want_text: bool) -> tuple[list[tuple[int, str, str]], str | None]:
    """A chunk is a stretch of its document's pages: furniture stands between its lines. keys, offsets: of the document."""
    lines = text.splitlines()
    found, body = [], []
    for i, x in enumerate(lines):
        s = x.strip()
        noise = None
        if s:
            if (got := number_of(s)) is not None:
                # the number of one of the chunk's own pages
                if any(first_page - 2 <= got[0] - o <= last_page + 1 for o in offsets) and (got[1] or offsets):
                    noise = "page_number"
            elif keys and len(s) <= 120 and near_key(fold_line(s), keys) is not None and not (first_page <= 1 and not any(y.strip() for y in lines[:i])):
                noise = "running_line"
        if noise:
            found.append((0, noise, s))
        else:
            body.append((0, x))
    # a blank line beside furniture within a sentence isn't a paragraph's end
    kept: list[tuple[int, str]] = []
    for k, (p, x) in enumerate(body):
        if not x.strip() and found and k + 1 < len(body):
            prev = next((y for _, y in reversed(kept) if y.strip()), "")
            nxt = next((y for _, y in body[k + 1 :] if y.strip()), "")
            if prev and nxt and (tail_word(prev) is not None or nxt.lstrip()[:1].islower()):
                continue
        kept.append((p, x))
    more, repaired = read_lines(reader, kept, want_text)
    return found + more, repaired


def find_in_lines(reader: Reader, text: str, want_text: bool) -> tuple[list[tuple[int, str, str]], str | None]:
    """Misread words of a table or an equation. It holds no furniture and no cut words, and its lines and spaces stay.
    Digits stand in names of files and in formulas there, so only known words are put for them."""
    parts = re.split(r"(\s+)", text)
    tokens = parts[::2]
    readable = sum(reader.known[t] for t in tokens if t) >= (1 - MAX_UNKNOWN) * sum(map(bool, tokens))
    found: list[tuple[int, str, str]] = []
    for k, t in enumerate(tokens):
        if readable and t and not reader.known[t]:
            begins = k == 0 or "\n" in parts[2 * k - 1] or sentence_start(tokens, k)
            if fix := reader.printed(t, (), begins, guess=False):
                found.append((0, "misread", fix))
                parts[2 * k] = like(t, fix)
    return found, "".join(parts) if want_text else None


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, n, caps) over all texts; cut words are joined, so parts don't count. ``caps``: times written with a capital.
    Words with a few digits among their letters are counted too."""

    def make():
        pl = Memo(plain)
        cut_word = re.compile(r"[-¬­][ \t]*\r?\n\s*(?=[^\W\d_])")

        def work(b: pa.RecordBatch) -> dict:
            raw: Counter[str] = Counter()
            n: Counter[str] = Counter()
            caps: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    raw.update((cut_word.sub("", t) if "\n" in t else t).split())
                    if "\n" in t:
                        lines = t.split("\n")
                        # headings: short lines on their own, within the text
                        n.update(HEADING + fold_line(x) for k, x in enumerate(lines[2:-3], 2) if 2 < len(x) < 42 and (not lines[k - 1].strip() or not lines[k + 1].strip()) and x.rstrip()[-1:].isalnum() and x[:1].upper() == x[:1])
            for token, k in raw.items():
                w = pl[token]
                if not w:
                    continue
                cap = token.strip(EDGES)[:1].isupper()
                for part in {w, *PARTED.split(w)} if "-" in w or "'" in w or "’" in w else (w,):
                    if part.replace("-", "").replace("'", "").replace("’", "").isalpha() or may_be_misread(part):
                        n[part] += k
                        caps[part] += k * cap
            # words of one batch that are rare everywhere are most of the rows; they are summed before the shuffle
            return {"word": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64()), "caps": pa.array([caps[w] for w in n], pa.int64())}

        return work

    rows = map_batches(texts.select(text), make, "word string, n bigint, caps bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("caps").alias("caps"))


def misread_key(word: Column) -> Column:
    """Equal for any two words that MISREAD makes of one another: letters with strokes only count as one stroke, a run of them too."""
    key = F.translate(F.replace(word, F.lit("d"), F.lit("cl")), "l1rnuvymwtfhb6éa0ce592q", "iiiiiiiiiiiiiiioooosgzg")
    return F.regexp_replace(key, "i+", "i")


def rare_readings(counts: DataFrame, floor: int, reader: Reader) -> DataFrame:
    """(word, used, n, caps, right): the words too rare for the reader's vocabulary (MIN_COUNT times at least, less than ``floor``)
    with each word that is read for them: one seen less than MIN_COUNT times, or RARER times less often than the right word.
    Words that the reader takes for misreadings themselves are not right. Words meet by ``misread_key``; none is sent to all tasks."""
    words = counts.where((F.col("n") < floor) & ~F.startswith("word", F.lit(HEADING))).withColumn("key", misread_key(F.col("word")))
    right = words.where((F.col("n") >= MIN_COUNT) & ~F.col("word").rlike("[0-9]")).select("key", F.col("word").alias("right"), F.col("n").alias("n_right"), F.col("caps").alias("caps_right"))
    near = F.abs(F.length("word") - F.length("right")) <= 3  # a misreading changes the length by one at most
    rarer = (F.col("n") < MIN_COUNT) | (F.col("n") * RARER <= F.col("n_right"))
    pairs = words.join(right, "key").where(near & rarer & (F.col("word") != F.col("right"))).select("word", "right", "n_right", "caps_right")

    def make():
        def misread(right: str, caps: int, n: int) -> bool:
            return reader.printed(right.capitalize() if caps == n else right, (), False) is not None

        def work(b: pa.RecordBatch) -> dict:
            out = []
            for word, right, n, caps in zip(*(b.column(k).to_pylist() for k in range(4))):
                most = most_misreadings(word)
                used = candidates(Trie({right: n}), word, most).get(right, (0, 0))[0] if most else 0
                if used and not misread(right, caps, n):
                    out.append((word, used, n, caps, right))
            kinds = {"word": pa.string(), "used": pa.int32(), "n": pa.int64(), "caps": pa.int64(), "right": pa.string()}
            return {c: pa.array([x[k] for x in out], kind) for k, (c, kind) in enumerate(kinds.items())}

        return work

    return map_batches(pairs, make, "word string, used int, n bigint, caps bigint, right string")


def reader_of(texts: DataFrame, text: str) -> Reader:
    """The vocabulary of all texts: words of at least MIN_SHARE of all, and MIN_COUNT; at most 1 / MIN_SHARE words. Words
    below that share, but of MIN_COUNT, are known by the words that are misread for them."""
    counts = cut(word_counts(texts, text))
    in_words = F.startswith("word", F.lit(HEADING)) | ~F.col("word").rlike("[0-9]")
    total = counts.where(in_words).agg(F.sum("n")).first()[0] or 0
    floor = max(MIN_COUNT, math.ceil(MIN_SHARE * total))
    kept = counts.where(in_words & (F.col("n") >= floor)).collect()
    heads = frozenset(r.word[1:] for r in kept if r.word[:1] == HEADING)
    kept = [r for r in kept if r.word[:1] != HEADING]
    words, caps = {r.word: r.n for r in kept}, {r.word: r.caps for r in kept}
    rare: dict[str, list[tuple[int, int, int, str]]] = {}
    if floor > MIN_COUNT:
        for r in rare_readings(counts, floor, Reader(words, caps)).collect():
            rare.setdefault(r.word, []).append((r.used, r.n, r.caps, r.right))
    return Reader(words, caps, heads, rare)


FOUND = "page_num int, noise string, token string"


def _rows(b: pa.RecordBatch, ids: list[str], out: list[tuple[int, int, str, str]]) -> dict:
    take = pa.array([x[0] for x in out], pa.int64())
    return {c: b.column(k).take(take) for k, c in enumerate(ids)} | {
        "page_num": pa.array([x[1] for x in out], pa.int32()),
        "noise": pa.array([x[2] for x in out], pa.string()),
        "token": pa.array([x[3] for x in out], pa.string()),
    }


def find_pages(df: DataFrame, ids: list[str], pages: str, reader: Reader, want_text: bool = False) -> DataFrame:
    n = len(ids)

    def make():
        def work(b: pa.RecordBatch) -> dict:
            out = []
            pages_of = b.column(n).to_pylist()
            reader.ask(t for ps in pages_of for p in ps or () for t in (p or "").split())
            for i, ps in enumerate(pages_of):
                if ps:
                    found, text = find_in_pages(reader, ps, want_text)
                    out += [(i, *x) for x in dict.fromkeys(found)]
                    if want_text:
                        out.append((i, 0, "text", text))
            return _rows(b, ids, out)

        return work

    return map_batches(df.select(*ids, F.col(pages).alias("__p")), make, f"{id_schema(df, ids)}, {FOUND}")


def page_furniture(df: DataFrame, doc: str, pages: str, headings: frozenset[str] = frozenset()) -> DataFrame:
    """(doc, keys array, offsets array, n_pages) of every document with pages."""

    def make():
        def work(b: pa.RecordBatch) -> dict:
            got = [furniture([(p or "").splitlines() for p in ps], headings)[1:] if ps else ({}, []) for ps in b.column(1).to_pylist()]
            size = [len(ps or ()) for ps in b.column(1).to_pylist()]
            return {"doc": b.column(0).cast(pa.string()), "keys": pa.array([sorted(k) for k, _ in got], pa.list_(pa.string())), "offsets": pa.array([o for _, o in got], pa.list_(pa.int64())), "n_pages": pa.array(size, pa.int32())}

        return work

    rows = map_batches(df.select(doc, pages), make, "doc string, keys array<string>, offsets array<bigint>, n_pages int")
    return rows.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys"), F.array_distinct(F.flatten(F.collect_set("offsets"))).alias("offsets"), F.max("n_pages").alias("n_pages"))


def find_chunks(df: DataFrame, ids: list[str], doc: str, text: str, page_start: str, page_end: str, marks: DataFrame, reader: Reader, want_text: bool = False, laid_out: Column | None = None) -> DataFrame:
    """``marks``: page_furniture of the documents. Only texts of several lines meet it; a hot document's chunks go over SALTS tasks.
    ``laid_out``: rows whose lines are no running text (tables, equations); they meet no furniture and aren't reflowed."""
    n = len(ids)
    base = df.where(F.col(text).isNotNull()).select(*ids, F.col(doc).cast("string").alias("__doc"), F.col(text).alias("__t"), F.col(page_start).cast("int").alias("__a"), F.col(page_end).cast("int").alias("__b"), F.coalesce(F.lit(False) if laid_out is None else laid_out, F.lit(False)).alias("__l"))
    wrapped = F.col("__t").contains("\n") & ~F.col("__l")
    some = marks.where((F.size("keys") > 0) | (F.size("offsets") > 0)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = base.where(wrapped).withColumn("__salt", F.pmod(F.xxhash64(*ids), F.lit(SALTS)).cast("int"))
    met = left.join(some, (left["__doc"] == some["doc"]) & (left["__salt"] == some["salt"]), "left").select(*ids, "__t", "__a", "__b", "keys", "offsets", "__l")
    single = base.where(~wrapped).select(*ids, "__t", "__a", "__b", F.lit(None).cast("array<string>").alias("keys"), F.lit(None).cast("array<bigint>").alias("offsets"), "__l")

    def make():
        def work(b: pa.RecordBatch) -> dict:
            out = []
            cols = [b.column(n + k).to_pylist() for k in range(6)]
            reader.ask(x for t in cols[0] for x in t.split())
            for i, (t, a, z, keys, offsets, lines) in enumerate(zip(*cols)):
                found, repaired = find_in_lines(reader, t, want_text) if lines else find_in_chunk(reader, t, set(keys or ()), offsets or [], 0, a or 0, z or 10**6, want_text)
                out += [(i, *x) for x in dict.fromkeys(found)]
                if want_text:
                    out.append((i, 0, "text", repaired))
            return _rows(b, ids, out)

        return work

    return map_batches(met.unionByName(single), make, f"{id_schema(df, ids)}, {FOUND}")
