"""Noise in text from scanned pages (problem 5).

1. Counting.  Ordinary words of the whole corpus are counted; words of a
   relative frequency of at least ``LEAST_SHARE`` (so at most 1 / LEAST_SHARE
   of them, usually a few thousand) form the vocabulary.  A word that one or
   two edits turn into another word ``RATIO`` times as frequent is itself a
   misreading and leaves it.
2. Candidates.  A Levenshtein automaton of the suspect word is intersected
   with a trie of the vocabulary, which finds every word within the distance.
3. Ranking.  Candidates are ranked by the edits (look-alikes cost less), by the
   neighbouring words and by frequency.
4. Page furniture (running headers and footers, page numbers) is found per
   text from repetition over its pages and from page number series, then
   removed; cut words are joined and lines reflowed to paragraphs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.plans.scratch import Scratch

LEAST_SHARE, LEAST_COUNT, RATIO = 1e-6, 3, 60
# Groups of letters that scanners take for one another.
LOOK_ALIKE = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ri", "n"), ("li", "h"), ("ii", "u"), ("ni", "m"), ("in", "m"), ("nn", "m"), ("lc", "k"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"), ("9", "g"), ("6", "b"), ("3", "e"), ("4", "a"), ("@", "a"), ("l", "i"), ("i", "l"), ("f", "t"), ("c", "e"), ("b", "h"), ("u", "a"), ("v", "y"), ("n", "u"), ("I", "l"), ("|", "l"), ("0", "O"), ("1", "I"), ("5", "S"), ("8", "B"), ("d", "cl"), ("m", "rn"), ("n", "ri"), ("w", "vv"), ("u", "ii"))
CUT_SIGNS = "-‐‑¬­~"


def scan_text() -> Column:
    blank = F.coalesce(F.col("original_ocr_text"), F.lit("")).rlike(r"^[\s\p{Z}\p{Cf}]*$")
    return F.when(blank, F.col("extracted_text")).otherwise(F.col("original_ocr_text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over column ``text``: lower-case words, and capitalised ones that open a sentence before a lower-case word."""
    low = F.regexp_extract_all(F.col("text"), F.lit(r"(?<![\p{L}\p{M}\p{N}@.+_/\-])([\p{Ll}\p{Lo}\p{M}]{2,}(?:-\p{Ll}+)*)(?![\p{L}\p{M}\p{N}@_/])"), F.lit(1))
    cap = F.regexp_extract_all(F.col("text"), F.lit(r"(?:^|[.!?|\n]\s*)(\p{Lu}\p{Ll}+)(?= \p{Ll})"), F.lit(1))
    return texts.where("text is not null").select(F.explode(F.concat(low, cap)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n) of neighbouring lower-case words."""
    pairs = F.regexp_extract_all(F.col("text"), F.lit(r"(?<!\p{L})(?=(\p{Ll}{2,} \p{Ll}{2,})(?!\p{L}))"), F.lit(1))
    return texts.where("text is not null").select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


class Trie:
    def __init__(self, words: Iterator[str] | list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w


class Automaton:
    """Levenshtein automaton of a word; a state is the set of (position, edits), built as it is visited."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most
        self.steps: dict[tuple, dict[str, tuple]] = {}

    def start(self) -> tuple:
        return self._closed({(0, 0)})

    def _closed(self, states: set[tuple[int, int]]) -> tuple:
        best: dict[int, int] = {}
        for i, e in states:
            while i <= len(self.word) and e <= self.most:  # deletions of the word's letters
                if best.get(i, self.most + 1) > e:
                    best[i] = e
                i, e = i + 1, e + 1
        return tuple(sorted(best.items()))

    def step(self, state: tuple, c: str) -> tuple:
        known = self.steps.setdefault(state, {})
        key = c if c in self.word else ""
        if key not in known:
            out: set[tuple[int, int]] = set()
            for i, e in state:
                if i < len(self.word) and self.word[i] == c:
                    out.add((i + 1, e))
                if e < self.most:
                    out.add((i, e + 1))
                    out.add((i + 1, e + 1))
            known[key] = self._closed(out)
        return known[key]

    def edits(self, state: tuple) -> int | None:
        """Edits if the word may end here."""
        return next((e for i, e in state if i == len(self.word)), None)


def within(trie: Trie, word: str, most: int) -> list[tuple[str, int]]:
    """Every word of the trie within ``most`` edits, with its edits."""
    auto, found = Automaton(word, most), []
    stack = [(trie.root, auto.start())]
    while stack:
        node, state = stack.pop()
        for c, child in node.items():
            if c == "":
                e = auto.edits(state)
                if e is not None:
                    found.append((child, e))
            else:
                after = auto.step(state, c)
                if after:
                    stack.append((child, after))
    return found


class Vocabulary:
    def __init__(self, counts: dict[str, int], pairs: dict[str, int] | None = None):
        self.counts, self.pairs = dict(counts), pairs or {}
        self.trie, self.near = Trie(sorted(self.counts)), {}
        self.compounds = sorted(w for w in self.counts if "-" in w)
        self.parts = {p for w in self.compounds for p in w.split("-")}

    def misread(self, word: str) -> bool:
        """Whether a word of the vocabulary is a misreading of one ``RATIO`` times as frequent; never one that another was meant to be, so words are judged in any order."""
        return "-" not in word and self.fix(word, self.counts[word]) is not None

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """(word, cost) of vocabulary words that the word may be a misreading of."""
        if word not in self.near:
            out: dict[str, float] = {}
            for w, e in within(self.trie, word, 2 if len(word) >= 5 else 1):
                if w == word or "-" in w or w[0].isupper() != word[0].isupper() and not (word[0].isdigit() or word[0] in "@|I"):
                    continue
                cost = float(e)
                for seen, meant in LOOK_ALIKE:
                    at = word.find(seen)
                    while at >= 0:
                        if word[:at] + meant + word[at + len(seen) :] == w:
                            cost = 0.7
                        at = word.find(seen, at + 1)
                # an edit that is no look-alike needs a longer word
                if cost < 1 or cost == 1 and len(word) >= 5 or len(word) >= 8:
                    out[w] = cost
            if len(self.near) > 100_000:
                self.near.clear()
            self.near[word] = sorted(out.items())
        return self.near[word]

    def fix(self, word: str, own: int = 0, before: str = "", after: str = "") -> str | None:
        """The word meant, if this one is a misreading."""
        if own == 0 and word in self.counts or len(word) < 3:
            return None
        best = None
        for w, cost in self.candidates(word):
            n = self.counts.get(w, 0)
            if cost >= 1 and own and len(word) < 7:
                continue
            if n < max(own, 1) * RATIO * (4 if cost >= 1 and own or cost > 1 else 1) and not (own == 0 and n >= 10 and cost <= 1):
                continue
            context = self.pairs.get(f"{before} {w}", 0) + self.pairs.get(f"{w} {after}", 0)
            score = (-4.0 * cost + math.log(n) + 2.0 * math.log1p(context), w)
            if best is None or score > best:
                best = score
        return best[1] if best else None


_ROMAN = r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER = r"[\dlIOoSBZ|]{1,4}"
_EXPLICIT = regex.compile(rf"^(?:page|pg|p)\s*[.|:#-]?\s*{_NUMBER}(?:\s*(?:of|/)\s*{_NUMBER})?$|^\d{{1,4}}\s*/\s*\d{{1,4}}$|^\[\s*(?:{_NUMBER}|{_ROMAN})\s*\]$|^([-~–—*])\s*(?:{_NUMBER}|{_ROMAN})\s*\1$|^\(\s*\d{{1,4}}\s*\)$", regex.I)
_BARE = regex.compile(r"^\d{1,4}$")
_BARE_ROMAN = regex.compile(rf"^{_ROMAN}$")
_BARE_ALIKE, _DIGITS = regex.compile(r"^(?=.*\d|[lI|]$)[\dlIOoSBZ|]{1,4}$"), str.maketrans("lIOoSBZ|", "11005821")
_STROKES = str.maketrans("lI1|", "iiii")
_EDGE_NUMBER = regex.compile(rf"^(?:\[?(?:\d{{1,4}}|{_ROMAN})\]?|p(?:age|g|\.)\s*\d+)\s{{2,}}|\s{{2,}}(?:\[?(?:\d{{1,4}}|{_ROMAN})\]?|p(?:age|g|\.)\s*\d+)$", regex.I)
_TABLE_HEAD, _TABLE_END = regex.compile(r"^(?:qty|quantity|sl|s\.?\s?no|item|amount|rate)\b[.:]?$", regex.I), regex.compile(r"^(?:grand |sub)?total\b", regex.I)
_WORDISH = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def _key(line: str) -> str:
    s = _EDGE_NUMBER.sub("", line.strip(" \t\r\f​﻿"))
    return " ".join(s.casefold().split())


def _titled(line: str) -> bool:
    """A line set like a heading: no closing stop, mostly capitalised words or references."""
    s = line.strip()
    w = _WORDISH.findall(s)
    if len(w) < 2 or s[-1] in ".!?।;," or s[-1] in CUT_SIGNS:
        return False
    high = sum(x[0].isupper() or x[0].isdigit() for x in w)
    return high >= 0.6 * len(w)


def _roman(s: str) -> int:
    value, total = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}, 0
    for a, b in zip(s, s[1:] + " "):
        total += -value[a] if value.get(b, 0) > value[a] else value[a]
    return total


def _value(s: str) -> tuple[str, int, bool] | None:
    """(kind, number, whether look-alikes were read as digits) of a line that may be a bare page number."""
    if _BARE.match(s):
        return "digits", int(s), False
    for low in (s, s.lower()) if s.isupper() else (s,):
        if _BARE_ROMAN.match(low) and low != "l":
            return "roman", _roman(low), False
    if _BARE_ALIKE.match(s):
        return "digits", int(s.translate(_DIGITS)), True
    if _BARE_ROMAN.match(low := s.translate(_STROKES)):
        return "roman", _roman(low), True
    return None


def _breaks(lines: list[str], stripped: list[str], out: dict[int, str]) -> list[int]:
    """Lines at which pages begin: after form feeds, else where a group of running lines begins."""
    feeds = [i for i, s in enumerate(lines) if "\f" in s]
    if feeds:
        return feeds
    at, inside = [], False
    for i, s in enumerate(stripped):
        if i in out:
            if not inside:
                at.append(i)
            inside = True
        elif s and not _value(s):
            inside = False
    return at


def _series(at: list[tuple[int, int, bool, bool]], breaks: list[int]) -> set[int]:
    """Lines of the best rising series among (line, number, at a page edge, doubtful).

    Steps may pass over numbers that are missing.  A step suits the series if
    the lines between make as many pages as the number rises by: counted by
    ``breaks`` between page edges, else by the usual length of a page.  A step
    of one suits at any distance.  Doubtful numbers (in tables, or with
    look-alikes) are taken at page edges or at exactly the usual distance.  Work per number is bounded by the
    distinct values, of which there are at most some thousand.
    """
    if len(at) < 2:
        return set()
    gaps: Counter[int] = Counter(b - a for a, b in zip(breaks, breaks[1:]) if b - a > 2)
    last: dict[int, int] = {}
    for line, n, edge, doubtful in at:
        for step in (1, 2) if edge or not doubtful else ():
            d = line - last.get(n - step, line)
            if d % step == 0 and d // step > 2:
                gaps[d // step] += 1
        if edge or not doubtful:
            last[n] = line
    values = np.array(sorted({n for _, n, _, _ in at}))
    place = {int(v): k for k, v in enumerate(values)}
    best: tuple[float, list[int]] = (0.0, [])
    for usual, _ in sorted(gaps.items(), key=lambda x: (-x[1], x[0]))[:3] or [(0, 0)]:
        # best chain that ends in each value: its score, last line, last entry
        score, ends, entry = np.zeros(len(values)), np.zeros(len(values), np.int64), np.full(len(values), -1)
        edged, page = np.zeros(len(values), bool), np.zeros(len(values), np.int64)
        clear, before, total = np.zeros(len(values), bool), [-1] * len(at), [0.0] * len(at)
        for k, (line, n, edge, doubtful) in enumerate(at):
            v, now = place[n], bisect_right(breaks, line)
            own = 1.0 + 0.5 * edge
            total[k] = own
            if v:
                d, rise, pages = line - ends[:v], n - values[:v], now - page[:v]
                exact = (usual > 0) & (np.abs(d - rise * usual) <= 1)
                counted = edge & edged[:v] & (rise <= pages)
                plain = clear[:v] & (edge or not doubtful) & (d > 1)
                like = plain & (usual > 0) & (d >= 0.6 * rise * usual) & (d <= 1.6 * rise * usual)
                suits = (entry[:v] >= 0) & (exact | counted | plain & (rise == 1) | like)
                if suits.any():
                    gain = np.where(suits, score[:v] + 0.5 * exact + 0.5 * (counted & (rise == pages)) + 0.1 * (rise == 1), -1.0)
                    j = int(gain.argmax())
                    before[k], total[k] = int(entry[j]), float(gain[j]) + own
            if total[k] > score[v]:
                score[v], ends[v], entry[v], edged[v], page[v], clear[v] = total[k], line, k, edge, now, edge or not doubtful
        k = int(np.argmax(total))
        if before[k] >= 0 and total[k] > best[0]:
            chain, top = [], total[k]
            while k >= 0:
                chain.append(k)
                k = before[k]
            best = (top, chain[::-1])
    chain = [at[k] for k in best[1]]
    sure = len(chain) > 2 or sum(edge for _, _, edge, _ in chain) > 1 or any(b[1] - a[1] == 1 for a, b in zip(chain, chain[1:]))
    if sure and (len(chain) > 3 or not all(doubtful for _, _, _, doubtful in chain)):
        return {c[0] for c in chain}
    return set()


def _bare_numbers(lines: list[str], stripped: list[str], out: dict[int, str]) -> set[int]:
    """Lines that are a page number and nothing else, told from their series and their places on the pages."""
    inside, found = False, {"roman": [], "digits": []}
    full = [i for i, s in enumerate(stripped) if s]
    for k, i in enumerate(full):
        s = stripped[i]
        if _TABLE_HEAD.match(s):
            inside = True
        elif _TABLE_END.match(s):
            inside = False
        elif len(s) <= 12 and i not in out and (known := _value(s)):
            kind, n, alike = known
            follows, leads = full[k - 1] if k else -1, full[k + 1] if k + 1 < len(full) else -1
            end = follows < 0 or leads < 0
            edge = end or "\f" in lines[i] or "\f" in lines[leads] or out.get(follows) == "running" or out.get(leads) == "running"
            found[kind].append((i, n, edge, inside and kind == "digits" or alike, end and not inside and not alike))
    if not found["roman"] and not found["digits"]:
        return set()
    breaks = _breaks(lines, stripped, out)
    got = set()
    for kind in ("roman", "digits"):
        got |= _series([x[:4] for x in found[kind]], breaks)
    # a text of one page has its number first or last
    clear = [x for kind in found.values() for x in kind if not x[3]]
    return got or {x[0] for x in clear if x[4] and len(clear) == 1}


#: Running lines above or below one another on a page; pages that repeat more lines are copies of one another.
STACKED = 3


def _edge_lines(lines: list[str], stripped: list[str], out: dict[int, str]) -> set[int]:
    """Lines that repeat at the same edge of the pages, however they are written."""
    known = dict(out)
    full = [i for i, s in enumerate(stripped) if s]
    if not any("\f" in x for x in lines) and "page_number" not in out.values():
        return set()
    got: set[int] = set()
    for layer in range(STACKED + 1):
        tops, bottoms, pages = [], [], 1
        above, cut = None, True  # the last line of the body, whether a page ended since
        for i in full:
            if "\f" in lines[i] or known.get(i) == "page_number":
                cut = True
            if i in known:
                continue
            if cut:
                if above is not None:
                    bottoms.append(above)
                    pages += 1
                tops.append(i)
            above, cut = i, False
        if above is not None:
            bottoms.append(above)
        if not tops:  # nothing but repeated lines: copies of one page
            return set()
        new: set[int] = set()
        for side in (tops, bottoms):
            keys: dict[str, list[int]] = {}
            for i in side:
                k = _key(stripped[i])
                if len(k) >= 5 and any(c.isalpha() for c in k) and not _TABLE_HEAD.match(stripped[i]) and not _TABLE_END.match(stripped[i]):
                    keys.setdefault(k, []).append(i)
            # two alike lines may be chance, and odd and even pages may differ
            base = [k for k, at in keys.items() if len(at) >= 2 and len(at) >= (0.6 if len(at) == 2 else 0.4) * pages]
            trie = Trie(k for k in base if len(k) >= 8)
            for k, at in keys.items():
                if k in base or len(k) >= 8 and trie.root and _may_match(k, base, most := max(1, min(3, len(k) // 8))) and within(trie, k, most):
                    new.update(at)
        if not new:
            return got
        if layer == STACKED:
            return set()
        got |= new
        known |= dict.fromkeys(new, "running")
    return got


def _may_match(line: str, others: Iterable[str], most: int) -> bool:
    """Whether another line can lie within ``most`` edits: of one more pieces than edits, one must stand in it unchanged."""
    n = len(line)
    pieces = [line[i * n // (most + 1) : (i + 1) * n // (most + 1)] for i in range(most + 1)]
    return any(abs(len(o) - n) <= most and o != line and any(p in o for p in pieces) for o in others)


def furniture(lines: list[str]) -> dict[int, str]:
    """'running' or 'page_number' by line."""
    out: dict[int, str] = {}
    stripped = [x.strip(" \t\r\f​﻿") for x in lines]
    numbers = [i for i, s in enumerate(stripped) if s and len(s) <= 16 and _EXPLICIT.match(s)]
    for i in numbers:
        out[i] = "page_number"
    keys: dict[str, list[int]] = {}
    if len(lines) < 4:
        return out
    for i, s in enumerate(stripped):
        if s and i not in out and _titled(s) and not _TABLE_END.match(s):
            keys.setdefault(_key(s), []).append(i)
    base = {k for k, at in keys.items() if len(at) >= 2 and len(k) >= 5}
    trie = Trie(k for k in keys if len(k) >= 8) if len(keys) > 1 else None
    for k, at in keys.items():
        # a running line may be misread on some pages
        if k in base or trie and len(k) >= 8 and _may_match(k, keys, most := max(1, min(3, len(k) // 8))) and any(w != k for w, _ in within(trie, k, most)):
            for i in at:
                out[i] = "running"
    if not numbers:
        for i in _bare_numbers(lines, stripped, out):
            out[i] = "page_number"
    for i in _edge_lines(lines, stripped, out):
        out[i] = "running"
    return out


_SUSPECT = regex.compile(r"[\p{L}\p{M}@|\p{N}]+(?:'\p{L}+)?")
_BLANK = re.compile(r"\S+")
_PLAIN_SIGN = re.compile(r"[^\W\d_]*@[^\W\d_]*[.,;]?")
_CODE = re.compile(r"[A-Z]{2,}[-/]?\d+(?:[-/]\d+)*")
#: Of a word cut at the end of a line so many letters are read.
LONGEST_WORD = 60


@lru_cache(maxsize=200_000)
def _parts_of(p: str) -> tuple[tuple[int, int, str], ...]:
    """(start, end, word) of the words in a run without blanks."""
    if "://" in p or p.count("/") > 1 or "@" in p and not _PLAIN_SIGN.fullmatch(p):
        return ()
    if _CODE.search(p):
        p = _CODE.sub(lambda m: " " * len(m.group()), p)
    out = []
    for m in _SUSPECT.finditer(p):
        w = m.group()
        letters = sum(map(str.isalpha, w))
        if letters >= 2 and letters >= 0.6 * len(w) and not w.isupper() and "'" not in w:
            out.append((m.start(), m.end(), w))
    return tuple(out)


def _tokens(line: str) -> list[tuple[int, int, str]]:
    """(start, end, word) of the words of a line that may be ordinary words; addresses, handles, paths and codes are none."""
    out = []
    for part in _BLANK.finditer(line):
        at = part.start()
        for a, b, w in _parts_of(part.group()):
            out.append((at + a, at + b, w))
    return out


def _suspect(line: str, start: int, w: str) -> bool:
    """Words that may be ordinary: in lower case, or capitalised at the start of a sentence."""
    if any(c.isupper() for c in w[1:]):
        return w[1:].replace("I", "").islower() and w[0].islower()
    if w[0].isupper():
        lead = line[:start].rstrip(" \t\f\"'(")
        follow = line[start + len(w) : start + len(w) + 2]
        return (not lead or lead[-1] in ".!?|") and (len(follow) < 2 or follow[0] == " " and follow[1].islower())
    if w[0].isalpha() and start and line[start - 1] in "-+_.@/" or start + len(w) < len(line) and line[start + len(w)] in "@_/+":
        return False
    return True


_RUN_TOGETHER = re.compile(r"[a-z][-‐‑¬\u00ad~] [a-z]")
_RUN_END, _RUN_START = regex.compile(r"[\p{L}\p{M}\p{N}@|]+$"), regex.compile(r"[\p{L}\p{M}\p{N}@|]+")


class Reader:
    """Finds and repairs the defects of one text at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.plain: dict[str, bool] = {}

    def _ordinary(self, line: str) -> bool:
        """Whether no word of the line can be a misreading, told from each word alone."""
        opening, plain = True, self.plain
        if _RUN_TOGETHER.search(line):
            return False
        for t in line.split():
            ok = plain.get(t)
            if ok is None:
                ok = all(w in self.v.counts or w.lower() in self.v.counts or (w[0].isupper() and w[1:].islower()) for _, _, w in _tokens(t))
                ok = plain[t] = ok
                if len(plain) > 200_000:
                    plain.clear()
            if not ok or opening and t[0].isupper() and t not in self.v.counts:
                return False
            opening = t[-1] in ".!?|"
        return True

    def _joined(self, a: str, b: str, sign: str) -> bool:
        """Whether the sign after ``a`` cut a word that ``b`` continues."""
        if sign not in "-‐‑":
            return True
        count = self.v.counts.get
        whole, compound = count((a + b).lower(), 0) or count(a + b, 0), count(f"{a}-{b}".lower(), 0)
        if whole or compound:
            return whole >= compound
        if self.v.fix(a + b) is not None:
            return True
        return not (count(a.lower(), 0) and count(b.lower(), 0))

    def defects(self, text: str) -> tuple[list[tuple[int, str]], dict[int, str], dict[int, list[tuple[int, int, str]]], dict[int, int]]:
        """(found, furniture, repairs by line, continuation line of cut lines)."""
        lines = text.split("\n")
        out = furniture(lines)
        found = [(i, d) for i, d in sorted(out.items())]
        body = [i for i, s in enumerate(lines) if i not in out and s.strip()]
        cut: dict[int, int] = {}
        skip: dict[int, int] = {}
        repairs: dict[int, list[tuple[int, int, str]]] = {}
        bad: set[int] = set()
        for n, i in enumerate(body):
            s = lines[i].rstrip(" \t\r\f")
            if len(s) < 2 or s[-1] not in CUT_SIGNS or not (s[-2].isalnum() or s[-2] == "@"):
                continue
            head = _RUN_END.search(s[-LONGEST_WORD:-1])
            offset = max(0, len(s) - LONGEST_WORD)
            if not head:
                continue
            for ahead, j in enumerate(body[n + 1 : n + 4]):
                t = lines[j].lstrip(" \t\f")
                tail = _RUN_START.match(t)
                open_ = tail and (tail.group()[0].islower() or tail.group()[0] in "@|013456789" and len(tail.group()) > 1 and tail.group()[1:].islower())
                # a line between that repetition did not reveal is passed if the word is known
                if open_ and (not ahead or (head.group() + tail.group()).lower() in self.v.counts):
                    break
            else:
                continue
            a, b = head.group(), tail.group()
            if not any(c.isalpha() for c in a) or (a.isupper() and len(a) > 1):
                continue
            begin = offset + head.start()
            before = s[:begin]
            if self._joined(a, b, s[-1]):
                found.append((i, "hyphen"))
                cut[i] = j
                whole = a + b
                fixed = self.v.fix(whole) if _suspect(before, len(before), whole) or whole[0].islower() else None
                if fixed:
                    first = fixed[: len(a)] != a
                    if first:
                        bad.add(i)
                    if not fixed.endswith(b):
                        bad.add(j)
                    repairs.setdefault(i, []).append((begin, len(s), fixed))
                else:
                    repairs.setdefault(i, []).append((begin, len(s), whole))
                skip[j] = len(lines[j]) - len(t) + len(b)
        for i in body:
            if self._ordinary(lines[i]):
                continue
            line, toks = lines[i], _tokens(lines[i])
            joined: set[int] = set()
            for n, (a, b, w) in enumerate(toks):
                if n in joined or b <= skip.get(i, 0) or i in cut and b >= len(line.rstrip(" \t\r\f")) - 1:
                    continue
                if n + 1 < len(toks) and line[b : b + 1] in CUT_SIGNS and line[b + 1 : toks[n + 1][0]] == " " and toks[n + 1][2].islower():
                    # a word cut where lines were run together: judged as a whole
                    whole = w + toks[n + 1][2]
                    if w.lower() not in self.v.parts or whole.lower() in self.v.counts:
                        joined.add(n + 1)
                        fixed = None if whole.lower() in self.v.counts else self.v.fix(whole)
                        if fixed:
                            bad.add(i)
                        repairs.setdefault(i, []).append((a, toks[n + 1][1], fixed or whole))
                        continue
                if w in self.v.counts or w.lower() in self.v.counts or not _suspect(line, a, w):
                    continue
                if (a and line[a - 1] == "-" or b < len(line) and line[b] in CUT_SIGNS) and w.lower() in self.v.parts:  # part of a compound
                    continue
                fixed = self.v.fix(w, 0, toks[n - 1][2].lower() if n else "", toks[n + 1][2].lower() if n + 1 < len(toks) else "")
                if fixed:
                    bad.add(i)
                    repairs.setdefault(i, []).append((a, b, fixed))
        found += [(i, "chars") for i in bad]
        return sorted(set(found)), out, repairs, cut

    def repaired(self, text: str) -> str:
        """The text without page furniture, cut words joined, misread words replaced, lines reflowed to paragraphs."""
        lines = text.split("\n")
        _, out, repairs, cut = self.defects(text)
        paragraphs: list[str] = [""]
        taken: dict[int, int] = {}
        for i, j in cut.items():
            t = lines[j].lstrip(" \t\f")
            m = _RUN_START.match(t)
            taken[j] = len(lines[j]) - len(t) + (m.end() if m else 0)
        width = max((len(x.rstrip()) for k, x in enumerate(lines) if k not in out), default=0)
        for i, line in enumerate(lines):
            if i in out:
                continue
            if not line.strip():
                # a blank line ends a paragraph, but a page break inside a sentence leaves blanks too
                if paragraphs[-1].rstrip()[-1:] in ".!?।:|" or not paragraphs[-1]:
                    paragraphs.append("")
                continue
            s = line
            for a, b, w in sorted(repairs.get(i, []), reverse=True):
                s = s[:a] + w + s[b:]
            s = s[taken.get(i, 0) :].strip() if i in taken else s.strip()
            if s:
                paragraphs[-1] = f"{paragraphs[-1]} {s}".strip()
            if len(line.rstrip()) < 0.6 * width and line.rstrip()[-1:] not in CUT_SIGNS and (line.rstrip()[-1:] in ".!?।" or _titled(line)):
                paragraphs.append("")
        return "\n\n".join(p for p in paragraphs if p)


#: Words the vocabulary may hold at most, as it is sent to every task; 1 / LEAST_SHARE is never exceeded.
MOST_WORDS = 1_000_000


def vocabulary_of(texts: DataFrame) -> Vocabulary:
    """Vocabulary of all texts (column ``text``); its size is bounded by the least relative frequency and checked."""
    scratch = Scratch(texts.sparkSession)
    counts = scratch.put(word_counts(texts))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, math.ceil(total * LEAST_SHARE))
    common = counts.where(F.col("n") >= least).select("word", "n")
    if common.count() > MOST_WORDS:
        raise ValueError("the vocabulary is too large to be sent to every task")
    found = common.toArrow()
    words = dict(zip(found["word"].to_pylist(), found["n"].to_pylist()))
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = None
        for b in batches:
            v = v or Vocabulary(shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([w for w in b.column(0).to_pylist() if v.misread(w)], pa.string())], ["word"])

    misread = common.select("word").repartition(1 + len(words) // 1000).mapInArrow(check, "word string").toArrow()
    for w in misread["word"].to_pylist():
        del words[w]
    scratch.drop(counts)
    # no more than 1 / (2 LEAST_SHARE) pairs are as frequent as this
    pairs = pair_counts(texts).where(F.col("n") >= max(LEAST_COUNT, 2 * least)).select("pair", "n").toArrow()
    return Vocabulary(words, dict(zip(pairs["pair"].to_pylist(), pairs["n"].to_pylist())))


def _apply(images: DataFrame, vocabulary: Vocabulary, schema: str, rows_of) -> DataFrame:  # noqa: ANN001
    shared = images.sparkSession.sparkContext.broadcast((vocabulary.counts, vocabulary.pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for b in batches:
            if reader is None:
                reader = Reader(Vocabulary(*shared.value))
            rows = [r for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for r in rows_of(reader, i, t)]
            if rows:
                names = [x.split()[0] for x in schema.split(", ")]
                kinds = [pa.int64() if x.endswith("long") else pa.string() for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return images.select("id", scan_text().alias("text")).where("id is not null and text is not null").mapInArrow(run, schema)


def scan_defects(images: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(image_id, line_no, defect) of every scan text; null and blank texts give no rows."""
    v = vocabulary or vocabulary_of(images.select(scan_text().alias("text")))
    return _apply(images, v, "image_id long, line_no long, defect string", lambda reader, i, t: [(i, n, d) for n, d in reader.defects(t)[0]])


def repaired_texts(images: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(image_id, text): the scan text as continuous paragraphs, separated by blank lines."""
    v = vocabulary or vocabulary_of(images.select(scan_text().alias("text")))
    return _apply(images, v, "image_id long, text string", lambda reader, i, t: [(i, reader.repaired(t))])
