"""Personal information inside free text (problem 2).

Information-theoretic sanitisation.  The corpus itself tells how strongly a
term reveals a protected entity: over all texts the terms next to candidates
(capitalised runs, digit groups) are counted together with how often the
candidate is protected beyond doubt - a run with a part of the name register,
a number in a form that only its kind has.  The share of such candidates
beside a term is its disclosure.  A doubtful candidate (an unknown name, a bare
number) is taken where the terms around it disclose at least ``DISCLOSURE``;
a term that mostly stands beside organisations or references discloses
nothing.  A name needs a disclosing term beside it even if its parts are in
the register: a registered name among terms that are rare or precede other
things is left in the text.  Found values are generalised to typed placeholders.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from paperloom.plans.scratch import Scratch

DISCLOSURE = 0.15
#: Least relative frequency of a term that is kept; bounds the table of terms.
LEAST_SHARE = 1e-5
KINDS = ("name", "email", "phone", "identity", "address")

# Words of organisations and places; a run with one of them is no person.
ORGANISATION = frozenset("university college school polytechnic institute academy hospital clinic pharmacy laboratory bank stationers traders electricals motors logistics board house company limited ltd pvt enterprises stores store agency trust society association corporation cooperative public power supply tea department ministry office branch depot industries brothers services travels hotel mart bazaar".split())
PLACE = frozenset("road street lane marg avenue heights ward sector nagar circular court square colony".split())
# Titles before a name, which are no part of it.
TITLES = frozenset("dear mr mrs ms dr shri smt sri kum prof miss herr frau sr sra señor señora monsieur madame mme श्री श्रीमती".split())
# Labels of fields that hold a person's name, the floor where the corpus is small.
NAME_CUES = ("name:", "name :", "applicant:", "patient:", "dear", "mr.", "mrs.", "ms.", "dr.", "shri", "smt.", "s/o", "d/o", "w/o", "c/o", "nombre:", "nom :", "नाम:", "नाव:", "nominee -", "nominee:", "holder:", "student:", "countersigned by")
# Forms of capital words in front of a number.
_D = r"[0-9०-९]"
_L = r"[0-9०-९OoIlS|B]"
_IDENTITY_LABEL = r"(?:aadhaar|aadhar|uid(?:ai)?|pan\b|permanent\s+account|passport|voter|epic|पहचान|ओळख|identity|kyc)"
_CANON = str.maketrans({"0": "o", "1": "i", "l": "i", "|": "i", "5": "s", "8": "b", "9": "g", "@": "a", "c": "e", "f": "t", "h": "b"})


@lru_cache(200_000)
def canonical(term: str) -> str:
    """A term with look-alike letters made equal and digits masked, so that a misread label still counts."""
    t = term.casefold()
    if any(c.isalpha() for c in t):
        return t.replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("ii", "u").translate(_CANON)
    return regex.sub(r"\p{N}+", "0", t)


_SIGN = re.compile(r"@|\(at\)|\[at\]|\{at\}|<at>|\bat\s+[\w-]+\s+dot\s", re.I)
_LOCAL = re.compile(r"(?:(?<![^\W_])[\w.+-]*[-‐‑¬­~.+][ \t]*\n\s*)?[\w][\w.+-]*\s*$")
_DOMAIN = re.compile(r"(?:@|\(at\)|\[at\]|\{at\}|<at>)\s*[\w-]+(?:(?:[.,]|\s*(?:\(dot\)|\[dot\]|\{dot\})\s*)[^\W_]{2,})+|at\s+[\w-]+(?:\s+dot\s+[^\W\d_]{2,})+", re.I)


def emails(text: str) -> list[tuple[int, int]]:
    """(start, end) of mail addresses, their spellings with words for the signs and cuts at line ends included."""
    out = []
    for m in _SIGN.finditer(text):
        domain = _DOMAIN.match(text, m.start())
        if domain:
            lead = max(0, m.start() - 80, out[-1][1] if out else 0)
            local = _LOCAL.search(text[lead : m.start()])
            if local and local.group().strip():
                start = lead + local.start() + len(local.group()) - len(local.group().lstrip())
                out.append((start, domain.end()))
    return out


_ADDRESS_SIGN = re.compile(r"\d\w?\s*[,/]|\d\s+[A-Z][\w@]+\s+[SLRMA]|[Rr]ue\s|Calle|Avenida|Plaza|N[o0]\.?\s")
_ADDRESS = re.compile(
    r"(?<![^\W_])(?:F[l1I|][a@]t\s+(?:No\.?\s*)?[\dlOISBo]{1,4}\s?-?[A-Za-z]?\s*,|H\.?\s?N[o0]\.?\s*[\dlOISBo]{1,4}\s?/\s?[\dlOISBo]{1,4}\s*,|House\s+N[o0]\.?\s*[\dlOISBo]{1,4}[/\-\w]*\s*,|P[l1I|][o0]t\s+N[o0]\.?\s*[\dlOISBo]{1,4}\s*,|[Dd]oor\s+No\.?\s*\d+"
    r"|[\dlOISBo]{1,4}\s+[A-Z][\w@]+\s+(?:Street|Lane|Road|Marg|Avenue|Stree[tf]|L[a@]n[ec]|R[o0][a@]d|M[a@]rg|Av[ec]nu[ec])\s*,\s*[A-Z]|[A-Z][\w@]+(?:g[a@][s5][s5][ec]|stra(?:ss|ß)e|weg|platz|allee)\s+[\dlOISBo]{1,4}\s*,\s*[\dlOISBo]{4,5}\s+[A-Z]"
    r"|\d{1,4}\s*,?\s+[Rr]ue\s+[A-Z]|(?:Calle|Avenida|Plaza)\s+[A-Z]\w+\s*,?\s*\d)"
)
# a text without such a group of digits has neither numbers of persons nor of telephones
_NUMBER = re.compile(r"[A-Za-z0158]{3}[\dOlIS]{4}|[\d][\dOoIlS|B]{3}[\s.\-]?[\dOoIlS|B]{3}|[\dOoIlS|B]{3}[)\s\-]{1,2}[\dOoIlS|B]{3,4}[\s\-][\dOoIlS|B]{4}")
# strong forms: only the kind has them; weak ones need a disclosing term
_PHONE_STRONG = re.compile(
    rf"(?<![\w/.,+\-])(?:\(?\+{_L}{{1,3}}\)?[\s.\-]{{0,2}}(?:{_L}[\s.\-]?){{7,12}}{_L}|\({_L}{{3,5}}\)\s?{_L}{{3,4}}[-\s]?{_L}{{4}}|{_L}{{5}}[\s\-]{_L}{{5,6}}|{_L}{{5}}-{_L}{{3}}-{_L}{{3}}|{_L}{{3}}-{_L}{{3}}-{_L}{{4}}|{_L}{{3,4}}-{_L}{{4}}\s{_L}{{4}})(?!\w|[/\-]\d|[.,]\d)"
)
_PHONE_WEAK = re.compile(rf"(?<![\w/.,+@\-])(?:{_L}{{10,11}})(?![\w@]|[/\-]\d|[.,]\d)")
_ID_STRONG = re.compile(rf"(?<![\w/+\-])(?:{_L}{{4}}([\s\-]){_L}{{4}}\1{_L}{{4}}|[A-Z]{{5}}{_D}{{4}}[A-Z]|[A-Z]{{3}}{_D}{{7}})(?!\w|[/\-]\d)")
_ID_WEAK = re.compile(rf"(?<![\w/+\-@.])(?:{_L}{{12}}|[A-Za-z]\s?{_L}{{7}}|[A-Za-z0158]{{5}}{_L}{{4}}[A-Za-z0158]|[A-Z0158]{{3}}{_L}{{7}}|[a-z]{{3}}{_D}{{7}})(?![\w@]|[/\-]\d|[.,]\d)")
# Words of labels that end a run of capital words.
LABELS = frozenset("pan uid uidai aadhaar aadhar passport voter epic permanent kyc age email e-mail phone mob tel telephone call contact address resident nominee patient".split())
_WORD = r"(?:[A-Z]\.(?=\s)|[^\W\d_a-zà-ÿ][\w@|]*(?:-\w[\w@|]*)*)"
_RUN = re.compile(rf"(?<![^\s\"'(<\[{{]){_WORD}(?![^\s.,;:)>\]}}|\"'!?])(?:,?\s+{_WORD}(?![^\s.,;:)>\]}}|\"'!?])){{0,6}}")
_PART = re.compile(_WORD)


@lru_cache(100_000)
def _kind(word: str) -> bool:
    """Whether a word, perhaps misread, belongs to organisations or places."""
    w = word.casefold().rstrip(".")
    return w in ORGANISATION or w in PLACE or len(w) >= 6 and any(len(w) == len(o) and sum(a != b for a, b in zip(w, o)) <= (2 if len(w) >= 9 else 1) for o in ORGANISATION if o[0] == w[0] or o[-1] == w[-1])


@lru_cache(100_000)
def _namelike(word: str) -> bool:
    """Whether a capital word can be a part of a name."""
    if len(word) == 2 and word[1] == ".":
        return True
    return sum(map(str.isalpha, word)) >= 3 and sum(map(str.isdigit, word)) < 3 and word.casefold() not in LABELS and word.casefold().rstrip(".") not in TITLES and not ("_" in word)


class Run:
    """Capital words in a row: (start, word) pairs, cues to the left and right, whether an organisation or place word is near."""

    __slots__ = ("words", "one", "two", "right", "org", "org_at")

    def __init__(self, text: str, words: list[tuple[int, str]]):
        self.words = words
        first, (last, word) = words[0][0], words[-1]
        lead = text[max(0, first - 44) : first].rstrip("\"'(<[{").rsplit(None, 2)[-2:]
        # the end of a sentence, a bar or a number introduces nobody
        if lead and (lead[-1] == "|" or lead[-1][-1] in ".!?।,;" and len(lead[-1]) > 4 or any(map(str.isdigit, lead[-1]))):
            lead = []
        self.one = canonical(lead[-1]) if lead else ""
        self.two = canonical(f"{lead[-2]} {lead[-1]}") if len(lead) > 1 else ""
        end = last + len(word)
        rest = text[end : end + 60]
        close = rest[:1] if rest[:1] in (".", ",", ";", ":", ")") else ""
        follow = rest.split(None, 3)
        if close and follow:
            follow = follow[1:]
        nxt = follow[0] if follow else ""
        self.right = f"{close} (email" if nxt.startswith("(") and _SIGN.search(rest) else f"{close} {canonical(nxt)}"
        self.org_at = -1
        for k, (_, w) in enumerate(words):
            if _kind(w):
                self.org_at = k
                break
        if self.org_at < 0 and not close:
            near = next((k for k, w in enumerate(follow[:2]) if _kind(w.rstrip(_END))), -1)
            if near >= 0 and (near == 0 or follow[0][:1].isupper() or not follow[0][:1].isalpha()):
                self.org_at = len(words) + near
        self.org = self.org_at >= 0


def runs(text: str) -> list[Run]:
    out = []
    for m in _RUN.finditer(text):
        base, part = m.start(), []
        for w in _PART.finditer(text, base, m.end()):
            word = w.group()
            if _namelike(word):
                part.append((w.start(), word))
            elif part:
                out.append(Run(text, part))
                part = []
        if part:
            out.append(Run(text, part))
    return out


_END = ".,;:)>]}|\"'!?"


#: Codes of letters and digits: tax and voter numbers.
_CODE = re.compile(r"[A-Za-z0158]{5}[\dOlISB]{4}[A-Za-z0158]|[A-Z0158]{3}[\dOlISB]{7}|[a-z]{3}\d{7}")


def _digits(s: str) -> bool:
    """Whether look-alike letters are few among the digits of a number."""
    n = sum(c.isdigit() for c in s)
    return n >= 6 and sum(c.isalpha() or c == "|" for c in s) <= 2 or _CODE.fullmatch(s) is not None


class Terms:
    """Disclosure of terms and the common capital words, as counted over the corpus."""

    def __init__(self, rows: list[tuple[str, str, int, int]], register: set[str]):
        self.register = register
        self.rate: dict[tuple[str, str], tuple[int, int]] = {(side, term): (sure, n) for side, term, sure, n in rows}
        self.floor = {canonical(c) for c in NAME_CUES}

    def disclosure(self, side: str, term: str) -> float | None:
        """Share of sure candidates beside the term; None if it was not seen often enough."""
        got = self.rate.get((side, term))
        return got[0] / got[1] if got and got[1] >= 6 else None


def _sure_name(run: Run, register: set[str]) -> bool:
    return not run.org and any(p in register for _, w in run.words[:4] for p in w.casefold().split("-"))


def _before(text: str, start: int) -> str:
    """The last word before an offset, as a term."""
    lead = text[max(0, start - 40) : start].split()
    return canonical(lead[-1]) if lead else ""


def observe(text: str, register: set[str]) -> dict[tuple[str, str], list[int]]:
    """(side, term) -> [sure, all] of one text."""
    out: dict[tuple[str, str], list[int]] = {}

    def add(side: str, term: str, sure: bool) -> None:
        n = out.setdefault((side, term), [0, 0])
        n[0] += sure
        n[1] += 1

    for run in runs(text):
        sure = _sure_name(run, register)
        if run.one:
            add("left1", run.one, sure)
        if run.two:
            add("left2", run.two, sure)
        if run.right[:1] == ",":
            add("right", run.right, sure)
        for _, w in run.words:
            add("word", w.casefold(), sure)
    for side, strong, weak in (("phone", _PHONE_STRONG, _PHONE_WEAK), ("identity", _ID_STRONG, _ID_WEAK)) if _NUMBER.search(text) else ():
        for m in strong.finditer(text):
            if _digits(m.group()):
                add(side, _before(text, m.start()), True)
        for m in weak.finditer(text):
            if _digits(m.group()) and not strong.match(text, m.start()):
                add(side, _before(text, m.start()), False)
    return out


_POSTCODE = re.compile(r"[^.;|]*?(?:\d{6}|\d{3}\s\d{3}|[A-Z]{1,2}\d\w?\s?\d[A-Z]{2}|\d{5}\s+[A-Z]\w+)")


def spans(text: str, terms: Terms) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the protected values of a text, in order, without overlaps."""
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def take(a: int, b: int, kind: str) -> None:
        k = bisect(taken, (a, b))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
            found.append((a, b, kind))
            taken.insert(k, (a, b))

    for a, b in emails(text):
        take(a, b, "email")
    for m in _ADDRESS.finditer(text) if _ADDRESS_SIGN.search(text) else ():
        end = _POSTCODE.match(text, m.end())
        take(m.start(), max(m.end(), end.end() if end and end.end() - m.start() < 120 else 0), "address")
    ids: set[int] = set()
    numbers = _NUMBER.search(text) is not None
    for pattern, sure in ((_ID_STRONG, True), (_ID_WEAK, False)) if numbers else ():
        for m in pattern.finditer(text):
            s = m.group()
            if not _digits(s):
                continue
            term = _before(text, m.start())
            rate = terms.disclosure("identity", term)
            labelled = regex.search(_IDENTITY_LABEL, canonical_label(text[max(0, m.start() - 34) : m.start()]), regex.I) is not None
            if labelled or rate is not None and rate >= DISCLOSURE and not s[0].islower():
                take(m.start(), m.end(), "identity")
                ids.add(m.end())
            elif sure and rate is None and not labelled and not regex.search(r"(?:account|receipt|roll|transaction|utr|lot|meter|reading|reference|batch)\W*(?:no\.?|number)?\W*$", text[max(0, m.start() - 30) : m.start()], regex.I):
                take(m.start(), m.end(), "identity")
                ids.add(m.end())
    for pattern, sure in ((_PHONE_STRONG, True), (_PHONE_WEAK, False)) if numbers else ():
        for m in pattern.finditer(text):
            s = m.group()
            if not _digits(s) or not 9 <= sum(c.isalnum() or c == "|" for c in s) <= 14:
                continue
            rate = terms.disclosure("phone", _before(text, m.start()))
            after_id = any(e in ids and text[e : m.start()].strip() in (",", "") for e in range(m.start() - 4, m.start() + 1))
            if after_id or (sure and (rate is None or rate >= DISCLOSURE)) or not sure and rate is not None and rate >= DISCLOSURE:
                take(m.start(), m.end(), "phone")
    for run in runs(text):
        left = terms.disclosure("left2", run.two) if run.two else None
        if left is None and run.one:
            left = terms.disclosure("left1", run.one)
        if run.one in terms.floor or run.two in terms.floor:
            left = max(left or 0.0, 0.5)
        # an organisation or place word right after one or two words makes the run no person
        by_left = left is not None and left >= DISCLOSURE and (not run.org or run.org_at >= 3)
        beside = terms.disclosure("right", run.right)
        inside = run.org and run.org_at < len(run.words) and run.right.endswith("(email") | run.right.startswith(",") and not _kind(run.words[-1][1])
        by_right = (not run.org or inside) and (run.right.endswith("(email") or beside is not None and beside >= 2 * DISCLOSURE and run.right.startswith(","))
        if not by_left and not by_right:
            continue
        words = run.words[: run.org_at] if run.org and by_left else run.words
        i, j = 0, len(words) - 1
        if not by_left:
            # the run may begin with words of what stands before: common capital words are no names
            i = max((k + 1 for k, (_, w) in enumerate(words[:-1]) if _kind(w)), default=0)
            while i < j and (_common(words[i][1], terms) or j - i >= 3):
                i += 1
            if _common(words[i][1], terms) or _kind(words[i][1]):
                continue
        end = i + 1 if len(words[i][1]) == 2 and i < j else i  # an initial needs the word after it
        while end < min(j, i + 3) and not _common(words[end + 1][1], terms):
            end += 1
        if len(words[i][1]) == 2 and end == i:
            continue
        take(words[i][0], words[end][0] + len(words[end][1]), "name")
    return sorted(found)


def canonical_label(s: str) -> str:
    """Text before a number with look-alikes of letters undone, for label search."""
    return regex.sub(r"(?<=\p{L})[01](?=\p{L})", lambda m: {"0": "o", "1": "i"}[m.group()], s)


def _common(word: str, terms: Terms) -> bool:
    """Capital words that are frequent in the corpus and hardly ever a sure name."""
    w = word.casefold()
    if w in terms.register:
        return False
    got = terms.rate.get(("word", w))
    return bool(got and got[1] >= 12 and got[0] / got[1] < 0.1 and w[-1] != ".")


def texts_of(images: DataFrame, metadata: DataFrame) -> DataFrame:
    """(src, row_key, text) of both tables, null texts left out."""
    a = images.select(F.lit("images").alias("src"), F.col("id").cast("string").alias("row_key"), F.col("extracted_text").alias("text"))
    b = metadata.select(F.lit("metadata").alias("src"), F.col("image_id").cast("string").alias("row_key"), F.col("expected_text").alias("text"))
    return a.unionByName(b).where("text is not null and row_key is not null")


def counted_terms(texts: DataFrame, register: set[str]) -> Terms:
    """Co-occurrence counts of all texts; kept are terms of the least relative frequency, so their number is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, str], list[int]] = {}
            for text in b.column(0).to_pylist():
                for key, (s, n) in observe(text, register).items():
                    total = sums.setdefault(key, [0, 0])
                    total[0] += s
                    total[1] += n
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums]), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], ["side", "term", "sure", "n"])

    scratch = Scratch(texts.sparkSession)
    counts = texts.select("text").mapInArrow(run, "side string, term string, sure long, n long").groupBy("side", "term").agg(F.sum("sure").alias("sure"), F.sum("n").alias("n"))
    counts = scratch.put(counts)  # read twice below
    totals = counts.groupBy("side").agg(F.sum("n").alias("total"))
    kept = counts.where("n >= 3").join(F.broadcast(totals), "side").where(F.col("n") >= F.col("total") * LEAST_SHARE)  # five sides
    rows = kept.select("side", "term", "sure", "n").toArrow().to_pydict()
    scratch.drop(counts)
    return Terms([*zip(rows["side"], rows["term"], rows["sure"], rows["n"])], register)


def register_of(name_parts: DataFrame) -> set[str]:
    """Parts of the name register in lower case; a reference table of fixed size."""
    return {r[0] for r in name_parts.select(F.lower(F.trim("name_part"))).where("name_part is not null").distinct().collect() if r[0]}


def _mapped(texts: DataFrame, terms: Terms, schema: str, rows_of) -> DataFrame:  # noqa: ANN001
    shared = texts.sparkSession.sparkContext.broadcast((terms.rate, terms.register))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate, register = shared.value
        own = Terms([], register)
        own.rate = rate
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64() if x.endswith("long") else pa.string() for x in schema.split(", ")]
        for b in batches:
            rows = [r for src, key, text in zip(*(c.to_pylist() for c in b.columns)) for r in rows_of(src, key, text, own)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return texts.mapInArrow(run, schema)


def protected_values(images: DataFrame, metadata: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(src, row_key, kind, start_pos): every occurrence; equal rows of a key count once."""
    texts = texts_of(images, metadata)
    terms = counted_terms(texts, register_of(name_parts))
    return _mapped(texts, terms, "src string, row_key string, kind string, start_pos long", lambda src, key, text, own: [(src, key, kind, a) for a, _, kind in spans(text, own)]).distinct()


def sanitised(images: DataFrame, metadata: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(src, row_key, text) with every protected value generalised to a typed placeholder."""

    def clean(src: str, key: str, text: str, own: Terms) -> list[tuple[str, str, str]]:
        out, last = [], 0
        for a, b, kind in spans(text, own):
            out += [text[last:a], f"[{kind.upper()}]"]
            last = b
        return [(src, key, "".join(out) + text[last:])]

    texts = texts_of(images, metadata)
    return _mapped(texts, counted_terms(texts, register_of(name_parts)), "src string, row_key string, text string", clean)
