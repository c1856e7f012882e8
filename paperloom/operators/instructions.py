"""Search by an instruction in plain words: read at plan time into constraints, which become Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions.text import STOPWORDS, all_of

# Words of commands, cities, categories with their words, colours, synonyms of excluded things, patterns of exclusion, objects, words that are never searched for.
COMMAND_WORDS = frozenset("find show search get fetch retrieve list display me all the photos images pictures documents files of with from in at for please can you which having contains containing where related to".split())
CITIES = ("pune", "mumbai", "delhi", "bangalore", "bengaluru", "hyderabad", "chennai", "kolkata", "nagpur", "ahmedabad", "nashik", "jaipur")
CATEGORIES = {
    "Bills & Invoices": ("bill", "bills", "invoice", "invoices", "receipt", "receipts", "challan", "fee", "fees", "payment", "paid", "electricity", "utility", "power", "tax"),
    "Government & Identity Cards": ("aadhaar", "pan", "license", "card", "voter", "passport", "id", "uidai", "driving", "identity"),
    "Academic & College": ("marksheet", "grade", "semester", "exam", "college", "university", "transcript", "certificate", "student", "roll", "cgpa", "degree"),
    "Medical & Healthcare": ("hospital", "clinic", "prescription", "doctor", "medicine", "tablets", "pharma", "rx", "health"),
    "Legal & Agreements": ("agreement", "contract", "deed", "stamp", "notary", "affidavit", "lease", "rent"),
}
COLOURS = ("red", "blue", "green", "black", "white", "yellow", "orange", "purple", "pink", "grey", "gray")
SAME = {
    "people": ("people", "person", "pedestrian", "human", "crowd", "man", "woman", "men", "women"),
    "person": ("person", "people", "pedestrian", "human", "man", "woman"),
    "car": ("car", "cars", "automobile", "vehicle"),
    "cars": ("car", "cars", "automobile", "vehicle"),
    "watermark": ("watermark", "watermarked", "stamp", "logo"),
    "signature": ("signature", "signed", "sign", "autograph"),
    "stamp": ("stamp", "stamped", "seal"),
    "penalty": ("penalty", "fine", "late fee", "surcharge"),
    "blur": ("blur", "blurry", "blurred"),
    "mask": ("mask", "masked"),
    "glasses": ("glasses", "spectacles", "goggles"),
    "spectacles": ("spectacles", "glasses", "specs"),
}
NEGATIONS = (
    r"(?:with\s+no|without|excluding|except\s+for|except|free\s+of|not\s+having|not\s+containing|does\s+not\s+have|having\s+no)\s+([a-zA-Z]+(?:\s+[a-zA-Z]+)?)",
    r"(?:^|[,;]|\band\b)\s*no\s+([a-zA-Z]+(?:\s+[a-zA-Z]+)?)",
    r"\bnot\s+([a-zA-Z]+)\b",
)
PERSON_WORDS = ("person", "man", "woman", "girl", "boy", "face", "selfie", "wearing", "spectacles", "glasses", "shirt", "dress")
OBJECTS = ("car", "road", "sky", "bill", "meter", "board", "whiteboard", "slide", "chassis", "motor")
UNSEARCHED = frozenset("rupees rupee rs inr bucks year between above below more less than greater over under amount cost without excluding except neither does not having free".split())
STATUS_WORDS = {"UNPAID": ("unpaid", "due", "pending"), "PAID": ("paid", "cleared", "successful")}
MONTHS = {m: i for i, m in enumerate(("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"), 1)}
RELATIVE = {"recent": "recent", "latest": "recent", "newest": "recent", "last week": "last_week", "this week": "this_week", "this month": "this_month", "last month": "last_month", "today": "today", "yesterday": "yesterday"}
BROWSE = ("all", "*", "everything", "gallery")

_SUM = r"\s*[₹$Rs.]*\s*(\d+(?:\.\d+)?)"
_AMOUNT_IN_TEXT = r"[₹$Rs.]*\s*([\d,]+\.?\d*)"


@dataclass
class Constraints:
    exclusions: list[str] = field(default_factory=list)
    category: str | None = None
    year: str | None = None
    min_amount: float | None = None
    max_amount: float | None = None
    status: str | None = None
    city: str | None = None
    person: bool = False
    colours: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)

    @property
    def objects(self) -> list[str]:
        return [o for o in OBJECTS if o in self.words]

    @property
    def attributes(self) -> list[str]:
        return [c for c in COLOURS if c in self.words]


def _whole(word: str, text: str) -> bool:
    return re.search(rf"\b{re.escape(word)}\b", text) is not None


def _excluded(text: str) -> list[str]:
    """Excluded words with their synonyms, sorted."""
    named = (w for p in NEGATIONS for m in re.finditer(p, text) for w in re.findall("[a-zA-Z]+", m.group(1)))
    own = {w for w in named if w not in COMMAND_WORDS}
    return sorted(own.union(*(SAME.get(w, ()) for w in own)))


def parse(instruction: str) -> Constraints:
    """Typed constraints of an instruction; excluded words are never searched for."""
    q = instruction.strip().lower()
    c = Constraints(exclusions=_excluded(q))
    c.person = not {"person", "people", "human"} & set(c.exclusions) and any(w in q for w in PERSON_WORDS)
    c.city = next((x for x in CITIES if _whole(x, q)), None)
    overlap = {name: sum(_whole(w, q) for w in words) for name, words in CATEGORIES.items()}
    c.category = max(overlap, key=overlap.get) if any(overlap.values()) else None
    if m := re.search(r"\b(20[12]\d)\b", q):
        c.year = m.group(1)
    if m := re.search(rf"(?:between|from){_SUM}\s*(?:and|to|-){_SUM}", q):
        c.min_amount, c.max_amount = float(m.group(1)), float(m.group(2))
    else:
        if m := re.search(rf"(?:above|greater\s*than|more\s*than|>|over|exceeding){_SUM}", q):
            c.min_amount = float(m.group(1))
        if m := re.search(rf"(?:below|less\s*than|<|under|within){_SUM}", q):
            c.max_amount = float(m.group(1))
    if re.search(r"\b(?:unpaid|pending|due|overdue)\b", q):
        c.status = "UNPAID"
    elif re.search(r"\b(?:paid|cleared|settled|successful)\b", q) and not re.search(r"\bnot\s*paid\b", q):
        c.status = "PAID"
    skipped = COMMAND_WORDS | set(STOPWORDS) | UNSEARCHED | set(c.exclusions) | {c.city, c.year}
    c.words = [w for w in re.findall(r"[a-zA-Z0-9ऀ-ॿ]+", q) if w not in skipped and not w.isdigit()]
    c.colours = [x for x in COLOURS if _whole(x, q)] if c.person else c.attributes
    return c


def _labels() -> Column:
    """Lower-case visual objects and labels of a row; malformed metadata has none."""
    both = F.from_json("visual_metadata", "struct<objects:array<string>,labels:array<string>>")
    return F.transform(F.concat(F.coalesce(both["objects"], F.array().cast("array<string>")), F.coalesce(both["labels"], F.array().cast("array<string>"))), F.lower)


def _fields() -> list[Column]:
    return [F.lower(F.coalesce(c, F.lit(""))) for c in ("extracted_text", "image_name")]


def violated(c: Constraints) -> Column:
    """The first excluded term a row holds as a whole word of its text or name, or as a visual label; null without."""
    text, name = _fields()
    holds = [(t, text.rlike(rf"\b{re.escape(t)}\b") | name.rlike(rf"\b{re.escape(t)}\b") | F.coalesce(F.array_contains(_labels(), t), F.lit(False))) for t in c.exclusions]
    return F.coalesce(*[F.when(hit, F.lit(t)) for t, hit in holds], F.lit(None).cast("string"))


def suppressed(images: DataFrame, c: Constraints) -> DataFrame:
    """(id, term) of visible rows that an exclusion takes out."""
    return images.where("not coalesce(is_quarantined, false)").select("id", violated(c).alias("term")).where("term is not null")


def search(images: DataFrame, c: Constraints) -> DataFrame:
    """(id, score, satisfied, share) of visible rows that meet every constraint.

    ``satisfied`` lists the positive conditions a row meets, ``share`` is their
    share of all; the score adds to it the share of the words found.
    """
    text, name = _fields()
    holds = lambda w: text.contains(w) | name.contains(w)
    seen = lambda w: holds(w) | F.coalesce(F.array_contains(_labels(), w), F.lit(False))
    any_of = lambda ws: F.lit(False) if not ws else sum((holds(w).cast("int") for w in ws), F.lit(0)) > 0
    where = violated(c).isNull() & ~F.coalesce("is_quarantined", F.lit(False))
    if c.category:
        where &= F.coalesce(F.lower("category").contains(c.category.lower()), F.lit(False)) | any_of(CATEGORIES[c.category])
    if c.year:
        where &= holds(c.year)
    if c.min_amount is not None or c.max_amount is not None:
        inside = lambda v: (v > 10.0) & (F.lit(True) if c.min_amount is None else v >= c.min_amount) & (F.lit(True) if c.max_amount is None else v <= c.max_amount)
        found = F.transform(all_of(F.col("extracted_text"), _AMOUNT_IN_TEXT, 1), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
        where &= F.coalesce(F.exists(found, lambda v: F.coalesce(inside(v), F.lit(False))), F.lit(False))
    if c.city:
        where &= holds(c.city)
    if c.status:
        where &= sum((text.contains(w).cast("int") for w in STATUS_WORDS[c.status]), F.lit(0)) > 0
    wanted = [(f"object:{o}", seen(o)) for o in c.objects] + [(f"attribute:{a}", seen(a)) for a in c.attributes]
    wanted += [(f"{k}:{v}", F.lit(True)) for k, v in (("year", c.year), ("category", c.category)) if v]
    met = F.array_compact(F.array(*[F.when(hit, F.lit(k)) for k, hit in wanted])) if wanted else F.array().cast("array<string>")
    share = F.size("satisfied") / float(len(wanted)) if wanted else F.lit(1.0)
    hits = sum((seen(w).cast("int") for w in c.words), F.lit(0)) / float(max(1, len(c.words))) * 0.30
    rows = images.where(where).select("id", met.alias("satisfied"), hits.alias("hits"))
    return rows.select("id", F.round(0.40 * share + 0.30 + F.col("hits"), 3).alias("score"), "satisfied", F.round(share, 2).alias("share"))


def parse_temporal(query: str) -> dict[str, object]:
    """Exact date, year, month and relative word of a query, and the residual text."""
    q, out = query.lower(), {"date": None, "year": None, "month": None, "relative": None}
    if m := re.search(r"\b((?:19|20)\d\d)[-/.](0?[1-9]|1[012])[-/.](0?[1-9]|[12][0-9]|3[01])\b", q):
        out["date"] = f"{m.group(1)}-{int(m.group(2)):02d}-{int(m.group(3)):02d}"
    elif m := re.search(r"\b(0?[1-9]|[12][0-9]|3[01])[-/.](0?[1-9]|1[012])[-/.]((?:19|20)\d\d)\b", q):
        out["date"] = f"{m.group(3)}-{int(m.group(2)):02d}-{int(m.group(1)):02d}"
    if m := re.search(r"\b((?:19|20)\d\d)\b", q):
        out["year"] = int(m.group(1))
    for name, i in MONTHS.items():
        if re.search(rf"\b(?:{name}|{name[:3]})\b", q):
            out["month"] = i
    out["relative"] = next((kind for w, kind in RELATIVE.items() if _whole(w, q)), None)
    strip = r"\b(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|(?:19|20)\d\d|" + "|".join([*RELATIVE, *(x for n in MONTHS for x in (n, n[:3]))]) + r")\b"
    out["text"] = " ".join(re.sub(strip, " ", q).split())
    return out


def temporal_fit(when: dict[str, object], own: Column, dates: Column, known: Column) -> Column:
    """How well a row's date ``own`` and further ``dates`` fit a parsed time: 1 fits, 0 contradicts, between them undated rows."""
    has = F.length(own) > 0
    some = lambda test: F.coalesce(test(own), F.lit(False)) | F.coalesce(F.exists(dates, test), F.lit(False))
    if when["date"]:
        return F.when(some(lambda x: x == F.lit(when["date"])), 1.0).when(has, 0.0).otherwise(0.3)
    if when["year"]:
        year = str(when["year"])
        in_year = some(lambda x: x.startswith(year))
        if when["month"]:
            month = f"{year}-{when['month']:02d}"
            return F.when(in_year & some(lambda x: x.startswith(month)), 1.0).when(has, 0.0).when(in_year, 0.3).otherwise(0.4)
        return F.when(in_year, 1.0).when(has, 0.0).otherwise(0.4)
    if when["month"]:
        part = f"-{when['month']:02d}"
        return F.when(some(lambda x: x.contains(part)), 1.0).when(has, 0.0).otherwise(0.4)
    return F.when(known, 0.9).otherwise(0.5) if when["relative"] == "recent" else F.lit(0.5)


def fuse_temporal(score: Column, fit: Column) -> Column:
    """Keyword score and temporal fit as one, at most 1."""
    return F.round(F.least(F.lit(1.0), score * 0.75 + fit * 0.25 + F.when(fit == 1.0, 0.05).otherwise(0.0)), 3)


def route(query: str, user_id: int | None) -> str:
    """'none' for empty queries and nobody, 'browse' for all, 'numeric' for numbers, else 'search'."""
    q = query.strip().lower()
    if not q or user_id is None or user_id == -1:
        return "none"
    if q in BROWSE:
        return "browse"
    return "numeric" if q.isdigit() or len(q) <= 3 and not q.isalpha() else "search"
