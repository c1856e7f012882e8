"""Missing or wrong language labels (problem 7).

Compression classification.  For each language and script a zstandard
raw-content dictionary is made of clean reference sentences, a few fixed
function words and sentences of the corpus itself.  Those are chosen on a
bounded sample of labelled texts (``REFERENCE_TEXTS``): every pair of words that
follow each other belongs to the label that surely bears most of its texts, a
sentence to the language of its pairs, and every pair that is frequent in its
language brings one sentence into the dictionary.  A unit of text is encoded
with every dictionary of its script; the smallest output names the language,
the relative margin to the next language is the confidence, and narrow margins
are rejected.

Units are sentences; neighbouring sentences of one language form a segment.
Field lines, names, numbers and short fragments are no sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.plans.scratch import Scratch

LANGUAGES = ("en", "hi", "mr", "es", "fr", "de")
# Spellings of language labels, after lower-casing and dropping region and script parts.
NAMES = {
    "en": ("en", "eng", "english"),
    "hi": ("hi", "hin", "hindi", "हिन्दी", "हिंदी"),
    "mr": ("mr", "mar", "marathi", "मराठी"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
}
# Common function words, the floor under the dictionaries where the corpus is small.
WORDS = {
    ("en", "L"): " the and of to in is are was were be been has have had will would shall should may can could not no for with from by on at as or if that this these those it its their there which who whom when where after before under until unless please your our we you they each every any all ",
    ("es", "L"): " el la los las un una de del al y o que en es son fue está están ha han por para con sin sobre antes después hasta desde su sus se no si más muy como cuando donde este esta estos estas usted nosotros debe deben puede pueden todavía también ",
    ("fr", "L"): " le la les un une des du de et ou que qui en est sont été a ont pour avec sans sur avant après jusqu'à depuis son sa ses leur leurs ne pas plus si comme quand où ce cette ces vous nous doit doivent peut peuvent encore aussi dans par au aux ",
    ("de", "L"): " der die das den dem des ein eine einen einem einer und oder dass in ist sind war wurde wird werden hat haben für mit ohne auf vor nach bis seit sein seine ihr ihre sich nicht kein wenn wie wann wo dieser diese dieses Sie wir muss müssen kann können noch auch bei zum zur im am ",
    ("hi", "L"): " hai hain tha thi the ka ki ke ko se mein par aur ya nahin na hi bhi to kya jo woh yeh apna apni apne ho hoga hogi karein kar kiya gaya gayi diya diye raha rahi rahe tak liye baad pehle saath kripya ek do ",
    ("mr", "L"): " aahe aahet hota hoti hote cha chi che la ne madhye var ani kinva nahi na hi pan tar kay jo to ti te aapla aapli aaple hoil kara kele keli kela zala zali sathi nantar purvi sobat krupaya ek don yethe ",
    ("hi", "D"): " है हैं था थी थे का की के को से में पर और या नहीं न ही भी तो क्या जो वह यह अपना अपनी अपने हो होगा होगी करें कर किया गया गई दिया दिए रहा रही रहे तक लिए बाद पहले साथ कृपया एक दो ",
    ("mr", "D"): " आहे आहेत होता होती होते चा ची चे ला ने मध्ये वर आणि किंवा नाही न ही पण तर काय जो तो ती ते आपला आपली आपले होईल करा केले केली केला झाला झाली साठी नंतर पूर्वी सोबत कृपया एक दोन येथे यांना यांनी ",
}
#: Bound on the labelled texts the dictionaries are fitted on; each distinct text counts once.
REFERENCE_TEXTS = 40_000
#: Least share of a pair among the pairs of its language; at most 1 / LEAST_SHARE sentences enter a dictionary.
LEAST_SHARE = 2e-4
#: A pair belongs to a label if the lower bound of its share (Wilson, Z standard errors) is a half.
Z = 2.0
#: A sentence belongs to a language with more than MOST of its pairs, and at most OTHER of them elsewhere.
MOST, OTHER = 0.5, 0.1
#: Clean sentences may be so many at most, as they are part of what is sent to every task.
MOST_SAMPLES = 10_000
MARGIN = 0.05
#: A further language of a text needs a sentence with this margin.
SURE = 0.25
BREAKS = r"(?<=[.!?।॥])\s+|\s*\|\s*|\s*[\n\r\f\u2028\u2029]\s*(?![a-zà-ÿ\d\s])"  # a line that goes on in lower case or with a number continues the sentence
LEAST_WORDS = 3


def label_of(c: Column) -> Column:
    """Code of the language a label names, null if it names none."""
    plain = F.regexp_replace(F.lower(F.trim(c)), r"[-_\s(,;/].*$", "")
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(plain.isin(*names), code).otherwise(out)
    return out


_DEVA, _LATIN = regex.compile(r"\p{Devanagari}"), regex.compile(r"\p{Latin}")
_WORD = regex.compile(r"[\p{L}\p{M}]{2,}")
_DIGIT = re.compile(r"[\d@]")
_FIELD = regex.compile(r"^[\p{L}\p{M}\s./-]{1,28}[:：]")
_BREAK = re.compile(BREAKS)
_END_NUMBER = re.compile(r"(?:^|\s)0$")


def script(text: str) -> str | None:
    if text.isascii():
        return "L" if sum(map(str.isalpha, text)) >= 4 else None
    d, n = len(_DEVA.findall(text)), len(_LATIN.findall(text))
    return None if d + n < 4 else "D" if d >= n else "L"


def plain(sentence: str) -> str:
    """The sentence with numbers and addresses masked and blanks collapsed."""
    if not _DIGIT.search(sentence):
        return " ".join(sentence.split())
    return " ".join([w if w.isalpha() or not _DIGIT.search(w) else "0" for w in sentence.split()])


def units(text: str | None) -> list[tuple[int, str]]:
    """(offset, sentence) of every unit of the text, in order."""
    if not text:
        return []
    out, start = [], 0
    for m in _BREAK.finditer(text):
        out.append((start, text[start : m.start()]))
        start = m.end()
    out.append((start, text[start:]))
    return [(o, s) for o, s in out if s.strip()]


def is_sentence(s: str) -> bool:
    """A closed sentence of several words that is no field line."""
    t = s.rstrip(" \t\"'»”)")
    if t[-1:] == "0" and _END_NUMBER.search(t):  # a masked number or address at the end took the stop with it
        t += "."
    if not t or t[-1] not in ".!?।॥" or _FIELD.match(s.strip()):
        return False
    words = _WORD.findall(" ".join([w for w in s.split() if not _DIGIT.search(w)]))
    return len(words) >= LEAST_WORDS and sum(not w[0].isupper() for w in words) >= 2


_NAME = regex.compile(r"(?<=.)(?<![\p{L}\p{M}])\p{Lu}[\p{L}\p{M}]*")


def word_pairs(sentence: str) -> list[str]:
    """Distinct pairs of neighbouring words, without names and numbers."""
    words = _NAME.sub("^", sentence).lower().split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:]) if not {a, b} & {"^", "0"}})


def _lower_bound(hits: Column, of: Column) -> Column:
    """Lower bound of a share (Wilson)."""
    p = hits / of
    return (p + Z * Z / (2 * of) - Z * F.sqrt((p * (1 - p) + Z * Z / (4 * of)) / of)) / (1 + Z * Z / of)


def reference_sentences(images: DataFrame, bound: int = REFERENCE_TEXTS) -> DataFrame:
    """(lang, script, sentence, n): sentences that cover the frequent word pairs of each language.

    Fitted on about ``bound`` distinct labelled texts, drawn by the hash of the
    text.  A text votes once, for the label that most of its copies bear, so
    copies of one wrong label are no evidence; pairs need a share of the votes
    whose lower bound is a half, so chance agreements do not grow with the
    corpus.  Per language and script at most 1 / ``LEAST_SHARE`` rows.
    """
    scratch = Scratch(images.sparkSession)
    labelled = images.select(F.col("extracted_text").alias("text"), label_of(F.col("ocr_lang")).alias("label")).where("label is not null and text is not null")
    share = min(1.0, bound / max(labelled.count(), 1))
    drawn = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(round(1_000_000 * share)))
    texts = drawn.groupBy("text").agg(*[F.count_if(F.col("label") == x).alias(x) for x in LANGUAGES])
    most = F.greatest(*LANGUAGES)
    texts = texts.select("text", F.coalesce(*[F.when(F.col(x) == most, F.lit(x)) for x in LANGUAGES]).alias("label"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(LANGUAGES)}
        for b in batches:
            rows: dict[str, list[int]] = {}
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s in {plain(s) for _, s in units(text) if is_sentence(s)}:
                    rows.setdefault(s, [0] * len(LANGUAGES))[place[label]] += 1
            if rows:
                keys = list(rows)
                counts = [pa.array([n[i] for n in rows.values()], pa.int64()) for i in range(len(LANGUAGES))]
                yield pa.RecordBatch.from_arrays([pa.array([script(k) for k in keys], pa.string()), pa.array(keys, pa.string()), pa.array([word_pairs(k) for k in keys], pa.list_(pa.string())), *counts], ["script", "sentence", "pairs", *LANGUAGES])

    schema = "script string, sentence string, pairs array<string>, " + ", ".join(f"{x} long" for x in LANGUAGES)
    counts = texts.mapInArrow(split, schema).where("script is not null and size(pairs) > 0")
    counts = scratch.put(counts.groupBy("script", "sentence").agg(F.first("pairs").alias("pairs"), *[F.sum(x).alias(x) for x in LANGUAGES]))
    n = sum(F.col(x) for x in LANGUAGES)
    single = counts.select("script", "sentence", F.size("pairs").alias("of"), n.alias("n"), *LANGUAGES, F.explode("pairs").alias("pair"))
    votes = single.groupBy("script", "pair").agg(*[F.sum(x).alias(x) for x in LANGUAGES])
    owned = votes.select("script", "pair", F.coalesce(*[F.when(_lower_bound(F.col(x), n) >= 0.5, F.lit(x)) for x in LANGUAGES]).alias("owner")).where("owner is not null")
    per = single.join(owned, ["script", "pair"]).groupBy("script", "sentence").agg(F.first("n").alias("n"), F.first("of").alias("of"), *[F.count_if(F.col("owner") == x).alias(x) for x in LANGUAGES])
    most = F.greatest(*LANGUAGES)
    lang = F.coalesce(*[F.when(F.col(x) == most, F.lit(x)) for x in LANGUAGES])
    named = per.where((most > MOST * F.col("of")) & (n - most <= OTHER * F.col("of"))).select("script", "sentence", lang.alias("lang"), F.col("n").alias("uses"))
    named = scratch.put(named.join(counts.select("script", "sentence", "pairs"), ["script", "sentence"]))
    kept = named.select("lang", "script", "sentence", "uses", F.explode("pairs").alias("pair")).groupBy("lang", "script", "pair").agg(F.sum("uses").alias("n"), F.max(F.struct("uses", (-F.length("sentence")).alias("short"), "sentence")).alias("best"))
    total = named.groupBy("lang", "script").agg(F.sum(F.col("uses") * F.size("pairs")).alias("total"))
    frequent = kept.join(F.broadcast(total), ["lang", "script"]).where(F.col("n") >= LEAST_SHARE * F.col("total"))
    return frequent.select("lang", "script", "best.sentence", F.col("best.uses").alias("n")).distinct()


def dictionaries(references: pd.DataFrame, samples: pd.DataFrame) -> dict[tuple[str, str], bytes]:
    """Raw dictionary content per (language, script): rare content first, since matches near the end are cheapest.

    A class without a reference and without a clean sample has no dictionary.
    """
    out = {}
    for (lang, kind), words in WORDS.items():
        own = references[(references.lang == lang) & (references.script == kind)].sort_values(["n", "sentence"])
        clean = [t for t, x in zip(samples.text, samples.lang) if t and x == lang and script(t) == kind]
        if len(own) or clean:
            out[lang, kind] = ("\n".join([words, *own.sentence, *clean, words])).encode("utf-8", "surrogatepass")
    return out


class Classifier:
    """Sizes of a text under every dictionary of its script."""

    def __init__(self, content: dict[tuple[str, str], bytes], level: int = 3):
        self.coders: dict[str, list[tuple[str, zstandard.ZstdCompressor]]] = {"D": [], "L": []}
        for (lang, kind), raw in content.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders[kind].append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        self.known: dict[str, tuple[str | None, float]] = {}

    def sentence(self, text: str) -> bool:
        """Whether a unit is a sentence."""
        return (text.rstrip()[-1:] or " ") in "।॥.!?\"'»”)" and is_sentence(text)

    def classify(self, text: str) -> tuple[str | None, float]:
        """(language, margin) of a sentence; no language for what is no sentence, or if the margin is narrow."""
        key = plain(text)
        if key in self.known:
            return self.known[key]
        kind, out = script(key) if self.sentence(text) else None, (None, 0.0)
        if kind:
            raw = (" " + key + " ").encode("utf-8", "surrogatepass")
            size: dict[str, int] = {}
            for lang, coder in self.coders[kind]:
                size[lang] = min(size.get(lang, 1 << 30), len(coder.compress(raw)) - 6)
            (best, a), (_, b) = [*sorted(size.items(), key=lambda x: (x[1], x[0])), (None, len(raw)), (None, len(raw))][:2]
            margin = (b - a) / max(b, 1)
            out = (best if margin >= MARGIN else None, round(margin, 4))
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[key] = out
        return out


def segments(model: Classifier, text: str | None) -> list[tuple[int, int, str | None, float, int]]:
    """(start, end, lang, confidence, sentences) of the segments of a text.

    The languages of a text are those of its sure sentences, or the one with
    the most margin if none is sure.  A unit that is no sentence, or of no such
    language, joins the segment before it (the first one, if it comes first).
    """
    named = [(o, s, *model.classify(s)) for o, s in units(text)]
    total: dict[str, float] = {}
    for _, _, lang, margin in named:
        if lang:
            total[lang] = total.get(lang, 0.0) + margin
    allowed = {lang for _, _, lang, margin in named if lang and margin >= SURE} or ({max(sorted(total), key=total.get)} if total else set())
    out: list[list] = []
    for offset, s, lang, margin in named:
        lang = lang if lang in allowed else None
        end = offset + len(s)
        if out and (lang is None or out[-1][2] in (None, lang)):
            last = out[-1]
            last[1], last[2] = end, last[2] or lang
            last[3] += margin if lang else 0.0
            last[4] += lang is not None
        else:
            out.append([offset, end, lang, margin if lang else 0.0, int(lang is not None)])
    return [(a, b, x, round(c / n, 4) if n else 0.0, n) for a, b, x, c, n in out]


def model_of(images: DataFrame, samples: DataFrame) -> dict[tuple[str, str], bytes]:
    """The dictionaries; their size is bounded by ``LEAST_SHARE``, that of ``samples`` is checked."""
    clean = samples.select("text", "lang").limit(MOST_SAMPLES + 1).toPandas()
    if len(clean) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} clean sentences; pass fewer")
    return dictionaries(reference_sentences(images).toPandas(), clean)


def text_segments(rows: DataFrame, content: dict[tuple[str, str], bytes], key: str = "id", text: str = "extracted_text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per segment: key, ``carry`` columns, seg_no, start_pos, end_pos, lang, confidence, sentences.

    Null and blank texts give no rows; a text without a sentence gives one
    segment without language.
    """
    fields = rows.select(key, *carry).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", seg_no int, start_pos long, end_pos long, lang string, confidence double, sentences int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(content)
        for b in batches:
            take, found = [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for n, s in enumerate(segments(model, t)):
                    take.append(i)
                    found.append((n, *s))
            if take:
                kept = [c.take(pa.array(take)) for c in b.columns[:-1]]
                cols = list(zip(*found))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(cols, kinds))], [*(f.name for f in fields), "seg_no", "start_pos", "end_pos", "lang", "confidence", "sentences"])

    return rows.select(key, *carry, text).mapInArrow(run, schema)


def wrong_labels(images: DataFrame, samples: DataFrame) -> DataFrame:
    """(image_id, lang): texts whose label is missing or wrong, and every language of mixed texts."""
    parts = text_segments(images.select("id", label_of(F.col("ocr_lang")).alias("label"), "extracted_text"), model_of(images, samples), carry=("label",))
    per_text = parts.where("lang is not null and sentences > 0").groupBy("id").agg(F.max("label").alias("label"), F.collect_set("lang").alias("langs"))
    wrong = (F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.element_at("langs", 1))
    return per_text.where(wrong).select(F.col("id").alias("image_id"), F.explode("langs").alias("lang"))
