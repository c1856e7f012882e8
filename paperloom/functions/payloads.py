"""Columns over code payloads, pages and invoices."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paperloom.functions.text import all_of

_PAIRS = "array<struct<tag:string,value:string>>"


def tag_length_values(c: Column) -> Column:
    """array<struct<tag, value>> of a tag-length-value payload; a field that is cut ends it.

    A fold over as many steps as fields can fit; each step reads one field at
    the position the fields before it left.
    """
    steps = F.sequence(F.lit(0), F.floor(F.length(c) / 4).cast("int"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast(_PAIRS).alias("got"))

    def read(s: Column, _: Column) -> Column:
        size = F.substring(c, s["at"] + 2, F.lit(2)).try_cast("int")
        whole = (s["at"] > 0) & (s["at"] + 3 <= F.length(c)) & F.substring(c, s["at"] + 2, F.lit(2)).rlike("^[0-9]{2}$") & (s["at"] + 3 + size <= F.length(c))
        one = F.array(F.struct(F.substring(c, s["at"], F.lit(2)).alias("tag"), F.substring(c, s["at"] + 4, size).alias("value")))
        return F.when(F.coalesce(whole, F.lit(False)), F.struct((s["at"] + 4 + size).alias("at"), F.concat(s["got"], one).alias("got"))).otherwise(F.struct(F.lit(-1).alias("at"), s["got"].alias("got")))

    return F.aggregate(steps, start, read)["got"]


def opened(fields: Column) -> Column:
    """The fields with those of the templates 26 to 51 below them, tags joined by a dot."""
    inner = lambda f: F.transform(tag_length_values(f["value"]), lambda g: F.struct(F.concat_ws(".", f["tag"], g["tag"]).alias("tag"), g["value"].alias("value")))
    return F.flatten(F.transform(fields, lambda f: F.concat(F.array(f), F.when(f["tag"].between("26", "51"), inner(f)).otherwise(F.array().cast(_PAIRS)))))


def contact_fields(c: Column) -> Column:
    """Name, organisation and phone of a MeCard or vCard payload; null where a field is missing."""
    card = F.upper(c).startswith("MECARD:")
    short = lambda k: F.nullif(F.trim(F.regexp_extract(c, rf"(?i)\b{k}:([^;]+)", 1)), F.lit(""))
    long = lambda k: F.nullif(F.trim(F.regexp_extract(c, rf"(?im)^{k}:([^\r\n]*)", 1)), F.lit(""))
    pick = lambda a, b: F.when(card, short(a)).when(F.upper(c).contains("BEGIN:VCARD"), long(b))
    return F.struct(pick("N", "FN").alias("name"), pick("ORG", "ORG").alias("org"), pick("TEL", "TEL[^:\r\n]*").alias("phone"))


def url_words(c: Column) -> Column:
    """Words of the path of a web address."""
    return F.filter(F.split(F.regexp_extract(c, r"(?i)^https?://[^/?#]+/([^?#]*)", 1), r"[/_.+-]+"), lambda w: F.length(w) > 1)


# Words that mark a line of an invoice as no item.
NO_ITEM = r"(?i)\b(?:total|subtotal|cgst|sgst|igst|tax|paid|balance|thank)\b"


def line_items(c: Column) -> Column:
    """array<struct<item, price>> of the lines ``name price`` of an invoice, summary lines left out."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x, F.lit(" \t\r\f"))), lambda x: (F.length(x) > 0) & ~x.rlike(NO_ITEM) & x.rlike(r"^.+?\s+[0-9,]+\.?[0-9]{0,2}$"))
    price = lambda x: F.replace(F.regexp_extract(x, r"^(.+?)\s+([0-9,]+\.?[0-9]{0,2})$", 2), F.lit(","), F.lit("")).try_cast("double")
    name = lambda x: F.trim(F.regexp_extract(x, r"^(.+?)\s+([0-9,]+\.?[0-9]{0,2})$", 1))
    found = F.transform(lines, lambda x: F.struct(name(x).alias("item"), price(x).alias("price")))
    return F.filter(found, lambda i: (F.length(i["item"]) >= 3) & (i["price"] > 0))


def all_offsets(c: Column, word: str) -> Column:
    """Every start (from 0) of a word in a text, in any case, overlapping ones included."""
    low, w = F.lower(c), word.lower()
    if not w:
        return F.array().cast("array<int>")
    last = F.length(low) - len(w)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.substring(low, i + 1, F.lit(len(w))) == w)


def subsumed(phrases: Column, most: int = 4) -> Column:
    """The ``most`` best phrases (score, phrase) none of which lies within another, by score and then length."""
    ranked = F.sort_array(F.transform(phrases, lambda p: F.struct((-p["score"]).alias("s"), (-F.length(p["phrase"])).alias("l"), p["phrase"].alias("phrase"))))
    step = lambda kept, p: F.when((F.size(kept) < most) & ~F.exists(kept, lambda k: k.contains(p["phrase"]) | p["phrase"].contains(k)), F.concat(kept, F.array(p["phrase"]))).otherwise(kept)
    return F.aggregate(ranked, F.array().cast("array<string>"), step)


def is_text(content: Column) -> Column:
    """Whether bytes are text: no zero byte among the first 512, and valid UTF-8."""
    head = F.substring(content, 1, 512)
    zero = F.hex(head).rlike("^(?:[0-9A-F]{2})*?00")
    return F.coalesce(~zero & F.try_validate_utf8(content.cast("string")).isNotNull() & (F.length(content) > 0), F.lit(False))


def all_words(c: Column) -> Column:
    return all_of(F.lower(c), r"[a-z0-9\x{0900}-\x{097F}]+")
