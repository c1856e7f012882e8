"""Row predicates of faceted search; each is one Column, so a conjunction is one filter that is pushed down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions import entities as E
from paperloom.functions.text import all_of
from paperloom.operators.documents import invoice

# Names of entity kinds.
ENTITY_KINDS = {"aadhaar": "aadhaar", "aadhaar_number": "aadhaar", "pan": "pan", "pan_number": "pan", "phone": "phones", "phone_number": "phones", "email": "emails", "url": "urls", "amount": "amounts", "money": "amounts", "id": "identifiers", "ids": "identifiers", "application_id": "identifiers", "date": "dates", "dates": "dates"}
# Region sources and words of structural visual kinds.
VISUAL_KINDS = {"qr": ("qr", "barcode"), "signature": ("signature", "sign"), "stamp": ("stamp", "seal")}


@dataclass(frozen=True)
class Facets:
    """Optional parts of a search; None leaves a part out."""

    user_id: int | None = None
    is_admin: bool = False
    date_from: str | None = None
    date_to: str | None = None
    year: int | None = None
    category: str | None = None
    file_format: str | None = None
    entity_type: str | None = None
    min_amount: float | None = None
    max_amount: float | None = None
    visual_type: str | None = None


def candidate_dates() -> Column:
    """Dates of a row in mixed precision; the file time counts only if there is no other."""
    clean = lambda c: F.when(F.col(c).rlike(r"^(19|20)[0-9]{2}(-[0-9]{2}){0,2}"), F.substring(F.col(c), 1, 10))
    own = F.array_compact(F.array(clean("primary_date"), clean("exif_created_at")))
    return F.when(F.size(own) > 0, own).otherwise(F.array_compact(F.array(clean("file_modified_at"))))


def in_date_range(dates: Column, low: str | None, high: str | None) -> Column:
    """Any date within the bounds, compared on the common precision."""

    def fits(x: Column) -> Column:
        ok = F.lit(True)
        if low:
            n = F.least(F.length(x), F.lit(len(low)))
            ok = ok & (F.substring(x, F.lit(1), n) >= F.substring(F.lit(low), F.lit(1), n))
        if high:
            n = F.least(F.length(x), F.lit(len(high)))
            ok = ok & (F.substring(x, F.lit(1), n) <= F.substring(F.lit(high), F.lit(1), n))
        return ok

    return F.exists(dates, fits)


def in_year(dates: Column, year: int) -> Column:
    return F.exists(dates, lambda x: x.startswith(str(year)))


def in_category(c: Column, category: str) -> Column:
    """Equal, equal with _ for blanks, or one _-part of the category."""
    q, own = category.strip().lower(), F.lower(F.trim(c))
    return own.isin(q, q.replace(" ", "_"), q.replace("_", " ")) | F.array_contains(F.split(own, "_"), q)


def _format(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low == "jpg", "jpeg").otherwise(low)


def in_format(file_format: str) -> Column:
    """The format column or the suffix of the name; jpg is jpeg."""
    want = "jpeg" if file_format.lower() == "jpg" else file_format.lower()
    return F.coalesce(_format(F.col("file_format")) == want, F.lit(False)) | F.coalesce(_format(F.regexp_extract("image_name", r"\.([^.]+)$", 1)) == want, F.lit(False))


# Names of the stored arrays of entities.
STORED = {"aadhaar": "aadhaar_numbers", "pan": "pan_numbers", "phones": "phone_numbers", "identifiers": "ids"}


def has_entity(kind: str) -> Column:
    """Whether the stored entities of a row hold one of the kind; a primary date is a date."""
    name = ENTITY_KINDS[kind.lower()]
    found = F.get_json_object("entities_json", f"$.{STORED.get(name, name)}")
    held = found.isNotNull() & ~F.regexp_replace(found, r"\s", "").isin("[]", "null", "")
    return F.coalesce(held | (F.trim(F.coalesce("primary_date", F.lit(""))).rlike("^(19|20)[0-9]{2}") if name == "dates" else F.lit(False)), F.lit(False))


def amount_between(text: Column, low: float | None, high: float | None) -> Column:
    """Any amount from 1 to a million, or the grand total of an invoice, in the range."""
    inside = lambda v: (v <= 1_000_000) & (F.lit(True) if low is None else v >= low) & (F.lit(True) if high is None else v <= high)
    return F.coalesce(F.exists(E.amounts(text), inside), F.lit(False)) | F.coalesce(inside(invoice(text)["total"]), F.lit(False))


def tenant(user_id: int | None, is_admin: bool = False) -> Column:
    """Admins see all rows, users their own, nobody (null or -1) none."""
    if is_admin:
        return F.lit(True)
    return F.lit(False) if user_id is None or user_id < 0 else F.col("user_id") == user_id


def guest_name(session: Column) -> Column:
    return F.concat(F.lit("guest_"), F.substring(F.sha2(session, 256), 1, 16))


def visual_kind(images: DataFrame, regions: DataFrame, kind: str) -> DataFrame:
    """Rows with a structural visual kind by region source, category, name or object label."""
    words = VISUAL_KINDS.get(kind, (kind,))
    any_of = lambda c: F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))
    in_regions = regions.where(any_of(F.col("region_source")) | any_of(F.col("location_desc"))).select(F.col("image_id").alias("id")).distinct()
    by_row = any_of(F.col("category")) | any_of(F.col("image_name")) | any_of(F.col("visual_metadata"))
    return images.join(in_regions.withColumn("in_region", F.lit(True)), "id", "left").where(by_row | F.coalesce("in_region", F.lit(False))).drop("in_region")


def eligible(images: DataFrame, regions: DataFrame, f: Facets) -> DataFrame:
    """Completed, visible rows of the tenant that fit every given facet."""
    text, dates = F.col("extracted_text"), candidate_dates()
    where = (F.col("indexing_status") == "completed") & ~F.coalesce("is_quarantined", F.lit(False)) & tenant(f.user_id, f.is_admin)
    if f.date_from or f.date_to:
        where &= in_date_range(dates, f.date_from, f.date_to)
    if f.year:
        where &= in_year(dates, f.year)
    if f.category:
        where &= in_category(F.col("category"), f.category)
    if f.file_format:
        where &= in_format(f.file_format)
    if f.entity_type:
        where &= has_entity(f.entity_type)
    if f.min_amount is not None or f.max_amount is not None:
        where &= amount_between(text, f.min_amount, f.max_amount)
    rows = images.where(where)
    return visual_kind(rows, regions, f.visual_type) if f.visual_type else rows


def excluded_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether the text holds one of the terms as a whole word."""
    return F.coalesce(F.lower(text).rlike(r"\b(?:" + "|".join(terms) + r")\b"), F.lit(False)) if terms else F.lit(False)


def number_guard(query: str, score: Column) -> Column:
    """A completed row whose text or name has the digits of a number query, or a score of .52; other queries let every completed row pass."""
    held = F.coalesce(F.col("extracted_text").contains(query) | F.col("image_name").contains(query), F.lit(False)) | (score >= 0.52)
    return F.coalesce(F.col("indexing_status") == "completed", F.lit(False)) & (held if query.isdigit() else F.lit(True))


def same_document(id_a: Column, canonical_a: Column, id_b: Column, canonical_b: Column) -> Column:
    """Whether two rows show one document: the same row, the same canonical row, or one is the other's."""
    a, b = F.coalesce(canonical_a, id_a), F.coalesce(canonical_b, id_b)
    return F.coalesce((id_a == id_b) | (a == b) | (a == id_b) | (b == id_a), F.lit(False))


def all_terms(text: Column, pattern: str) -> Column:
    return all_of(text, pattern)
