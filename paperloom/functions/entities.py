"""Entities of texts as expressions: dates, addresses of mail and web, numbers, amounts, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paperloom.functions.text import all_of

# Patterns of the entity kinds; Java and RE2 read them alike.
MONTH = r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t|tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DMY = r"\b(0?[1-9]|[12][0-9]|3[01])[-/.](0?[1-9]|1[012])[-/.]((?:19|20)\d\d)\b"
YMD = r"\b((?:19|20)\d\d)[-/.](0?[1-9]|1[012])[-/.](0?[1-9]|[12][0-9]|3[01])\b"
TEXTUAL = rf"(?i)\b([0-3]?[0-9Oo])(?:st|nd|rd|th)?[\s.-]+{MONTH}[\s,.-]+((?:19|20)\d\d)\b"
MONTH_YEAR = rf"(?i)\b{MONTH}[\s,]+((?:19|20)\d\d)\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+91[\s.-]?)?([6-9]\d{4}[\s.-]?\d{5})\b"
PHONE_NEAR = r"(?i)(?:Phone|Contact|Mobile|Tel|Cell|Call)\s*[:#-]?\s*(\+?[0-9\s.-]{8,16})"
URL = r"(?i)\b(?:https?://|www\.)[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/[^\s,;<>'\"()]*)*|\b(?:[a-zA-Z0-9-]+\.)+(?:com|in|org|net|edu|gov\.in|ac\.in|nic\.in|res\.in|io|ai|co|app|gle|me|tech|xyz|info|dev|live)(?:/[^\s,;<>'\"()]*)?\b"
AMOUNT = r"(?i)(?:₹|Rs\.?|INR)\s*([\d,]+(?:\.\d{1,2})?)\s*(?:/-)?"
AMOUNT_NEAR = r"(?i)(?:Fee|Amount|Paid|Total|Scholarship|Grant|Stipend|Penalty|Price)\s*[:#-]?\s*(?:₹|Rs\.?|INR)?\s*([\d,]+(?:\.\d{1,2})?)\s*(?:/-)?"
#: Years that are no amounts; suffixes of files, which are no web addresses.
NO_AMOUNT, FILE_SUFFIXES = (2024.0, 2025.0, 2026.0, 2027.0), ("png", "jpg", "jpeg", "pdf", "txt", "bak")
LABELLED_ID = r"(?i)(?:Roll\s*(?:No\.?|Number|ID|#)?|Hall\s*Ticket(?:\s*ID|\s*No\.?)?|App(?:lication)?\s*(?:No\.?|Number|ID|#)|Enrollment(?:\s*No\.?|\s*ID)?|Reg(?:istration)?\s*(?:No\.?|Number|ID|#)|Transaction\s*(?:Ref|ID|No\.?)|TXN(?:\s*Ref|\s*ID|\s*No\.?)?|Student\s*ID|\bID\s*[:#-])\s*[:#-]?\s*([A-Za-z0-9/-]{2,25})"
ROLL = r"\b(\d{2}[A-Za-z]{2,5}\d{2,4})\b"
AADHAAR = r"\b([2-9]\d{3}\s?\d{4}\s?\d{4})\b"
PAN = r"\b([A-Z]{3}[PCHFATBLJG][A-Z]\d{4}[A-Z])\b"
# Addresses and helplines that identify nobody.
GENERIC_MAIL = ("info@", "support@", "admin@", "contact@", "help@", "noreply@", "service@", "mail@", "office@", "webmaster@", "sales@", "billing@")
HELPLINES = ("1800", "1947", "112", "100", "101", "108")
# Tokens that are no identifiers.
WEAK_IDS = ("APEX", "ENTITY", "ENTITYCARD", "IDENTITY", "CARD", "STUDENT", "CANDIDATE", "FORM", "NAME", "PROCESS", "DATE", "EXAM", "CENTER", "PORTAL", "COPY", "APPLICANT", "VERIFICATION", "APPLICATION", "REGISTRAR", "COUNCIL", "DIRECTED", "ACADEMIC", "UNIVERSITY", "NOTICE", "EROF", "ROLLEROF", "NULL", "NONE", "UNKNOWN", "TEST", "UNDEFINED", "STUDENTIDENTITYCARD", "IDENTITYCARD", "SIGNATURE", "OFFICE", "COLLEGE", "INSTITUTE", "PRINCIPAL")


def _iso(y: Column, m: Column, d: Column) -> Column:
    """ISO date, null where the calendar has no such day."""
    y, m, d = y.cast("int"), m.cast("int"), d.cast("int")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when((m == 2) & leap, 29).when(m == 2, 28).otherwise(31)
    return F.when((d >= 1) & (d <= last), F.format_string("%04d-%02d-%02d", y, m, d))


def dates(c: Column) -> Column:
    """Distinct ISO dates of a text in the order textual, day first, year first, then months without a day."""
    zipped = lambda p: F.arrays_zip(*[all_of(c, p, g).alias(f"g{g}") for g in (1, 2, 3)])
    textual = F.transform(zipped(TEXTUAL), lambda z: _iso(z["g3"], _month_no(z["g2"]), F.translate(z["g1"], "Oo", "00")))
    dmy = F.transform(zipped(DMY), lambda z: _iso(z["g3"], z["g2"], z["g1"]))
    ymd = F.transform(zipped(YMD), lambda z: _iso(z["g1"], z["g2"], z["g3"]))
    days = F.filter(F.concat(textual, dmy, ymd), lambda x: x.isNotNull())
    pairs = F.arrays_zip(all_of(c, MONTH_YEAR, 1).alias("g1"), all_of(c, MONTH_YEAR, 2).alias("g2"))
    bare = F.transform(pairs, lambda z: F.concat(z["g2"], F.lit("-"), F.lpad(_month_no(z["g1"]).cast("string"), 2, "0")))
    return F.array_distinct(F.concat(days, F.filter(bare, lambda m: ~F.exists(days, lambda x: x.startswith(m)))))


def _month_no(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1):
        out = F.when(F.lower(F.substring(name, 1, 3)) == m, i).otherwise(out)
    return out


def emails(c: Column) -> Column:
    return F.array_distinct(F.transform(all_of(c, EMAIL), lambda x: F.lower(x)))


def phones(c: Column) -> Column:
    """Ten-digit numbers, those with a single repeated digit left out."""
    digits = F.transform(F.concat(all_of(c, PHONE_NEAR, 1), all_of(c, PHONE, 1)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    ten = F.transform(digits, lambda x: F.when((F.length(x) == 12) & x.startswith("91"), F.substring(x, 3, 10)).otherwise(x))
    return F.array_distinct(F.filter(ten, lambda x: (F.length(x) == 10) & ~x.rlike("^(0{10}|1{10}|2{10}|3{10}|4{10}|5{10}|6{10}|7{10}|8{10}|9{10})$")))


def urls(c: Column) -> Column:
    """Web addresses and bare domains, distinct in any case (the first spelling stays); blanks that readers put into them are closed, files are none, https is put before bare ones."""
    tidy = F.regexp_replace(c, r"(?i)https?\s*:\s*//\s*", "https://")
    tidy = F.regexp_replace(tidy, r"(?i)(\w+)\s*\.\s*(com|in|edu|org|net|gov|io|ai|gle)\b", "$1.$2")
    bare = F.transform(all_of(tidy, URL), lambda x: F.regexp_replace(x, r"^[.,;:\"')\[\]{}<>]+|[.,;:\"')\[\]{}<>]+$", ""))
    real = F.filter(bare, lambda x: (F.length(x) >= 4) & ~F.lower(x).rlike(rf"\.(?:{'|'.join(FILE_SUFFIXES)})$"))
    full = F.transform(real, lambda x: F.when(F.lower(x).rlike("^https?://"), x).otherwise(F.concat(F.lit("https://"), F.regexp_replace(x, r"(?i)^www\.", ""))))
    step = lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(x)), kept).otherwise(F.concat(kept, F.array(x)))
    return F.aggregate(full, F.array().cast("array<string>"), step)


def amounts(c: Column) -> Column:
    """Distinct values of at least 1 after a currency sign, then those of at least 10 after a word like fee or total, years left out."""
    number = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")
    signed = F.filter(F.transform(all_of(c, AMOUNT, 1), number), lambda v: v >= 1)
    near = F.filter(F.transform(all_of(c, AMOUNT_NEAR, 1), number), lambda v: (v >= 10) & ~v.isin(*NO_AMOUNT))
    return F.array_distinct(F.concat(signed, near))


def identifiers(c: Column) -> Column:
    """Labelled identifiers and roll numbers in upper case that hold a digit."""
    found = F.transform(F.concat(all_of(c, LABELLED_ID, 1), all_of(c, ROLL, 1)), lambda x: F.upper(x))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 3) & x.rlike("[0-9]") & ~x.rlike("^20(2[0-9]|30)$") & ~x.isin(*WEAK_IDS)))


def aadhaar(c: Column) -> Column:
    digits = F.transform(all_of(c, AADHAAR, 1), lambda x: F.regexp_replace(x, r"\s", ""))
    return F.array_distinct(F.transform(digits, lambda x: F.concat_ws(" ", F.substring(x, 1, 4), F.substring(x, 5, 4), F.substring(x, 9, 4))))


def pan(c: Column) -> Column:
    return F.array_distinct(all_of(c, PAN, 1))


def entities(c: Column) -> Column:
    """All kinds as one struct with the first date, identifier and amount."""
    d, i, a = dates(c), identifiers(c), amounts(c)
    first = lambda x: F.when(F.size(x) > 0, F.element_at(x, 1))
    parts = {"dates": d, "emails": emails(c), "phone_numbers": phones(c), "urls": urls(c), "amounts": a, "ids": i, "aadhaar_numbers": aadhaar(c), "pan_numbers": pan(c)}
    total = sum(F.size(x) for x in parts.values())
    return F.struct(*[x.alias(k) for k, x in parts.items()], total.alias("total_entities"), first(d).alias("primary_date"), first(i).alias("primary_id"), first(a).alias("primary_amount"))


def strong_identifiers(c: Column) -> Column:
    """array<struct<rel_type, value, confidence>> of identifiers fit to link records."""
    kept_mail = F.filter(emails(c), lambda x: ~F.exists(F.array(*map(F.lit, GENERIC_MAIL)), lambda p: x.startswith(p)) & (F.instr(x, "@") > 2))
    kept_phone = F.filter(phones(c), lambda x: ~F.exists(F.array(*map(F.lit, HELPLINES)), lambda p: x.startswith(p)) & (x != "1234567890"))
    kinds = (("shared_aadhaar", aadhaar(c), 1.0), ("shared_pan", pan(c), 1.0), ("shared_email", kept_mail, 0.95), ("shared_phone", kept_phone, 0.95), ("shared_id", identifiers(c), 1.0))
    return F.concat(*[F.transform(x, _tagged(k, s)) for k, x, s in kinds])


def _tagged(k: str, s: float):  # noqa: ANN202
    return lambda v: F.struct(F.lit(k).alias("rel_type"), v.alias("value"), F.lit(s).alias("confidence"))
