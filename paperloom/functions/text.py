"""Text expressions: tokens, n-grams, similarity, normal forms, sentences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that lexical search leaves out.
STOPWORDS = ("the", "a", "an", "and", "or", "for", "in", "on", "at", "to", "from", "of", "with", "is", "was", "are", "were", "by", "as", "about")
# Further words that highlighting leaves out.
MORE_STOPWORDS = ("can", "this", "that", "these", "those", "it", "its", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should", "may", "might", "must")
# Query words and the words that count as the same.
INFLECTIONS = {
    "payment": ("paid", "pay", "paying", "transfer", "transaction", "amount", "upi"),
    "paid": ("payment", "pay", "paying", "transfer", "amount"),
    "pay": ("payment", "paid", "paying", "transfer"),
    "money": ("amount", "inr", "rupees", "paid", "rs"),
    "upi": ("okaxis", "okhdfcbank", "okicici", "oksbi", "paytm", "gpay", "phonepe"),
    "qr": ("qrcode", "qr_code", "barcode"),
    "qrcode": ("qr", "qr_code", "barcode"),
    "barcode": ("qr", "qrcode", "barcode"),
    "number": ("num", "no", "id", "digits", "roll"),
    "folder": ("folders", "gallery", "vault", "photos", "documents"),
    "receipt": ("bill", "payment", "challan", "fee", "fees", "invoice"),
    "bill": ("receipt", "payment", "challan", "fee", "fees", "invoice"),
    "fingerprint": ("fingerprink", "fingerprint", "biometric"),
    "duplicate": ("doplicale", "dupe", "duplicate"),
    "hash": ("hosh", "sha256", "sha", "digest"),
    "sha": ("sha256", "hash", "hosh"),
    "sha256": ("sha", "hash", "hosh"),
    "fee": ("fees", "tuition", "challan"),
    "fees": ("fee", "tuition", "challan"),
    "kesariyo": ("kesari", "kesariy", "kesariyc", "kesario"),
    "kesari": ("kesariyo", "kesariy", "kesariyc"),
    "rang": ("ranga", "rangi"),
    "yash": ("yashlawns",),
    "lawns": ("yashlawns",),
    "avneet": ("avneet",),
    "kaur": ("kaur",),
}
WORD = r"[\p{L}\p{N}_\x{0900}-\x{097F}]+"
LEXICAL = r"[a-zA-Z0-9\x{0900}-\x{097F}]+"


def all_of(c: Column, pattern: str, group: int = 0) -> Column:
    """Every match of a pattern."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def index_tokens(c: Column) -> Column:
    """Words in lower case, in order, nothing left out."""
    return all_of(F.lower(c), WORD)


def lexical_tokens(c: Column) -> Column:
    """Words without stop words, at least two characters or a digit; percent escapes are undone."""
    plain = F.when(c.rlike("%[0-9A-Fa-f]{2}"), F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)).otherwise(c)
    words = F.transform(all_of(plain, LEXICAL), F.lower)
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS) & ((F.length(w) >= 2) | w.rlike("^[0-9]$")))


def grams(c: Column, n: int) -> Column:
    """Character n-grams, in order."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def char_set(c: Column) -> Column:
    """Distinct characters and bigrams without blanks."""
    s = F.regexp_replace(F.lower(c), r"\s+", "")
    return F.array_distinct(F.concat(grams(s, 1), grams(s, 2)))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the characters and bigrams, four decimals."""
    x, y = char_set(a), char_set(b)
    both = F.size(x) + F.size(y)
    return F.when(both > 0, F.round(2.0 * F.size(F.array_intersect(x, y)) / both, 4)).otherwise(0.0)


def subwords(word: str, least: int = 3) -> list[str]:
    """Substrings of three to five characters of a query word, and the word."""
    w = word.lower()
    parts = {w[i : i + n] for n in range(least, min(5, len(w) - 1) + 1) for i in range(len(w) - n + 1)}
    return sorted(parts | {w})


def subword_support(c: Column, query: str) -> Column:
    """Share of the query words' subwords found in the text, the mean over words of three or more characters."""
    text, ratios = F.lower(c), []
    for w in (x for x in query.lower().split() if len(x) >= 3):
        parts = subwords(w)
        ratios.append(F.when(text.contains(w), 1.0).otherwise(sum(text.contains(p).cast("int") for p in parts) / float(len(parts))))
    return F.round(sum(ratios) / float(len(ratios)), 4) if ratios else F.lit(0.0)


def glyphs(c: Column) -> Column:
    """Look-alike letters of scans made equal; the order of the steps matters."""
    s = F.translate(F.lower(c), "018", "olb")
    for seen, meant in (("rn", "m"), ("vv", "w"), ("cl", "d")):
        s = F.replace(s, F.lit(seen), F.lit(meant))
    return F.when((F.length(s) >= 4) & s.startswith("f"), F.concat(F.lit("s"), F.substring(s, 2, 1000))).otherwise(s)


def plain_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length, four decimals."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(F.round(1.0 - F.levenshtein(a, b) / longest, 4))


def sentences(c: Column, least: int = 10) -> Column:
    """Trimmed sentences of at least ``least`` characters; stops are . ! ? and line ends."""
    parts = F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\n"), r"\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def let(c: Column, f) -> Column:  # noqa: ANN001
    """``f`` of a value that is computed once; a plain reference inside a lambda would be computed at each element."""
    return F.element_at(F.transform(F.array(c), f), 1)


def windows(c: Column, size: int = 250, overlap: int = 50) -> Column:
    """Windows of ``size`` words that overlap; the last one ends with the text."""
    step = size - overlap

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(w) - overlap - 1) / step).cast("int") * step), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " "))

    return let(F.filter(F.split(c, r"\s+"), lambda x: x != ""), cut)


def sanitized(c: Column) -> Column:
    """Dangerous tags, handlers and script links removed, then HTML-escaped."""
    s = c
    for tag in ("script", "iframe", "object", "embed", "style", "link", "meta", "form"):
        s = F.regexp_replace(s, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
        s = F.regexp_replace(s, rf"(?i)</?{tag}[^>]*>", "")
    s = F.regexp_replace(s, r"(?i)\bon[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    s = F.regexp_replace(s, r"(?i)javascript:", "")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return F.trim(s)


def sql_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{WORD}')"


def sql_set(c: str) -> str:
    """SQL of :func:`char_set` for a one-word-per-row column expression."""
    s = f"regexp_replace(lower({c}), '\\s+', '', 'g')"
    return f"list_distinct(list_concat(list_transform(range(1, length({s}) + 1), lambda i: substr({s}, i, 1)), list_transform(range(1, greatest(length({s}), 1)), lambda i: substr({s}, i, 2))))"
