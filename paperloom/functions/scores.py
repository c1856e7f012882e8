"""Score expressions: vectors, boxes, geography, fusion, entropy, payloads, file formats."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Hubs with latitude and longitude.
HUBS = (("pune", 18.5204, 73.8567), ("mumbai", 19.0760, 72.8777), ("delhi", 28.7041, 77.1025), ("bangalore", 12.9716, 77.5946), ("bengaluru", 12.9716, 77.5946), ("hyderabad", 17.3850, 78.4867), ("chennai", 13.0827, 80.2707), ("kolkata", 22.5726, 88.3639), ("nagpur", 21.1458, 79.0882), ("nashik", 19.9975, 73.7898), ("aurangabad", 19.8762, 75.3433))
# Weights of the six signals.
SIGNALS = (("ocr", 0.35), ("semantic", 0.25), ("blip", 0.15), ("qr", 0.10), ("visual", 0.10), ("stego", 0.05))
# Weights for keyword queries and for sentences, and of the tamper penalty.
KEYWORD_WEIGHTS = {"ocr": 0.45, "semantic": 0.20, "blip": 0.10, "qr": 0.15, "stego": 0.05, "tamper": 0.05}
SENTENCE_WEIGHTS = {"ocr": 0.25, "semantic": 0.35, "blip": 0.25, "qr": 0.10, "stego": 0.03, "tamper": 0.02}
# First bytes of file formats, in hexadecimal.
SIGNATURES = (("255044462D", "pdf"), ("FFD8FF", "jpg"), ("89504E470D0A1A0A", "png"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("52494646", "webp"), ("504B0304", "zip_archive"), ("D0CF11E0A1B11AE1", "ole_doc"))
# Payment handle suffixes and their providers.
PROVIDERS = {"ybl": "PhonePe", "ibl": "PhonePe", "axl": "PhonePe", "okhdfcbank": "Google Pay", "okaxis": "Google Pay", "oksbi": "Google Pay", "okicici": "Google Pay", "paytm": "Paytm", "ptaxis": "Paytm", "pthdfc": "Paytm", "ptyes": "Paytm", "upi": "BHIM", "apl": "Amazon Pay", "yapl": "Amazon Pay", "axisb": "Cred", "cred": "Cred", "bharatpe": "BharatPe", "postbank": "India Post Payments Bank"}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes, 64 if one is none."""
    half = lambda c, i: F.conv(F.substring(c, i, 8), 16, 10).cast("long")
    good = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    bits = sum(F.bit_count(half(a, i).bitwiseXOR(half(b, i))) for i in (1, 9))
    return F.when(good, bits).otherwise(64)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere of radius 6371, two decimals."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.round(2 * 6371.0 * F.asin(F.sqrt(h)), 2)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def hybrid(**signals: Column) -> Column:
    """Weighted sum of the six signals, each clamped."""
    return F.round(sum(clamp(signals[k]) * w for k, w in SIGNALS if k in signals), 4)


def query_entropy(query: str) -> float:
    """Entropy of the characters of a query in bits, three decimals."""
    q = query.lower().strip()
    return round(-sum(n / len(q) * math.log2(n / len(q)) for n in (q.count(c) for c in set(q))), 3) if q else 0.0


def entropy(c: Column) -> Column:
    """Entropy of the characters of a text in bits, three decimals."""
    chars = F.split(F.lower(c), "")
    kinds = F.array_distinct(chars)
    share = lambda k: F.size(F.filter(chars, lambda x: x == k)) / F.size(chars)
    return F.round(F.aggregate(F.transform(kinds, lambda k: -share(k) * F.log2(share(k))), F.lit(0.0), lambda s, x: s + x), 3)


def entropy_fused(query: str, tamper: Column, **signals: Column) -> Column:
    """Signals weighted by the query's entropy, less a penalty for tampering."""
    w = KEYWORD_WEIGHTS if len(query.split()) <= 2 or query_entropy(query) < 2.5 else SENTENCE_WEIGHTS
    raw = sum(signals[k] * w[k] for k in signals)
    return F.round(clamp(raw - w["tamper"] * F.greatest(F.lit(0.0), tamper - 0.5)), 4)


def power_grid(text: Column, weights: Column, heat: Column) -> Column:
    """Logistic filter score x .5 + text x .3 + heat x .2."""
    return F.round(0.5 / (1.0 + F.exp(-weights)) + 0.3 * text + 0.2 * heat, 4)


def geometric(text: Column, filters: Column, attention: Column, a: float = 0.5, b: float = 0.25, c: float = 0.25) -> Column:
    """Weighted geometric product with a floor of .001."""
    low = F.lit(0.001)
    return F.round(F.pow(F.greatest(text, low), a) * F.pow(F.greatest(filters, low), b) * F.pow(F.greatest(attention, low), c), 4)


def visual_norm(raw: Column) -> Column:
    """Raw visual similarity on the scale of text scores."""
    return F.when(raw <= 0.18, F.greatest(F.lit(0.1), raw)).otherwise(clamp(0.45 + (raw - 0.18) * 0.5 / 0.14, 0.40, 0.98))


def pad_box(x0: Column, y0: Column, x1: Column, y1: Column, share: float = 0.1, digits: int = 4) -> tuple[Column, ...]:
    """A normalised box widened on every side, within 0..1."""
    dx, dy = (x1 - x0) * share, (y1 - y0) * share
    return tuple(F.round(clamp(v), digits) for v in (x0 - dx, y0 - dy, x1 + dx, y1 + dy))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes (x, y, width, height)."""
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return F.when(union > 0, F.round(w * h / union, 4)).otherwise(0.0)


def place_name(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Label of a normalised box on a 3 x 3 grid."""
    cx, cy = x + w / 2, y + h / 2
    across = F.when(cx < 0.35, "Left").when(cx > 0.65, "Right").otherwise("Center")
    down = F.when(cy < 0.35, "Top").when(cy > 0.65, "Bottom").otherwise("Middle")
    return F.when((w >= 0.85) & (h >= 0.85), "Full Document").when((across == "Center") & (down == "Middle"), "Center").otherwise(F.concat_ws("-", down, across))


def sniffed_format(content: Column, name: Column) -> Column:
    """File format from the first bytes, else from the name's suffix."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    for sign, kind in reversed(SIGNATURES):
        hit = head.startswith(sign)
        if kind == "webp":
            hit = hit & (F.substring(head, 17, 8) == "57454250")
        if kind == "zip_archive":
            out = F.when(hit, F.when(F.lower(name).rlike(r"\.(docx|xlsx|pptx)$"), F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))).otherwise(kind)).otherwise(out)
        else:
            out = F.when(hit, kind).otherwise(out)
    return out


def payload_fields(c: Column) -> Column:
    """Kind, handle, payee, amount, provider and host of a QR payload; no name is invented."""
    low = F.lower(c)
    param = lambda k: F.nullif(F.regexp_extract(c, rf"[?&]{k}=([^&]*)", 1), F.lit(""))
    suffix = F.regexp_extract(F.lower(param("pa")), "@([a-z]+)$", 1)
    provider = F.lit(None).cast("string")
    for s, p in PROVIDERS.items():
        provider = F.when(suffix == s, p).otherwise(provider)
    kind = F.when(low.startswith("upi://"), "upi").when(low.rlike("^https?://"), "url").when(low.startswith("begin:vcard") | low.startswith("mecard:"), "contact").otherwise("text")
    return F.struct(kind.alias("kind"), param("pa").alias("handle"), F.try_url_decode(param("pn")).alias("payee"), F.try_to_number(param("am"), F.lit("999999999999.99")).cast("double").alias("amount"), provider.alias("provider"), F.nullif(F.regexp_extract(c, "(?i)^https?://([^/?#]+)", 1), F.lit("")).alias("host"))


def tag_length_values(payload: str) -> dict[str, str]:
    """Fields of a tag-length-value payload; templates 26 to 51 are opened, keys joined by a dot."""
    out: dict[str, str] = {}
    stack = [("", payload or "")]
    while stack:
        prefix, s = stack.pop()
        while len(s) >= 4 and s[:4].isdigit():
            tag, size = s[:2], int(s[2:4])
            value, s = s[4 : 4 + size], s[4 + size :]
            if len(value) < size:
                break
            out[prefix + tag] = value
            if not prefix and 26 <= int(tag) <= 51:
                stack.append((tag + ".", value))
    return out


def page_metadata(html: Column) -> Column:
    """Title, description and first heading of a page."""
    tidy = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, p, 1), "<[^>]+>", ""), r"\s+", " "))
    return F.struct(tidy(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), tidy(r"(?is)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']*)").alias("description"), tidy(r"(?is)<h1[^>]*>(.*?)</h1>").alias("h1"))


def non_overlapping(spans: Column) -> Column:
    """Spans (start, end) kept greedily in order of their start; a fold over the sorted array."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda kept, s: F.when(F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0)) <= s["start"], F.concat(kept, F.array(s))).otherwise(kept)
    return F.aggregate(F.sort_array(spans), empty, step)
