"""Views of single documents: reading order, snippets, phrases, invoices, boxes that hold words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.functions import entities as E, text as T

BOX = "array<struct<text:string,confidence:double,bbox:struct<x:double,y:double,width:double,height:double>>>"


def reading_order(boxes: DataFrame, by: str = "id") -> DataFrame:
    """Words of a page with their place: bands of 40 pixels from top to bottom, left to right within."""
    w = Window.partitionBy(by).orderBy(F.floor(F.col("y") / 40), "x", "token")
    return boxes.withColumn("place", F.row_number().over(w))


def exploded_boxes(images: DataFrame) -> DataFrame:
    """(id, token, x, y, w, h) of the recognised words; malformed JSON has none."""
    b = images.select("id", F.explode(F.from_json("ocr_boxes_json", BOX)).alias("b"))
    return b.select("id", F.col("b.text").alias("token"), F.col("b.bbox.x").alias("x"), F.col("b.bbox.y").alias("y"), F.col("b.bbox.width").alias("w"), F.col("b.bbox.height").alias("h"))


def tokens_in_regions(regions: DataFrame, boxes: DataFrame, pad: float = 0.1) -> DataFrame:
    """(region_id, n_tokens, bonus): words whose centre lies in the padded region of the same image; bonus min(.25, .15 n)."""
    r = regions.select(F.col("id").alias("region_id"), F.col("image_id").alias("id"), *[F.col(c).alias(f"r{c}") for c in "xywh"])
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    inside = cx.between(F.col("rx") - F.col("rw") * pad, F.col("rx") + F.col("rw") * (1 + pad)) & cy.between(F.col("ry") - F.col("rh") * pad, F.col("ry") + F.col("rh") * (1 + pad))
    n = r.join(boxes, "id").where(inside).groupBy("region_id").agg(F.count("*").alias("n_tokens"))
    return n.select("region_id", "n_tokens", F.least(F.lit(0.25), F.col("n_tokens") * 0.15).alias("bonus"))


def grounded(boxes: DataFrame, answer: DataFrame) -> DataFrame:
    """(id, x0, y0, x1, y1): the box around the words of an image that its answer (id, answer) holds."""
    hit = F.lower("answer").contains(F.lower("token")) & (F.length("token") > 0)
    j = boxes.join(answer, "id").where(hit)
    return j.groupBy("id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))


def marked(c: Column, phrase: str, before: int = 60, after: int = 120) -> Column:
    """A snippet around the first hit, every hit in <mark>; null without a hit."""
    at = F.instr(F.lower(c), phrase.lower())
    start = F.greatest(F.lit(1), at - before)
    cut = F.substring(c, start, at - start + F.lit(len(phrase) + after))
    return F.when(at > 0, F.regexp_replace(cut, f"(?i)({phrase})", "<mark>$1</mark>"))


def best_sentence(c: Column, words: tuple[str, ...]) -> Column:
    """First sentence with all words, else with any, cut at 200 characters; null without."""
    s = T.sentences(c, 15)
    having = lambda x, n: sum(F.lower(x).contains(w).cast("int") for w in words) >= n
    full, some = F.filter(s, lambda x: having(x, len(words))), F.filter(s, lambda x: having(x, 1))
    return F.substring(F.coalesce(F.try_element_at(full, F.lit(1)), F.try_element_at(some, F.lit(1))), 1, 200)


def candidate_phrases(c: Column, most: int = 3) -> Column:
    """Distinct phrases of one to ``most`` words without stop words at their ends."""
    stop = F.array(*map(F.lit, T.STOPWORDS + T.MORE_STOPWORDS))

    def runs(w: Column) -> Column:
        of = lambda n: F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.slice(w, i, F.lit(n)))
        return F.concat(*[of(n) for n in range(1, most + 1)])

    words = F.transform(T.all_of(c, "[A-Za-z][A-Za-z0-9]+"), lambda x: F.lower(x))
    kept = F.filter(T.let(words, runs), lambda p: ~F.array_contains(stop, F.element_at(p, 1)) & ~F.array_contains(stop, F.element_at(p, -1)))
    return F.array_distinct(F.transform(kept, lambda p: F.array_join(p, " ")))


# Patterns of payment modes, totals and taxes of an invoice.
PAYMENT_MODES = (("UPI / QR", r"(?i)\b(?:upi|gpay|phonepe|paytm|bhim|qr)\b"), ("CARD", r"(?i)\b(?:card|visa|mastercard|debit|credit)\b"), ("CASH", r"(?i)\b(?:cash|cod)\b"), ("BANK_TRANSFER / CHALLAN", r"(?i)\b(?:netbank|neft|rtgs|imps|challan)\b"))
MONEY = r"[:\s]*[₹$Rs.]*\s*([\d,]+\.?\d*)"
GRAND_TOTAL, TOTAL = r"(?i)(?:grand\s*total|net\s*payable|total\s*payable|amount\s*paid)" + MONEY, r"(?i)(?:total\s*amount|\btotal\b)" + MONEY


def invoice(c: Column) -> Column:
    """Payment mode, grand total, taxes and their sum; what is missing is 0, the mode UNKNOWN."""
    mode = F.coalesce(*[F.when(c.rlike(p), F.lit(name)) for name, p in PAYMENT_MODES], F.lit("UNKNOWN"))
    number = lambda p: F.replace(F.regexp_extract(c, p, 1), F.lit(","), F.lit("")).try_cast("double")
    tax = {t: F.coalesce(number(f"(?i){t}{MONEY}"), F.lit(0.0)) for t in ("cgst", "sgst", "igst")}
    total = F.coalesce(F.when(c.rlike(GRAND_TOTAL), number(GRAND_TOTAL)).otherwise(number(TOTAL)), F.lit(0.0))
    return F.struct(mode.alias("mode"), total.alias("total"), *[v.alias(t) for t, v in tax.items()], F.round(sum(tax.values()), 2).alias("total_tax"))


def links_of(image_id: int, images: DataFrame) -> DataFrame:
    """(id, value): visible rows of the same tenant that share an identifier with one row, itself left out."""
    ids = images.where("not coalesce(is_quarantined, false)").select("user_id", "id", F.explode(E.strong_identifiers(F.col("extracted_text"))).alias("s")).select("user_id", "id", F.upper("s.value").alias("value"))
    own = ids.where(F.col("id") == image_id).select("user_id", "value").distinct()
    return ids.where(F.col("id") != image_id).join(own, ["user_id", "value"], "left_semi").select("id", "value").distinct()
