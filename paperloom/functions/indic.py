"""Bilingual terms: texts in Devanagari gain English terms, English queries gain Devanagari ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Devanagari terms with their English terms.
TERMS = {
    "पुणे": "pune", "मुंबई": "mumbai", "महाराष्ट्र": "maharashtra", "उस्मानाबाद": "osmanabad", "धाराशिव": "dharashiv", "सोलापूर": "solapur", "नागपूर": "nagpur", "नाशिक": "nashik", "औरंगाबाद": "aurangabad", "संभाजीनगर": "sambhajinagar", "भारत": "india",
    "बस": "bus", "तिकीट": "ticket", "प्रवासी": "passenger", "चालक": "driver", "ड्रायव्हर": "driver", "मार्ग": "route", "पिकअप": "pickup", "स्थानक": "station", "ठिकाण": "location", "गाडी": "vehicle / bus",
    "छात्रवृत्ति": "scholarship", "शिष्यवृत्ती": "scholarship", "प्रवेश": "admission", "परीक्षा": "examination / exam", "हॉल टिकट": "hall ticket / admit card", "प्रवेश पत्र": "admit card", "अंकपत्र": "marksheet / grade card", "गुणपत्रक": "marksheet", "प्रमाणपत्र": "certificate", "शुल्क": "fees / fee", "पावती": "receipt", "रसीद": "receipt", "चालान": "challan", "विद्यार्थी": "student", "महाविद्यालय": "college", "विद्यापीठ": "university", "सूचना": "notice / announcement", "वेळापत्रक": "timetable / schedule", "समय सारणी": "timetable", "विभाग": "department", "अभियांत्रिकी": "engineering", "तंत्रज्ञान": "technology", "पदवी": "degree", "नियमित": "regular", "निकाल": "result", "हजेरी": "attendance", "वसतिगृह": "hostel", "ग्रंथालय": "library",
    "आधार": "aadhaar", "ओळखपत्र": "identity card / id", "पैन": "pan card", "जन्म तारीख": "date of birth", "पत्ता": "address", "नाव": "name", "रक्कम": "amount", "एकूण": "total", "दिनांक": "date", "तारीख": "date", "वेळ": "time", "वर्ष": "year", "महिना": "month", "क्रमांक": "number / no", "नंबर": "number", "भ्रमणध्वनी": "mobile / phone", "दूरध्वनी": "telephone / phone", "मोबाईल": "mobile", "स्वाक्षरी": "signature / sign", "सही": "signature / sign", "शिक्का": "stamp / seal", "मुद्रा": "seal", "वय": "age", "लिंग": "gender",
    "बँक": "bank", "खाते": "account", "शाखा": "branch", "देयक": "bill / invoice", "अर्ज": "application", "शासन": "government", "शासकीय": "government", "रद्द": "cancelled", "यशस्वी": "successful",
}


def english_terms(c: Column) -> Column:
    """Distinct English terms of the Devanagari terms in a text, in the order of the table."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in TERMS.items()])
    return F.array_distinct(F.transform(F.filter(table, lambda t: c.contains(t["k"])), lambda t: t["v"]))


def translated(c: Column) -> Column:
    """The text with the English terms appended."""
    terms = english_terms(c)
    return F.when(F.size(terms) > 0, F.concat_ws(" ", c, F.array_join(terms, " "))).otherwise(c)


def expansions(query: str) -> list[str]:
    """The query and its words in the other script (plan time)."""
    out = [query]
    for k, v in TERMS.items():
        words = re.split(r"[\s/]+", v)
        out += [x for x in ([v] if k in query else []) + ([k] if any(w in query.lower().split() for w in words) else []) if x not in out]
    return out
