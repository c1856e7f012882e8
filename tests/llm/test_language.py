"""Problem 7: the choice of reference sentences at two sizes."""

import random

from paperloom.llm import language

SAMPLES = [("The shop will remain shut on the public holiday.", "en"), ("La tienda estará cerrada mañana.", "es"), ("Le magasin sera fermé demain.", "fr"), ("Der Laden bleibt morgen geschlossen.", "de")]
PARTS = {
    "en": (("the clerk", "our office", "a second officer"), ("has received", "will publish", "could not find"), ("the old ledger", "a signed copy", "the inspection plan"), ("by registered post", "before the end of the month", "at the counter")),
    "es": (("la oficina", "el vecino", "la tesorera"), ("debe presentar", "todavía no ha recibido", "conserva por ahora"), ("la póliza del seguro", "el contrato de alquiler", "dos fotografías"), ("en la ventanilla", "antes del lunes", "por correo")),
    "fr": (("le bureau", "la voisine", "notre service"), ("doit remettre", "n'a pas encore reçu", "garde pour le moment"), ("le contrat de bail", "la police d'assurance", "deux photos"), ("au guichet", "avant lundi", "par la poste")),
    "de": (("der verein", "die nachbarin", "unser amt"), ("muss vorlegen", "hat noch nicht erhalten", "verwahrt zurzeit"), ("den vertrag", "die police", "zwei bilder"), ("am schalter", "bis zum montag", "mit der post")),
}


def _text(rng, lang):
    return " ".join(" ".join(rng.choice(p) for p in PARTS[lang]).capitalize() + "." for _ in range(rng.randint(2, 5)))


def _corpus(n, seed):
    """Texts with a fifth of the labels wrong, drawn anew for every text; one wrong English text is copied often."""
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choices(("en", "es", "fr", "de"), (70, 10, 10, 10))[0]
        label = rng.choice(("en", "es", "fr", "de", "hi", "mr")) if rng.random() < 0.2 else lang
        out.append((i, _text(rng, lang), label))
    return out + [(n + i, "Our office will publish a signed copy though the lift is shut.", "mr") for i in range(n // 20)]


def test_same_verdicts_at_ten_times_the_size(spark):
    samples = spark.createDataFrame([(i, *s) for i, s in enumerate(SAMPLES)], "sample_id long, text string, lang string")
    rng = random.Random(7)
    probes = [(1_000_000 + i, _text(rng, x), None if i % 2 else "en") for i, x in enumerate(sorted(PARTS) * 15)] + [(2_000_000 + i, f"{_text(rng, 'en')}\n{_text(rng, x)}", "en") for i, x in enumerate(("de", "es", "fr") * 5)]
    truth = {(p[0], x) for p, x in zip(probes, sorted(PARTS) * 15) if p[2] != x} | {(2_000_000 + i, y) for i, x in enumerate(("de", "es", "fr") * 5) for y in ("en", x)}
    got = []
    for n in (1200, 12000):
        images = spark.createDataFrame(_corpus(n, n) + probes, "id long, extracted_text string, ocr_lang string")
        got.append({(r.image_id, r.lang) for r in language.wrong_labels(images, samples).where("image_id >= 1000000").collect()})
        classes = {(r.lang, r.script) for r in language.reference_sentences(images).select("lang", "script").distinct().collect()}
        assert classes <= {(x, "L") for x in PARTS}
    assert got[0] == got[1] == truth


def test_copies_of_a_wrong_label_are_no_evidence(spark):
    rows = [(i, "Our office will publish a signed copy.", "de") for i in range(500)] + [(1000 + i, f"{_text(random.Random(i), 'en')}", "en") for i in range(60)]
    images = spark.createDataFrame(rows, "id long, extracted_text string, ocr_lang string")
    assert {r.lang for r in language.reference_sentences(images).collect()} == {"en"}
    assert language.reference_sentences(images.limit(0)).count() == 0


def test_word_pairs_leave_out_names_and_numbers():
    assert language.word_pairs("The bill of Ram Singh for 0 units is due.") == ["bill of", "is due.", "the bill", "units is"]
    assert language.word_pairs("") == []
