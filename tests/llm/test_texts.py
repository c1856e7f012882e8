"""Problems 2, 5, 7, 8, 9 and 10 on small inputs."""

import os

import numpy as np
import pandas as pd
import pytest

from paperloom.llm import abuse, language, packing, privacy, scans, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{tokens.FOLDER}/{tokens.VOCABULARY}"), reason="no vocabulary")
ODD = ["", " ", "don't  stop\n\n\tnow 12345", "नमस्ते दुनिया", "<|endoftext|> is text", "a" * 3000, "😀‍😀 é­", "x\x00y", "  lead"]


@needs_vocabulary
def test_encoding_equals_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    v = tokens.vocabulary()
    for text in ODD:
        ids = v.encode(text)
        assert ids == t.encode(text, add_special_tokens=False).ids and v.decode(ids) == text
    assert v.encode(None) == []


@needs_vocabulary
def test_encoding_frame(spark):
    rows = spark.createDataFrame([(1, "two words", "z"), (2, None, "z"), (3, "", "z"), (1, "two words", "z")], "doc_id long, text string, ids string")
    got = tokens.encoded(rows)
    assert got.columns == ["doc_id", "ids"] and sorted(len(r.ids) for r in got.collect()) == [0, 0, 2, 2]
    assert tokens.decoded(got).where("text = 'two words'").count() == 2
    assert tokens.encoded(rows.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_fills(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.geometric(0.01, 2000), 512)
    got = packing.pack(sizes, 512)
    assert sorted(s for c in got for s in c) == sorted(sizes) and max(map(sum, got)) <= 512
    assert len(got) <= 1.02 * sizes.sum() / 512 + 1


def test_packing_frame(spark):
    items = spark.createDataFrame([(1, 1300), (2, 512), (3, 0), (4, None), (5, 100), (6, 300), (7, 200)], "item_id long, n_tokens int")
    caps = spark.createDataFrame([(1, "s", 512), (1, "s", 512), (2, "none", None), (3, "zero", 0)], "capacity_id long, capacity_name string, capacity_tokens int")
    rows = packing.packed(items, caps).collect()
    assert {r.item_id for r in rows} == {1, 2, 3, 4, 5, 6, 7}
    fill = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 512 and sum(fill.values()) == 1300 + 512 + 600
    assert [r.n_tokens for r in sorted((r for r in rows if r.item_id == 1), key=lambda r: r.piece)] == [512, 512, 276]
    assert packing.packed(items.limit(0), caps).count() == 0 and packing.packed(items, caps.limit(0)).count() == 0


SAMPLES = [("The shop will remain shut on the public holiday.", "en"), ("La tienda estará cerrada mañana.", "es"), ("Le magasin sera fermé demain.", "fr"), ("Der Laden bleibt morgen geschlossen.", "de"), ("दुकान कल बंद रहेगी।", "hi"), ("दुकान उद्या बंद राहील.", "mr"), ("Dukaan kal band rahegi, parchi sambhal kar rakhein.", "hi")]


def test_language_labels(spark):
    samples = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(SAMPLES)], "sample_id long, text string, lang string")
    rows = [(1, SAMPLES[1][0], "en"), (2, SAMPLES[1][0], "spa"), (3, SAMPLES[4][0], None), (4, f"{SAMPLES[0][0]}\n{SAMPLES[3][0]}", "en"), (5, "Name: Jo Li\n12345", None), (6, None, "en"), (7, "", "xx"), (8, "-", None)]
    images = spark.createDataFrame([(*r, "x") for r in rows], "id long, extracted_text string, ocr_lang string, label string")
    got = {(r.image_id, r.lang) for r in language.wrong_labels(images, samples).collect()}
    assert got == {(1, "es"), (3, "hi"), (4, "en"), (4, "de")}
    segs = language.text_segments(images, language.model_of(images, samples)).where("id = 4").orderBy("seg_no").collect()
    assert [s.lang for s in segs] == ["en", "de"] and segs[0].start_pos == 0 and 0 < segs[0].confidence <= 1
    assert language.wrong_labels(images.limit(0), samples).count() == 0


def test_long_text_language():
    text = " ".join(t for t, _ in SAMPLES[:1] * 5000)
    nothing = pd.DataFrame({"lang": [], "script": [], "sentence": [], "n": []})
    model = language.Classifier(language.dictionaries(nothing, pd.DataFrame(SAMPLES, columns=["text", "lang"])))
    assert [s[2] for s in language.segments(model, text)] == ["en"]


BODY = "The records room will collect the pending instalment for the current session. The landlord must return the original documents without further notice. The committee has received the inspection schedule together with the corrected certificate."


def page(n):
    return f"Annual Report of Zanon University\nThe records room will collect the pend-\ning instalment for the current session.\nThe 1andlord must return the original documents\nwithout a self-\nattested copy.\n- {n} -"


def test_scan_defects(spark):
    rows = [(1, "\n".join(page(n) for n in (1, 2, 3)), None), (2, None, BODY), (3, "", BODY), (4, None, None), (5, " ", ""), (6, "x" * 50_000, None)] + [(10 + i, None, BODY + " A self-attested copy was left.") for i in range(60)]
    images = spark.createDataFrame([(*r, "x") for r in rows], "id long, original_ocr_text string, extracted_text string, line_no string")
    got = {(r.image_id, r.line_no, r.defect) for r in scans.scan_defects(images).collect()}
    assert got == {(1, 7 * p + n, d) for p in range(3) for n, d in ((0, "running"), (1, "hyphen"), (3, "chars"), (6, "page_number"))}
    text = {r.image_id: r.text for r in scans.repaired_texts(images).collect()}
    assert "pending instalment" in text[1] and "landlord" in text[1] and "Annual" not in text[1] and "- 2 -" not in text[1]
    assert scans.scan_defects(images.limit(0)).count() == 0


def test_automaton_is_complete():
    words = ["cat", "cart", "art", "chat", "dog", "coat", "c", ""]

    def lev(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(now[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    trie = scans.Trie(words)
    for q in ("cat", "crat", "dg", "", "coats"):
        for k in (0, 1, 2):
            assert dict(scans.within(trie, q, k)) == {w: lev(q, w) for w in words if lev(q, w) <= k}


TEXT = "Patient: Asha Rane  Age: 31\nWrite to asha.rane+x@mail.example or a_r [at] post [dot] test. Call +91 98765 43210 before delivery. Aadhaar No. 4321 8765 1234. Resident of Flat 12B, Lake Heights, Hill Road, Pune 411001. UTR 123456789012 was paid to shop@upi. Follow Asha Motors @ Pune for updates."


def test_private_values(spark):
    images = spark.createDataFrame([(1, TEXT, "k"), (2, None, "k"), (3, "", "k"), (4, "nothing here", "k"), (5, "word " * 20_000, "k")], "id long, extracted_text string, kind string")
    meta = spark.createDataFrame([("007", "Dear Asha, your request is being processed."), (None, "x"), ("007", "Dear Asha, your request is being processed.")], "image_id string, expected_text string")
    parts = spark.createDataFrame([("Asha", "given"), ("Rane", "family"), (None, "given"), ("Asha", "given")], "name_part string, part_kind string")
    got = {(r.src, r.row_key, r.kind, r.start_pos) for r in privacy.protected_values(images, meta, parts).collect()}
    at = TEXT.index
    want = {("name", at("Asha Rane")), ("email", at("asha.rane")), ("email", at("a_r [at]")), ("phone", at("+91")), ("identity", at("4321 8765")), ("address", at("Flat"))}
    assert {("images", "1", k, p) for k, p in want} | {("metadata", "007", "name", 5)} == got
    clean = {(r.src, r.row_key): r.text for r in privacy.sanitised(images, meta, parts).collect()}
    assert "[NAME]" in clean["images", "1"] and "Rane" not in clean["images", "1"] and "UTR 123456789012" in clean["images", "1"] and "Age: 31" in clean["images", "1"]
    assert privacy.protected_values(images.limit(0), meta.limit(0), parts).count() == 0


def test_content_kinds(spark):
    bad = ["you are a worthless idiot", "shut up you stupid moron", "you useless clown get lost"]
    docs = [(i, f"The office opens at ten on day {i}. {bad[i % 3] if i % 4 == 0 else 'Please bring the receipt'}. The lift is under repair.", "a" if i % 2 else None, "k") for i in range(80)]
    docs += [(100, None, "a", "k"), (101, "", "a", "k"), (102, "ok " * 20_000, "b", "k"), (103, "y o u  are a w0rthless idi0t", "b", "k")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string, kinds string")
    labels = spark.createDataFrame([(i, "r1", "ABUSIVE " if i % 4 == 0 else "none") for i in range(60)] + [(3, "r1", "none"), (5, None, None), (None, "r", "none"), (7, "r2", "odd")], "doc_id long, rater string, label string")
    got = {(r.doc_id, r.kind) for r in abuse.content_kinds(documents, labels).collect()}
    assert {(i, "abusive") for i in range(60, 80) if i % 4 == 0} <= got and (103, "abusive") in got
    assert not {i for i, _ in got} & {61, 62, 63, 100, 101, 102}
    rates = {r.source: r.n_docs for r in abuse.rates(documents, labels).collect()}
    assert rates[None] == 40 and rates["b"] == 2
    assert abuse.content_kinds(documents.limit(0), labels.limit(0)).count() == 0
