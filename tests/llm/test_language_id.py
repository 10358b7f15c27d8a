import math
import zlib

import numpy as np

from quarrylens.llm import language_id as N

from ..conftest import SF


def test_accuracy_on_rows_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in N.identify_languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(truth)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_features_against_brute_force():
    text, n = "Ab1cé  d_e xyzw", (2, 3, 4)
    words = ["ab", "cé", "d", "e", "xyzw"]
    grams = []
    for w in words:
        marked = f" {w} "
        grams += [marked[i : i + k] for k in n for i in range(len(marked) - k + 1)]

    def bucket(g):
        code = 0
        for c in g:
            code = (code * int(N._STEP) + ord(c) + 1) % (1 << 64)
        return ((code ^ code >> 30) * int(N._MIX) % (1 << 64)) >> 49

    assert sorted(np.concatenate(list(N.features(text, 1 << 15, n))).tolist()) == sorted(map(bucket, grams))


def test_long_texts_in_slices(monkeypatch):
    text = "some words and more of them " * 50
    whole = np.sort(np.concatenate(list(N.features(text))))
    monkeypatch.setattr(N, "_SLICE", 37)
    assert (np.sort(np.concatenate(list(N.features(text)))) == whole).all()


def test_defined_cases(spark):
    schema = "doc_id long, text string, lang string, held_out string, score int"
    rows = [(i, t, lang, "", 0) for i in range(60) for t, lang in [("the cat and the dog", "en")] if i % 2] + [(i, "le chat et la souris", "fr", "", 0) for i in range(0, 60, 2)]
    rows += [(100, None, "en", "", 0), (101, "12 ?!", "en", "", 0), (102, "", None, "", 0), (None, "the dog", "en", "", 0), (103, "le " * 60_000, None, "", 0), (1, "the cat", "en", "", 0)]
    got = N.identify_languages(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "en" and not by[None].held_out and by[103].lang_pred == "fr" and by[1].lang_pred == "en"
    none = N.identify_languages(spark.createDataFrame([(1, "words", None, "", 0)], schema)).first()
    assert (none.lang_pred, none.accepted) == ("und", False)
    assert N.identify_languages(spark.createDataFrame([], schema)).count() == 0


def test_rejection_is_calibrated():
    rows = [("the cat and dog " + "abcdefgh"[i % 8], "en") for i in range(100)] + [("le chat et chien " + "abcdefgh"[i % 8], "fr") for i in range(100)]
    model = N.fit(rows)
    assert model.predict("the dog and cat") == model.predict("the dog and cat") and model.predict("the dog and cat")[0] == "en"
    assert model.predict("le chien et chat")[2] and 0 <= model.limit <= 1


def test_numerals_are_no_letters():
    model = N.fit([("plain words here", "a"), ("autres mots encore", "b")] * 5)
    for text in ("½ ² ①", "Ⅷ 12 _", "...", ""):
        assert model.predict(text)[0] == N.UNKNOWN
    assert model.predict("½ x")[0] != N.UNKNOWN and model.predict("字")[0] != N.UNKNOWN


def test_long_texts_are_learnt_from_in_part(spark):
    docs = spark.createDataFrame([(i, "lange worte " * 3000 if i % 2 else "short words " * 9, "de" if i % 2 else "en") for i in range(60)], "doc_id long, text string, lang string")
    rows = N.training_rows(docs, id_col="doc_id", text_col="text", lang_col="lang")
    assert {lang for _, lang in rows} == {"de", "en"} and max(len(t) for t, _ in rows) == N.LONGEST


def plainly(model, text):
    """Logits of a text: means over its n-grams, one by one."""
    sums, count = [0.0] * len(model.languages), 0
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        marked = f" {word} "
        for k in model.grams:
            for i in range(len(marked) - k + 1):
                code = 0
                for c in marked[i : i + k]:
                    code = (code * int(N._STEP) + ord(c) + 1) % (1 << 64)
                bucket = ((code ^ code >> 30) * int(N._MIX) % (1 << 64)) >> (64 - (model.buckets - 1).bit_length())
                sums = [s + float(x) for s, x in zip(sums, model.table[bucket])]
                count += 1
    return [s / max(1, count) + float(b) for s, b in zip(sums, model.bias)]


def softmax(logits, heat):
    top = max(x / heat for x in logits)
    e = [math.exp(x / heat - top) for x in logits]
    return [x / sum(e) for x in e]


def test_predictions_and_calibration_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = N.training_rows(docs, id_col="doc_id", text_col="text", lang_col="lang")
    model = N.fit(rows)
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + ["Das ist gut", "the and of", "½ 12", "", "zzz qqq xxyyzz"]
    for text in texts:
        lang, score, accepted = model.predict(text)
        if not any(c.isalpha() for c in text or ""):
            assert (lang, score, accepted) == ("und", 0.0, False)
            continue
        p = softmax(plainly(model, text), model.temperature)
        assert abs(max(p) - score) < 1e-6 and abs(p[model.languages.index(lang)] - max(p)) < 1e-6 and (accepted == (score >= model.limit))
    # what is held back of the sample, found again by the same draws, gives the temperature and the limit
    rng = np.random.default_rng(N.SEED)
    rng.uniform(size=(N.BUCKETS, N.DIM))
    sample = [(text, lang) for text, lang in rows if any(c.isalpha() for c in text)]
    rng.shuffle(sample)
    held = [(plainly(model, text), model.languages.index(lang)) for text, lang in sample[::5]]
    loss = {heat: -sum(math.log(softmax(x, heat)[y] + 1e-12) for x, y in held) / len(held) for heat in np.geomspace(0.05, 20, 60)}
    assert abs(loss[min(loss, key=loss.get)] - loss[min(loss, key=lambda h: abs(h - model.temperature))]) < 1e-6
    scored = sorted(((max(p), p.index(max(p)) == y) for x, y in held for p in [softmax(x, model.temperature)]), key=lambda x: -x[0])
    right, limit = 0, 1.0
    for n, (score, good) in enumerate(scored, 1):
        right += good
        if right / n >= N.TARGET_ACCURACY:
            limit = score
    assert abs(limit - model.limit) < 1e-6
