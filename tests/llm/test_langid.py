import random

import pytest
from pyspark.sql import functions as F

from methyloom.llm import langid
from methyloom.session import table


@pytest.fixture(scope="module")
def samples(sf, spark):
    return [tuple(r) for r in table(spark, sf, "lang_samples").select("lang", "sample_text").collect()]


@pytest.fixture(scope="module")
def model(samples):
    return langid.TextModel(samples)


@pytest.fixture(scope="module")
def names(sf, spark):
    return langid.language_names(table(spark, sf, "lang_codes"))


def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, raw_bytes binary, headers string, passages string"
    return spark.createDataFrame([(*r, None)[:7] if len(r) == 6 else (*r, "h.example", None, None, None)[:7] for r in rows], schema)


def test_held_out_accuracy(samples):
    by = {}
    for lang, text in samples:
        by.setdefault(lang, []).append(text)
    train = [(lang, t) for lang, ts in by.items() for t in ts[::2]]
    test = [(lang, t) for lang, ts in by.items() for t in ts[1::2]]
    held = langid.TextModel(train)
    reader = langid.Reader(held)
    right = sum(held.languages[reader.passages(t)[3].sum(axis=0).argmax()] == lang for lang, t in test)
    assert right / len(test) >= 0.98


def test_garbled_text_keeps_its_language(samples, model):
    reader, right, n = langid.Reader(model), 0, 0
    for lang, text in samples:
        if lang in ("ru", "uk", "pt", "sv", "tr"):
            n += 1
            garbled = text.encode("utf-8").decode("cp1252", "replace")
            right += model.languages[reader.passages(garbled)[3].sum(axis=0).argmax()] == lang
    assert right / n >= 0.9


def test_passages_cover_all_letters(model):
    reader = langid.Reader(model)
    for text in ("One. Two!\nThree 3.5 four; five", "日本語です。中文呢？Last", "été so­ft", "x" * 50_000, "a​b"):
        start, stop, letters, _ = reader.passages(text)
        assert letters.sum() == sum(map(str.isalpha, text)) and (start[1:] >= stop[:-1]).all() and stop[-1] <= len(text)
    assert [text[a:b] for text in ["One. Two!\nThree 3.5 four; five"] for a, b in zip(*reader.passages(text)[:2], strict=True)] == ["One. ", "Two!\n", "Three 3.5 four; five"]
    assert reader.passages(None) is None and reader.passages("") is None and reader.passages(" 12 \n?!") is None


def test_forgetting_changes_nothing(samples, model, monkeypatch):
    want = [langid.Reader(model).passages(t)[3].tolist() for _, t in samples[:40]]
    monkeypatch.setattr(langid, "_CACHED_TOKENS", 5)
    reader = langid.Reader(model)
    assert [reader.passages(t)[3].tolist() for _, t in samples[:40]] == want


def test_labels(spark, names):
    labels = {"en": "en", " EN ": "en", "eng": "en", "English": "en", "en-US": "en", "en_au": "en", "zh-Hant-TW": "zh", "no": "no", "xx": None, "en-": None, "english-US": None, "und": None, "": None, None: None, " de\n": "de"}
    df = spark.createDataFrame([(k,) for k in labels], "l string")
    assert [r[0] for r in df.select(langid.named_language(F.col("l"), names)).collect()] == list(labels.values())


def test_declarations(spark, names):
    page = b'<!DOCTYPE html>\n<HTML class="x" lang="pt-BR"><head lang="de">'
    rows = [(page, "HTTP/1.1 200 OK\r\nContent-Language: fr-CA, en\r\nX: y"), (b"<html><p lang='de'>\xff", "A: b"), (None, None), (b"<html lang=english>", "")]
    d = langid.declared_languages(F.col("p"), F.col("h"), names)
    out = spark.createDataFrame(rows, "p binary, h string").select(*d.values()).collect()
    assert [tuple(r) for r in out] == [("pt", "fr"), (None, None), (None, None), ("en", None)]


def test_mixed_and_wrong_documents(spark, samples, model, names):
    rnd = random.Random(1)
    by = {}
    for lang, text in samples:
        by.setdefault(lang, []).append(text)
    rows, want = [], set()
    langs = sorted(by)
    for i in range(120):
        a, b = rnd.sample(langs, 2)
        if i % 3 == 0:
            texts = rnd.sample(by[a], 4)
            rows.append((i, " ".join(texts), rnd.choice([a, f"{a}-XY", a.upper()])))
        elif i % 3 == 1:
            rows.append((i, "\n".join(rnd.sample(by[a], 4)), rnd.choice([b, None, "", "xx"])))
            want.add((i, a))
        else:
            mix = [x for p in zip(rnd.sample(by[a], 5), rnd.sample(by[b], 5), strict=True) for x in p]
            rows.append((i, " ".join(mix), a))
            share = {k: sum(map(str.isalpha, "".join(mix[j::2]))) for j, k in ((0, a), (1, b))}
            counting = {k for k in share if share[k] * 5 >= sum(share.values())}
            if counting != {a}:
                want |= {(i, k) for k in counting}
    found = langid.passages(documents(spark, rows), model, names)
    got = {(r.doc_id, r.lang) for r in langid.wrong_labels(found).collect()}
    assert len(got ^ want) <= 0.03 * len(want)
    per = langid.languages_of(found).collect()
    assert all(0 < r.confidence <= 1 for r in per) and {r.doc_id for r in per} == set(range(120))


def test_odd_rows(spark, model, names):
    text = "The harbour office repairs several broken clocks in the main square with great patience every morning."
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n 12", None), (4, text, "en", None, None, None), (4, text, "de", "x", b"\xff<html lang=de>", "bad"), (None, text, None), (6, "short text", None)]
    found = langid.passages(documents(spark, rows), model, names)
    assert sorted((r.doc_id or 0, r.lang) for r in langid.wrong_labels(found).collect()) == [(0, "en"), (4, "en")]
    assert found.count() == 7
    empty = langid.passages(documents(spark, rows).limit(0), model, names)
    assert empty.count() == 0 and langid.wrong_labels(empty).count() == 0


def test_priors_are_smoothed_along_the_address(spark):
    read = spark.createDataFrame([("a.x.pt", 0)] * 30 + [("b.x.pt", 1)] + [("c.y.de", 2)] * 5 + [("", None)], "host string, main int")
    p = {r.host: r for r in langid.host_priors(read, 3).collect()}
    assert set(p) == {"a.x.pt", "b.x.pt", "c.y.de"} and all(abs(sum(r.prior) - 1) < 1e-9 and r.n_all == 36 for r in p.values())
    # a host of one document leans on its domain, another suffix does not
    assert p["b.x.pt"].prior[0] > 0.5 > p["c.y.de"].prior[0] and p["a.x.pt"].prior[0] > p["b.x.pt"].prior[0]


def test_every_language_is_fused_with_its_own_likelihood(model):
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    reader, k = langid.Reader(model), len(model.languages)
    read = langid._read_texts(SimpleNamespace(value=model))
    for text in ("Fresh soup and bread every day", "Das Haus ist heute geschlossen"):
        scores, letters = reader.passages(text)[3].astype(float), reader.passages(text)[2]
        batch = next(read([pa.RecordBatch.from_pydict({"key": [1], "label": ["en"], "text": [text]})]))
        for favoured in range(k):
            prior = np.full((1, k), 1e-4)
            prior[0, favoured] = 1.0
            prior /= prior.sum()
            placed = pa.RecordBatch.from_arrays([*batch.columns, pa.array(prior.tolist())], names=[*batch.schema.names, "prior"])
            got = next(langid._fuse(model.languages, {})([placed])).column(2).to_pylist()[0][0]
            want = langid.confidences(langid.posterior(scores, letters, np.zeros(1, int), prior))[0]
            assert got["lang"] == model.languages[want.argmax()] and abs(got["confidence"] - want.max()) < 1e-4


def test_documents_of_any_host_meet_its_prior(spark):
    read = spark.createDataFrame([(i, h) for i, h in enumerate(["hot"] * 60 + ["warm"] * 30 + ["cold"] * 9 + ["silent"])], "key long, host string")
    priors = spark.createDataFrame([("hot", 60.0, [0.9, 0.1]), ("warm", 30.0, [0.5, 0.5]), ("cold", 9.0, [0.2, 0.8])], "host string, n_host double, prior array<double>")
    want = {"hot": [0.9, 0.1], "warm": [0.5, 0.5], "cold": [0.2, 0.8], "silent": [0.5, 0.5]}
    for hot_share, per_salt in ((2, 200_000), (2, 3), (1, 10), (100, 1)):
        got = langid.with_priors(read, priors, 2, 99, hot_share, per_salt).collect()
        assert len(got) == 100 and all(list(r.prior) == want[r.host] for r in got)


def test_confidence_is_calibrated(samples):
    """Held-out passages of one to six words under a flat prior: among those of a confidence, about that share is right."""
    import numpy as np

    by = {}
    for lang, text in samples:
        by.setdefault(lang, []).append(text)
    held = langid.TextModel([(lang, t) for lang, ts in by.items() for t in ts[::2]])
    reader, k = langid.Reader(held), len(held.languages)
    sure, right = [], []
    for lang, ts in by.items():
        for text in ts[1::2]:
            words = text.split() if " " in text else list(text)
            for n in (1, 2, 3, 6):
                for at in range(0, len(words) - n + 1, n):
                    found = reader.passages(" ".join(words[at : at + n]))
                    if found is None:
                        continue
                    _, _, letters, scores = found
                    post = langid.posterior(scores, letters, np.zeros(len(scores), int), np.full((1, k), 1 / k), rounds=1)
                    sure += langid.confidences(post).max(axis=1).tolist()
                    right += (post.argmax(axis=1) == held.languages.index(lang)).tolist()
    sure, right = np.array(sure), np.array(right)
    gaps = []
    for low, high in ((0.0, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 0.99), (0.99, 1.01)):
        own = (sure >= low) & (sure < high)
        gaps.append((own.mean(), sure[own].mean(), right[own].mean()))
    print([tuple(round(float(x), 3) for x in g) for g in gaps])
    assert sum(w * abs(a - b) for w, a, b in gaps) < 0.1
