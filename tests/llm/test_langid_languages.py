import numpy as np

from lattica.llm import langid

LANGS = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"][:90]


def prose(k, rng, n=60):
    own = np.random.default_rng(1000 + k)
    syllables = ["".join(own.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(12)]
    return " ".join("".join(rng.choice(syllables, 2)) for _ in range(n))


def test_every_language_is_told_apart(spark):
    """More languages than fit one dense table; the rarest ones have a document each."""
    rng = np.random.default_rng(1)
    rows = [(lang, prose(k, rng)) for k, lang in enumerate(LANGS) for _ in range(3 if k < 64 else 1)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(k, f"http://h{k}.example.com/", f"<p>{prose(k, rng)}</p>") for k in range(len(LANGS))] + [(900, "http://x.example.com/", f"<html lang={LANGS[-1]}><p></p>")], "page_id long, url string, html string")
    assert langid.text_model(docs).langs == sorted(LANGS)
    got = {r.page_id: r for r in langid.identified(pages, docs).collect()}
    assert all(got[k].lang == lang and got[k].text_lang == lang for k, lang in enumerate(LANGS))
    assert got[900].lang == LANGS[-1]


def test_sparse_model_equals_the_dense_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(prose(k, rng), LANGS[k]) for k in range(5)] + [("", "zz")], "text string, lang string")
    pages = spark.createDataFrame([(k, f"http://h{k % 2}.example.com/", prose(k, rng, 9)) for k in range(5)] + [(9, None, None)], "page_id long, url string, html string")
    dense, want = langid.text_model(docs), sorted(langid.identified(pages, docs).collect())
    monkeypatch.setattr(langid, "DENSE", 2)
    sparse, got = langid.text_model(docs), sorted(langid.identified(pages, docs).collect())
    assert dense.dense and not sparse.dense and dense.langs == sparse.langs == sorted([*LANGS[:5], "zz"])
    text = prose(1, rng) + " other words"
    assert np.allclose(dense.evidence(text), sparse.evidence(text), rtol=0, atol=1e-9)
    assert [tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in got] == [tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in want]


def test_country_suffixes():
    for suffix, lang in {"it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "jp": "ja", "se": "sv", "cz": "cs", "kr": "ko", "ua": "uk", "uk": "en", "co": "es"}.items():
        assert langid.address(f"http://www.example.{suffix}/x")[2] == lang
    assert langid.address("http://www.example.ch/fr/x")[2] == "fr"
