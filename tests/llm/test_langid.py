import zlib

from pyspark.sql import functions as F

from polyscene.llm import langid

LANGS = {"en": "the thing is that there was nothing", "de": "über die straße und das schöne haus", "fr": "où était la forêt éternelle"}


def corpus(n=120):
    texts, langs = [], []
    for i in range(n):
        lang = sorted(LANGS)[i % 3]
        words = LANGS[lang].split()
        texts.append(" ".join(words[(i + j) % len(words)] + words[(i * j) % len(words)][:3] for j in range(12)))
        langs.append(lang)
    return texts, langs


def test_held_out_accuracy_and_blanks(make):
    texts, langs = corpus()
    texts, langs = texts + ["", None, "12 34 !", "ß", "x" * 50000], langs + ["en", "en", None, "de", None]
    got = {r["doc_id"]: r for r in langid.identify(make(texts, langs)).collect()}
    assert len(got) == len(texts)
    test = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in test) for i in range(120))
    assert sum(got[i]["lang_pred"] == langs[i] for i in test) >= 0.9 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (120, 121, 122)] == ["und"] * 3 and got[124]["lang_pred"] in LANGS


def test_counts_match_brute_force(make, spark):
    texts, langs = corpus(30)
    model = langid.fit(make(texts, langs))
    for lang in model:
        sums: dict[int, int] = {}
        for t, own in zip(texts, langs, strict=True):
            if own == lang:
                for g in langid.grams(t.encode()).tolist():
                    sums[g] = sums.get(g, 0) + 1
        assert model[lang] == sorted(sums, key=lambda g: (-sums[g], g))[: langid.PROFILE]


def test_small_tables_hand_on(make, monkeypatch):
    texts, langs = corpus(30)
    whole = langid.fit(make(texts, langs).coalesce(1))
    parts = [b for b in _batches(texts, langs)]
    monkeypatch.setattr(langid, "HELD", 40)
    sums: dict = {}
    for b in langid._counted(iter(parts)):
        for lang, g, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sums[lang, g] = sums.get((lang, g), 0) + n
    for lang in whole:
        own = {g: n for (k, g), n in sums.items() if k == lang}
        assert whole[lang] == sorted(own, key=lambda g: (-own[g], g))[: langid.PROFILE]


def _batches(texts, langs):
    import pyarrow as pa

    yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], ["lang", "text"])


def test_empty_and_untrained(make, empty):
    assert langid.identify(empty).count() == 0
    got = langid.identify(make(["abc"], [None])).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)
    clash = make(["abc abc"]).withColumn("score", F.lit("x")).withColumn("k0", F.lit(1))
    assert langid.identify(clash).columns == ["doc_id", "held_out", "lang_pred", "score"]


def test_distances_match_brute_force(make):
    """The ranks of a text's own n-grams against each profile's, by plain counting."""
    import itertools
    from collections import Counter

    def plain(t):
        padded = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        one = Counter()
        line = "_" + "_".join(padded) + "_" if padded else ""
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                g = line[i : i + n]
                if g != "_" and (n < 3 or g[1] != "_"):
                    one[g] += 1
        return one

    def order(counts):
        code = lambda g: tuple([0] * (3 - len(g)) + [1 if c == "_" else ord(c) for c in g])
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][: langid.PROFILE]

    texts = ["the cat and the hat", "le chat et la souris", "the the the", "zzz qqq", "the cat and the hat", "ab ab cd cd", None, "42"]
    langs = ["en", "fr", "en", "fr", "en", "fr", "en", "fr"]
    docs = make(texts, langs)
    model = langid.fit(docs)
    profiles = {k: order(sum((plain(t) for t, x in zip(texts, langs, strict=True) if x == k), Counter())) for k in ("en", "fr")}
    got = {r["doc_id"]: r for r in langid.predict(docs, model, {"doc_id": F.col("doc_id")}).collect()}
    for i, t in enumerate(texts):
        own = order(plain(t))
        if not own:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        far = {k: sum(abs(p.index(g) - r) if g in p else langid.PROFILE for r, g in enumerate(own)) for k, p in profiles.items()}
        best = min(itertools.chain(far), key=lambda k: (far[k], k))
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - (1 - far[best] / (langid.PROFILE * len(own)))) < 1e-12
