"""The language model against plain Python: hashed n-grams, document frequencies, FTRL, temperature, predictions."""

import math
import zlib
from collections import Counter

import numpy as np

from changewright.llm import language_id as L

MASK = (1 << 32) - 1


def plain_grams(text):
    code, a, b, c = [ord(x) for x in text.lower()], *map(int, L._MIX)
    out = Counter()
    for i in range(len(code)):
        for n in L.GRAMS:
            if i + n > len(code):
                break
            h = code[i + n - 1] * a & MASK  # from the last letter to the first
            for k in range(2, n + 1):
                h = ((h ^ (h >> 15)) * b + code[i + n - k] * c + k) & MASK
            out[((h ^ (h >> 16)) * a & MASK) >> (32 - L.BITS)] += 1
    return dict(out)


def plain_fit(rows, langs, idf):
    """FTRL-proximal, one weight at a time."""
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= L.L1:
            return 0.0
        return -(z[k] - math.copysign(L.L1, z[k])) / ((L.BETA + math.sqrt(n[k])) / L.ALPHA + L.L2)

    for _ in range(L.EPOCHS):
        for lang, counts in rows:
            x = {f: c * idf[f] for f, c in counts.items()}
            size = math.sqrt(sum(v * v for v in x.values()))
            x = {f: v / size for f, v in x.items()}
            w = {(f, y): weight((f, y)) for f in x for y in langs}
            s = {y: sum(v * w[f, y] for f, v in x.items()) for y in langs}
            top = max(s.values())
            total = sum(math.exp(v - top) for v in s.values())
            for y in langs:
                g0 = math.exp(s[y] - top) / total - (y == lang)
                for f, v in x.items():
                    g, old = v * g0, n.get((f, y), 0.0)
                    z[f, y] = z.get((f, y), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / L.ALPHA * w[f, y]
                    n[f, y] = old + g * g
    return weight


TEXTS = [("en", "the cat sat on the mat and the dog"), ("de", "die Katze saß auf der Matte und"), ("fr", "le chat était sur le tapis où"), ("en", "there is nothing new here"), ("de", "nichts ist neu hier"), ("fr", "rien de nouveau ici")]


def test_grams():
    for t in ["", "a", "Ab", "ÉTÉ été \U0001f642", "\x00x" * 50, *(x for _, x in TEXTS)]:
        got = L.gram_counts(t)
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == plain_grams(t)


def test_long_texts_in_steps(monkeypatch):
    text = "thequickbrownfoxé" * 9
    whole = L.gram_counts(text)
    for step in (1, 2, 3, 7):
        monkeypatch.setattr(L, "_STEP", step)
        assert (L.gram_counts(text) == whole).all()


def test_weights_and_temperature():
    idf = np.random.default_rng(1).uniform(1, 3, 1 << L.BITS)
    counts = [plain_grams(t) for _, t in TEXTS]
    rows = [(y, np.array(sorted(c)), np.array([float(c[f]) for f in sorted(c)])) for (y, _), c in zip(TEXTS, counts, strict=True)]
    langs = ["de", "en", "fr"]
    got = L._fit(rows, langs, idf)
    want = plain_fit([(y, c) for (y, _), c in zip(TEXTS, counts, strict=True)], langs, idf)
    for c in counts:
        for f in c:
            for i, y in enumerate(langs):
                assert abs(got[f, i] - want((f, y))) < 1e-9
    assert (got == 0).mean() > 0.5  # elastic net: most weights are exactly zero
    model = L.Model(langs, got, idf, 1.0)
    mixed = [*rows[:4], ("en", *rows[4][1:]), ("de", *rows[5][1:])]

    def loss(t):
        model.temperature = t
        out = 0.0
        for y, at, n in mixed:
            full = np.zeros(1 << L.BITS)
            full[at] = n
            out -= math.log(model.score(full)[langs.index(y)])
        return out

    best = L._temperature(model, mixed)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.geomspace(0.03, 18, 60))


def test_learning_and_predictions(spark):
    rows = [(i, f"{t} {i} {t[: i % 9]}", y) for i, (y, t) in enumerate(TEXTS * 20)] + [(None, "no id", "en"), (900, None, "en"), (901, "123", "de"), (902, "the cat", None), (3, rows_text := "die Katze", "de"), (3, rows_text, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = L.fit_language_model(df, sample=60)

    def fold(i):
        return zlib.crc32(str(i).encode()) % 4

    learned = [(i, t, y) for i, t, y in rows if i is not None and y and t and any(map(str.isalpha, t)) and fold(i) != 2]
    df_plain = Counter(f for _, t, _ in learned for f in plain_grams(t))
    for f in range(0, 1 << L.BITS, 7):
        assert abs(model.idf[f] - (math.log((1 + len(learned)) / (1 + df_plain.get(f, 0))) + 1)) < 1e-9
    got = {r["doc_id"]: r for r in L.identify_languages(df, sample=60).where("doc_id < 900").collect()}
    for i, t, y in rows[:120]:
        x = {f: c * model.idf[f] for f, c in plain_grams(t).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        s = [sum(v / size * model.weights[f, k] for f, v in x.items()) / model.temperature for k in range(len(model.langs))]
        p = [math.exp(v - max(s)) for v in s]
        best = max(range(len(p)), key=p.__getitem__)
        if i != 3:
            assert got[i]["lang_pred"] == model.langs[best] == y and abs(got[i]["score"] - p[best] / sum(p)) < 1e-9
            assert got[i]["held_out"] == (fold(i) == 2)
