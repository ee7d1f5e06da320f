"""Sentence spans: passages cut at both ends, stock phrases, plain version on awkward texts."""

import random

from changewright.llm.sentence_dedup import SPACE, sentence_dedup, units_of

SCHEMA = "doc_id long, text string, pos string, n string, h string, spans string"


def plain(rows, size=2, words=20):
    runs, first = {}, {}
    for key in sorted({(i is not None, i or 0, t) for i, t in rows if t}):
        units, n = units_of(key[2])
        for a in range(len(units)):
            b = next((b for b in range(a + size, len(units) + 1) if sum(n[a:b]) >= words), None)
            if b:
                run = tuple(u.rstrip(SPACE) for u in units[a:b])
                runs.setdefault(key, []).append((a, b, run))
                first.setdefault(run, (key, a))
    out = []
    for i, t in rows:
        key = (i is not None, i or 0, t)
        units = units_of(t)[0] if t else []
        gone = {x for a, b, run in runs.get(key, ()) if first[run] != (key, a) for x in range(a, b)}
        out.append((i, len(units), len(gone), "".join(u for x, u in enumerate(units) if x not in gone) if t else t))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(*r, *"xxxx") for r in rows], SCHEMA).repartition(3)
    return sorted(((r["doc_id"], r["n_sentences"], r["n_removed"], r["kept"]) for r in sentence_dedup(df).collect()), key=repr)


def prose(rng, n):
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", "", ",", ".", ".", ";"]) for w in words)


def test_planted_passages_cut_at_both_ends(spark):
    rng = random.Random(1)
    rows, planted = [], set()
    for k in range(60):
        passage = prose(rng, rng.randint(51, 90)).split(" ")
        for copy in range(2):
            lo, hi = (rng.randint(0, 4), len(passage) - rng.randint(0, 4)) if copy else (0, len(passage))
            rows.append((len(rows), f"{prose(rng, 30)} {' '.join(passage[lo:hi])} {prose(rng, 30)}"))
        planted.add(rows[-1][0])
    stock = "All rights reserved. Read more. Sign up now. Contact us. "
    rows += [(len(rows) + k, stock + prose(rng, 60)) for k in range(60)]
    hit = {r[0] for r in got(spark, rows) if r[2]}
    assert len(hit & planted) >= 0.95 * len(planted)
    assert not hit - planted


def test_like_plain(spark):
    rng = random.Random(2)
    parts = [prose(rng, rng.randint(1, 30)) for _ in range(12)] + ["", " ", "\n", "Short. ", "é\U0001f642 na, ïve. ", "x" * 3000]
    rows = [(k, "".join(rng.choice(parts) + rng.choice([" ", "\n", ". "]) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    rows += [(None, rows[3][1]), (None, None), (5, rows[5][1]), (5, rows[6][1]), (70, None), (71, ""), (72, "the same old words. again and again, " * 4000)]
    want = plain(rows)
    assert got(spark, rows) == want and sum(r[2] > 0 for r in want) > 10
    assert got(spark, []) == []
