"""The registered queries against SQL, or against a plain version where SQL cannot state the result."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import compare
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from changewright.llm import queries as Q
from changewright.llm import suffix_dedup as S
from changewright.llm.bpe import Codec
from changewright.llm.simhash import _near

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF)


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


def rows(spark, name):
    return Q.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, con, name):
    assert compare.difference(Q.QUERIES[name](spark, SF), con, Q.ORACLES[name]) is None


def test_language_accuracy(spark, documents):
    import zlib

    lang = {d: x for d, _, x in documents}
    got = rows(spark, "op1_language_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(documents) and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def linked(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_embeddings(spark, con):
    data = con.execute("SELECT vec_id, embedding, label FROM embeddings ORDER BY vec_id").fetchall()
    x = np.array([v for _, v, _ in data], dtype=float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    label = np.array([k for _, _, k in data])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r for r in rows(spark, "op4_multi_index")}
    n = np.array([got[v]["n_links"] for v, _, _ in data])
    assert (n <= near.sum(axis=1)).all() and n.sum() >= 0.9 * near.sum()
    if n.sum() == near.sum():
        root = linked(len(x), np.argwhere(np.triu(near)).tolist())
        assert [got[v]["component_id"] for v, _, _ in data] == [data[r][0] for r in root]


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_roots(texts):
    prints = [fingerprint(t) for t in texts]
    p = np.array(prints, dtype=np.uint64)
    pairs = [(i, i + 1 + int(j)) for i in range(len(p)) for j in np.flatnonzero(np.bitwise_count(p[i + 1 :] ^ p[i]) <= 3)]
    return prints, linked(len(p), pairs)


def test_simhash(spark, documents):
    prints, root = simhash_roots([t for _, t, _ in documents])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op5_simhash")}
    assert got == {d: (f"{p:016x}", documents[r][0]) for (d, _, _), p, r in zip(documents, prints, root, strict=True)}


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=6)), min_size=1, max_size=200), st.integers(0, 3))
@settings(max_examples=40, deadline=None)
def test_bit_sliced_distance(pairs, radius):
    a = np.array([x for x, _ in pairs], dtype=np.uint64)
    b = np.array([x ^ sum(1 << i for i in flips) for x, flips in pairs], dtype=np.uint64)
    assert _near(a, b, radius).tolist() == [len(f) <= radius for _, f in pairs]


def encoding():
    with open(public_tokenizers.path(Q.RANKS), "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return raw, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_row(enc, text):
    ids = enc.encode_ordinary(text or "")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())


def test_tokens(spark, documents):
    _, enc = encoding()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op7_byte_bpe")}
    assert got == {d: token_row(enc, t) for d, t, _ in documents}


def test_odd_texts_are_encoded_alike():
    raw, enc = encoding()
    codec = Codec(raw, public_tokenizers.PATTERN)

    @given(st.lists(st.text(alphabet="ab ' \n\t\x1c\x85é一\U0001f6421!.s", max_size=80), min_size=1, max_size=5))
    @settings(max_examples=60, deadline=None)
    def check(texts):
        tokens, size = codec.encode(texts)
        assert tokens.tolist() == [i for t in texts for i in enc.encode_ordinary(t)]
        assert codec.decode(tokens, size) == [t.encode() for t in texts]

    check()
    rng = np.random.default_rng(3)
    letters, han = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", [chr(x) for x in range(0x4E00, 0x9FA0)]
    long = ["a" * 3000, "thein" * 400, "qzxjkv" * 50, "ab" * 5000, "aab" * 900 + "a" * 77, "".join(rng.choice(list(letters[:26]), 50_000)), "".join(rng.choice(list(letters), 20_000)), "".join(rng.choice(han, 8_000))]
    long += ["".join(rng.choice(list(a), int(rng.integers(65, 400)))) for a in ("ab", "aehinorst", "_-=", "aeioué", "0123456789") for _ in range(60)]
    for some in (long, long[::-1]):
        codec._forget()
        tokens, size = codec.encode(some)
        assert tokens.tolist() == [i for t in some for i in enc.encode_ordinary(t)]
        assert codec.decode(tokens, size) == [t.encode() for t in some]


def test_a_word_of_two_million_letters():
    raw, enc = encoding()
    codec = Codec(raw, public_tokenizers.PATTERN)
    tokens, size = codec.encode(["a" * 2_000_000, "x"])
    assert size.tolist() == [len(tokens) - 1, 1] and codec.decode(tokens, size) == [b"a" * 2_000_000, b"x"]
    longest = max((r for r in codec.ranks if set(r) == {97}), key=len)
    assert (tokens[:-1] == codec.ranks[longest]).mean() > 0.99


def repeated(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(b), sum(e - s for s, e in spans), len(spans), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffixes(spark, documents):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, "op10_suffix_dedup")}
    assert got == dict(zip([d for d, _, _ in documents], repeated([t for _, t, _ in documents], 200), strict=True))


@pytest.mark.parametrize(("length", "letters", "count", "step"), [(5, "ab", 40, 64), (8, "abc", 60, 1 << 18), (12, "abé", 40, 32), (1, "abcdefghijklmnop", 8, 16)])
def test_short_suffixes(spark, monkeypatch, length, letters, count, step):
    monkeypatch.setattr(S, "STEP", step)
    rng = np.random.default_rng(length)
    texts = ["".join(rng.choice(list(letters), rng.integers(0, 90))) for _ in range(count)] + [None, "", "a" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in S.suffix_dedup(df, length).collect()}
    assert got == dict(enumerate(repeated(texts, length)))


def plain_lines(docs):
    """Three-line windows that are not the first of their kind, cut out; documents that lose all go."""
    first, n = {}, Counter()
    for d, t in docs:
        lines = t.split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(w):
                first.setdefault(w, (d, i))
                n[w] += 1
    out = []
    for d, t in docs:
        lines = t.split("\n")
        gone = {j for i in range(len(lines) - 2) if n[w := tuple(lines[i : i + 3])] > 1 and first[w] != (d, i) for j in range(i, i + 3)}
        if len(gone) < len(lines):
            out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def plain_contaminated(text, windows):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hit = {j for k, grams in windows.items() for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in grams for j in range(i, i + k)}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline(spark, con, documents):
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert len(kept) >= 0.99 * len(documents)
    docs = plain_lines([(d, t) for d, t, _ in documents if d in kept])
    _, root = simhash_roots([t for _, t in docs])
    docs = [x for i, x in enumerate(docs) if root[i] == i]
    windows = defaultdict(set)
    for (t,) in con.execute("SELECT text FROM benchmark").fetchall():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        k = min(13, len(w))
        windows[k] |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    docs = [(d, t) for d, t in docs if not plain_contaminated(t, windows)]
    _, enc = encoding()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: token_row(enc, t) for d, t in docs}
