"""Token alignment against whole-text encoding and a plain alignment."""

import hashlib
from collections import Counter

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from changewright.llm.token_alignment import _CUT, aligned_batches, align_documents, byte_letters, pair_counts

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, t1 string, batch string, n_a string, count string, times string"


def plain(texts):
    """One tuple per text, as the columns of the result."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letter = byte_letters()

    def b_bytes(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    found, count = [], Counter()
    for t in texts:
        want = f" {t or ''}".encode()
        a = [(i, bytes(letter[c] for c in tok.id_to_token(i))) for i in tok.encode(f" {t or ''}", add_special_tokens=False).ids] if t else []
        b = [(i, b_bytes(i)) for i in sp.encode(t)] if t else []
        if not t or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            found.append(None)
            continue
        groups, links, i, j = [([], [])], [], 0, 0
        end_a, end_b, at = len(a[0][1]), len(b[0][1]), 0
        groups[0][0].append(a[0][0])
        groups[0][1].append(b[0][0])
        while True:
            links.append((a[i][0], b[j][0]))
            at = min(end_a, end_b)
            if end_a == end_b:
                if at == len(want):
                    break
                groups.append(([], []))
            if end_a == at:
                i += 1
                end_a += len(a[i][1])
                groups[-1][0].append(a[i][0])
            if end_b == at:
                j += 1
                end_b += len(b[j][1])
                groups[-1][1].append(b[j][0])
        count.update(links)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest()))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    rows = []
    for x in found:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, sha = x
            rows.append((n_a, n_b, n_groups, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha))
    return rows, count


def got(spark, texts, **how):
    df = spark.createDataFrame([(i, t, *"xxxxx") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    out = align_documents(df, A, B, **how).orderBy("doc_id").collect()
    return [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in out]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b ", "\n", "a\n b", "a \nb", "a \n \n b", "tab\there", "x y", "café café", "▁x", "x▁ y", "ﬁne ①",
    "<|endoftext|> is text", "</s><s> <unk> [INST]", "\U0001f642 smile \U0001f468‍\U0001f469", "中文 文字", "zero\x00byte", "it's we'll they've", "12345 67,890.12", "​zw",
    "\x1c \x1d", "a  b", "　wide", "q" * 5000, "the same " * 3000, "the same words twice", "the same words twice", "\r\n \r\n", "\x85 next", "힣 하", "Å Å Å",
]


def test_odd_texts(spark):
    want, count = plain(ODD)
    assert got(spark, ODD) == want
    assert got(spark, ODD, batch=1) == want
    df = spark.createDataFrame([(i, t, *"xxxxx") for i, t in enumerate(ODD)], SCHEMA)
    pairs = {(r["a"], r["b"]): r["count"] for r in pair_counts(aligned_batches(df, A, B)).collect()}
    assert pairs == dict(count)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, _ = plain([r["text"] for r in docs])
    out = align_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), A, B).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in out] == want and [r["doc_id"] for r in out] == [r["doc_id"] for r in docs]


def test_empty_and_all_null(spark):
    assert got(spark, []) == []
    assert got(spark, [None, None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 3
    assert got(spark, ["▁"]) == [(0, 0, 0, 0, 0, 0, "")]


def test_pieces_join_to_the_text():
    for t in ODD:
        assert " ".join(_CUT(t or "")) == (t or "")
