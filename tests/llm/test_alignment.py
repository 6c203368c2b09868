"""Token alignment: against a version that walks bytes, and odd rows."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from groundloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: b for b, c in enumerate(alignment.byte_letters())}
    spell_a = lambda i: bytes(back[c] for c in t.id_to_token(i))
    spell_b = lambda i: bytes([int(s.id_to_piece(i)[3:-1], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    return t, s, spell_a, spell_b


def brute(docs, libraries):
    """Groups by walking the end offsets, links by comparing byte ranges."""
    t, s, spell_a, spell_b = libraries
    seen, count = [], collections.Counter()
    for doc, text in docs:
        a = b = []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
            raw = (" " + text).encode()
            if b"".join(map(spell_a, a)) != raw or b"".join(map(spell_b, b)) != raw:
                a = b = []
        ends = [np.cumsum([0, *[len(spell(i)) for i in ids]]).tolist() for ids, spell in ((a, spell_a), (b, spell_b))]
        links = []
        j = 0
        for i in range(len(a)):
            while j and ends[1][j] > ends[0][i]:
                j -= 1
            while j < len(b) and ends[1][j] < ends[0][i + 1]:
                if ends[1][j + 1] > ends[0][i]:
                    links.append((a[i], b[j]))
                j += 1
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = []
        for p, q in zip(cuts, cuts[1:]):
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, end[1:]) if p < e <= q) for ids, end in ((a, ends[0]), (b, ends[1]))))
        count.update(links)
        seen.append((doc, len(a), len(b), groups, links))
    top = collections.defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted(
        (repr(doc), na, nb, len(g), len(k), sum(count[x] == top[x[1]] for x in k), sum(count[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "")
        for doc, na, nb, g, k in seen
    )


def rows_of(df):
    return sorted((repr(r["doc_id"]), *[r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")]) for r in df.collect())


def test_documents_against_brute_force(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], libraries)
    # small blocks: several in a task
    assert rows_of(alignment.align(docs.repartition(3), A, B, block_pairs=5000, block_links=20000)) == want


def test_odd_rows(spark, libraries):
    r = np.random.default_rng(5)
    letters = list("  \n\t'abcsterdvm'lAÉéß²1½9<|>_-.,▁　\x1c\x85\xa0İΣς—“中文́e\x00日😀ª")
    odd = [(1, "It's the café ½  x.\nagain"), (1, "It's the café ½  x.\nagain"), (None, "two <|endoftext|> marks <s> </s>"), (None, None), (2, None), (3, ""), (4, " \t\n "), (5, "a ▁ mark"),
           (6, "word " * 3000 + "9" * 5000 + "z" * 6000 + " " * 700), (7, " lead"), (8, "é"), (9, "中" * 30)] + [(100 + k, "".join(r.choice(letters, r.integers(0, 60)))) for k in range(150)]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("block", "pairs", "n", "number", "part", "best", "numbers", "n_a")})
    assert rows_of(alignment.align(df, A, B)) == brute(odd, libraries)
    assert alignment.align(df.where("false"), A, B).collect() == []
    none = alignment.align(df.where("text IS NULL"), A, B).collect()
    assert len(none) == 2 and all(x.n_a == x.n_links == x.count_sum == 0 and x.groups_sha256 == "" for x in none)


def test_last_tokens_of_long_chains():
    """Tokens that overlap in a chain of thousands end at one terminal; doubling needs few rounds."""
    n = 5001
    end_a, end_b = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n, 2), 2 * n)
    start_a, start_b = np.concatenate(([0], end_a[:-1])), np.concatenate(([0], end_b[:-1]))
    last = alignment.last_tokens(start_a, end_a, start_b, end_b)
    assert set(last.tolist()) == {len(end_a) - 1}
