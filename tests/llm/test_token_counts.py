"""Token counts against the tokenizers library, whose counts the operator must give."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from auditlake.llm import token_counts
from auditlake.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def wanted(library, texts):
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def awkward():
    rng = random.Random(13)
    parts = [*" \n\t  a1!'’sé日\x1c\x85\xa0　ᲊ\U00016e40", "  ", "don't", "<|endoftext|>", " <|endoftext|> ", "aaaa", "\r\n", "The word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    long = ["a" * 5000, "xyz" * 3000, "".join(rng.choice("abcdefgh") for _ in range(9000)), " " * 9000, "!" * 7000, "word " * 4000]
    return [*texts, *long, "", None, " ", "<|endoftext|>", "x <|endoftext|>", "aaa", "aaaaaaa"]


def test_counts_are_the_library(library):
    texts, bpe = awkward(), token_counts.RaggedBpe(PATH, cached=500)
    got = []
    for i in range(0, len(texts), 200):  # the small cache is turned over many times
        got += bpe.counts([None if t is None else t.encode() for t in texts[i : i + 200]])
    assert got == wanted(library, texts)


def test_all_code_points(library):
    texts = [f"a{c}1{c}!{c} {c}  b" for c in map(chr, range(0x80, 0x30000, 7)) if not c.encode("utf-8", "replace") == b"?"]
    assert token_counts.RaggedBpe(PATH).counts([t.encode() for t in texts]) == wanted(library, texts)


def test_one_place_a_step_and_heap(library):
    bpe, rng = token_counts.RaggedBpe(PATH), random.Random(1)
    pieces = [bytes(rng.choice(b"abcdeinrt") for _ in range(rng.randrange(1, 60))) for _ in range(300)] + [b"aaaaaaa", b"a"]
    at_once = bpe.merge_counts(pieces)
    assert bpe.at_once and at_once.tolist() == [bpe.heap_count(p) for p in pieces] == wanted(library, [p.decode() for p in pieces])
    bpe.at_once = False
    assert (bpe.merge_counts(pieces) == at_once).all() and len(bpe.merge_counts([])) == 0


def test_vocabulary_with_two_ways_to_a_token(tmp_path):
    """abc is made of (a, bc) or of (ab, c); the second comes after a merge that needs abc, so places are merged one by one."""
    file = json.load(open(PATH, encoding="utf-8"))
    symbols = list(file["model"]["vocab"])[:256]
    merges = [["b", "c"], ["a", "bc"], ["a", "b"], ["abc", "ab"], ["ab", "c"]]
    tokens = dict.fromkeys([*symbols, *(x + y for x, y in merges), "<|endoftext|>"])
    file["model"]["vocab"] = {t: i for i, t in enumerate(tokens)}
    file["model"]["merges"] = merges
    file["added_tokens"][0]["id"] = file["model"]["vocab"]["<|endoftext|>"]
    path = tmp_path / "two.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    bpe, texts = token_counts.RaggedBpe(str(path)), ["abcabc", "ab", "aabbcc", "abcabcab" * 5, "cab abc"]
    assert not bpe.at_once and bpe.counts([t.encode() for t in texts]) == wanted(Tokenizer.from_file(str(path)), texts)


def test_pair_table():
    rng = np.random.default_rng(3)
    keys = rng.choice(300 * 300, 4000, replace=False)
    table, ranks = token_counts.PairRanks(keys // 300, keys % 300, 300), dict(zip(keys.tolist(), range(4000)))
    got = table.of(np.repeat(np.arange(300), 300), np.tile(np.arange(300), 300))
    assert got.tolist() == [ranks.get(k, int(token_counts.NEVER)) for k in range(300 * 300)]


def test_rows(spark, library):
    texts = [None, "", "a b", "word " * 2000, "a b", "tie", "tie"]
    rows = [(i, t, "x", i, i) for i, t in enumerate(texts)] + [(None, "no key", None, None, None), (2, "a b", "x", 2, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int, key int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PATH).collect())
    want = [(-1 if i is None else i, len((t or "").encode()), n, n > 1024) for (i, t, *_), n in zip(rows, wanted(library, [r[1] for r in rows]))]
    assert got == sorted(want) and any(w[3] for w in want)
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.n_tokens for r in QUERIES["op13_token_counts"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], wanted(library, [r.text for r in rows])))
