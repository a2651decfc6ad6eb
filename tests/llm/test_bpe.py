import array
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from sidelight.llm.bpe import BacktrackingBPE, load_ranks, with_tokens

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]


@pytest.fixture(scope="module", params=PATHS)
def pair(request):
    ranks = load_ranks(request.param)
    return BacktrackingBPE(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_merges(pair):
    bpe, whole = pair
    rng = random.Random(4)
    parts = ["ab", "the", " ", "\n", "\t ", "é", "日本", "1", "aaaa", "ing", "!!", "́", "😀", "ß", "zz", "\x00", "'s", "'LL"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(1500)] + ["".join(rng.choices("abcdeinorst", k=rng.randrange(1, 90))) for _ in range(1500)]
    texts += ["", " ", "\n\n  x", "a" * 3000, "ab" * 2000, "<|endoftext|>", "".join(map(chr, range(0x20, 0x3000)))]
    for t in texts:
        ids = bpe.encode(t)
        assert ids == array.array("I", whole.encode_ordinary(t)).tobytes()
        assert bpe.decode(ids) == t.encode()


def test_long_pieces_take_linear_time(pair):
    import time

    bpe, _ = pair
    took = []
    for n in (20_000, 200_000):
        text = "".join(random.Random(n).choices("abcdefgh", k=n))
        began = time.process_time()
        assert bpe.decode(bpe.encode(text)) == text.encode()
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.01)


def test_table_with_nulls_and_clashing_columns(spark, docs):
    df = docs([None, "", "two words", "two words"]).withColumnRenamed("kept", "n_tokens")
    out = with_tokens(df, PATHS[0], public_tokenizers.PATTERN, ids=True)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].n_tokens == got[1].n_tokens == 0 and got[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].ids == got[3].ids and got[2].decoded_sha256 == hashlib.sha256(b"two words").hexdigest()
    assert with_tokens(docs([]), PATHS[0], public_tokenizers.PATTERN).collect() == []
