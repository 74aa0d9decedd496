import base64

import public_tokenizers
import pytest
import tiktoken

from cinetrace.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None,
    "",
    " ",
    "one",
    "it's  the   end\n\n of\tthe line, isn't it?  ",
    "x" * 400,
    " " * 400 + "y",
    "'" * 120 + "s" + "word " * 60,
    "\n\n\n".join("ab cd" for _ in range(90)),
    "Ünïcödé ñandú 日本語の文章 " * 30 + "€12,345.67",
    "longword" * 20 + " then short ones follow " * 10 + "Z" * 150,
]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(50, 20), (64, 7), (100_000, 1000)])
def test_chunks_encode_as_the_whole(docs, chunk, overlap):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4]), (4, TEXTS[4]), (9, TEXTS[9])]
    df = docs(rows, ["ids", "k", "at", "chunk"])
    got = bpe.encode(df, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    assert sorted(got.columns) == sorted(df.columns)
    back = bpe.decode(got, RANKS, public_tokenizers.PATTERN).collect()
    assert len(back) == len(rows)
    enc = reference()
    for r in back:
        assert r["ids"] == enc.encode_ordinary(r["text"] or ""), r["text"]
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_long_runs_of_space(spark):
    codec = bpe.Codec(spark, RANKS, public_tokenizers.PATTERN)
    text = " " * 3000 + "a b" + "\n" * 2500 + "c"
    assert codec.encode(text) == reference().encode_ordinary(text)


def test_no_rows(docs):
    assert bpe.encode(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0
