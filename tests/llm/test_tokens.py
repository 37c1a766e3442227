import random

import numpy as np
import pytest

from groundline.llm import chunk_bpe, vocab

ODD = [
    "J̌ The. A,b. C.. d.\nE, f", "<|ENDOFTEXT|> <|EndOfText|>", "Ǆ ŒUVRE ÀÉ. Été, x", "A. B. C, D., e. f",
    "", " ", "\n", "a", "Hello  world", "it's  don't\n\nx", "tab\tand nbsp   x", "é ä ́x", "İstanbul ΣΑΣ ß", "日本語 テキスト 中文",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>c ", " <|startoftext|>x", "😀😀 👩‍👩‍👧", "a" * 5000, "ab " * 3000, "! !! !x \x1c\x1d x\x85y", "  　 z",
    "%%% *** $$$ 123 4567 12a", "x" * 3000 + " " + "y" * 3000, "١٢٣ ४५", "́ͅ x", "　全角　スペース",
]


def texts():
    rng = random.Random(1)
    alphabet = list("abcdefghij  \n\t.,'!1é߀ñ") + ["<|endoftext|>", "́", "日", " ", "  ", "the ", "'s ", "'ll"]
    shared = ["".join(rng.choice(alphabet) for _ in range(400)) for _ in range(4)]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(600))) for _ in range(150)]
    return ODD + made + [a + b for a, b in zip(made, shared * 40)] + shared


def test_word_encoder_is_the_library():
    path = vocab.vocabulary(vocab.WORD_BPE)
    library, own = vocab.tokenizer(path), vocab.WordEncoder(path)
    every = texts()
    for text, ids in zip(every, own.encode(every)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert own.encode([]) == []


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return chunk_bpe.ChunkEncoder(vocab.vocabulary(vocab.BYTE_BPE), vocab.vocabulary(vocab.BYTE_RANKS), public_tokenizers.PATTERN)


def test_chunk_encoder_is_the_library(encoder):
    library = vocab.tokenizer(vocab.vocabulary(vocab.BYTE_BPE))
    for text in texts():
        ids = encoder.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert encoder.reused > 0


def test_cuts_follow_content():
    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, 20000).astype(np.uint8)
    ahead = rng.integers(97, 123, 777).astype(np.uint8)
    a, b = set(chunk_bpe.cuts(body).tolist()), {x - 777 for x in chunk_bpe.cuts(np.concatenate([ahead, body])).tolist()}
    assert len(a) > 30 and len(a & b) > 0.9 * len(a)


def test_library_on_real_documents(encoder):
    import duckdb

    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    every = [r[0] for r in rows]
    library = vocab.tokenizer(vocab.vocabulary(vocab.BYTE_BPE))
    for text, found in zip(every, library.encode_batch(every, add_special_tokens=False)):
        assert encoder.encode(text).tolist() == found.ids
    path = vocab.vocabulary(vocab.WORD_BPE)
    for ids, found in zip(vocab.WordEncoder(path).encode(every), vocab.tokenizer(path).encode_batch(every, add_special_tokens=False)):
        assert ids.tolist() == found.ids
