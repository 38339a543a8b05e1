"""Token output: what the coder and the tokenizer may cost, and that short cuts give the tokenizer's ids."""

import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from attestor.llm import rangecoder, token_output

PATH = public_tokenizers.path("word_bpe_49k.json")


class Counted:
    """The tokenizer, with the times it was asked to do all of its steps."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def encode(self, *args, **more):
        self.calls += 1
        return self.tokenizer.encode(*args, **more)


def ids_of(tokens, texts):
    return [np.frombuffer(i, "<u2").tolist() for i in tokens.encode([t.encode() for t in texts])]


def test_plain_words_go_to_the_model_without_the_other_steps():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzàéüßñ") for _ in range(rng.randint(1, 14)))
    words = [w if i % 3 else w.capitalize() + rng.choice([",", ".", "", "."]) for i, w in enumerate(word() for _ in range(3000))]
    tokens, plain = token_output.Tokens(PATH), Tokenizer.from_file(PATH)
    tokens.tokenizer = counted = Counted(tokens.tokenizer)
    text = " ".join(words)
    assert ids_of(tokens, [text]) == [plain.encode(text, add_special_tokens=False).ids]
    assert counted.calls <= 2  # the two signs


@pytest.mark.parametrize("most", [0, 6, 800_000])
def test_ids_are_those_of_the_whole_text(most):
    rng = random.Random(9)
    parts = ["the", "The", "cat's", "CAT'S", "don't,", "x'll", "'s", "a,'s", "a.'re", "a...", "a#*", "b-c", "b_c", "É", "é", "é", "É.", "J̌", "ǰ", "İ", "İ", "ẞ", "ß.", "ÿ", "µ", "ª", "×", "a÷b", "«a»,", "a»."]
    parts += ["1", "12a", "a12.", "½", "\xa0", "a\xa0b", "\x85", "\x1c", "\x01", "\xad", "οΔΣ", "日本", "a​b", "<", "|", "</w>", "a</w>", "x" * 300, "\U0001f600", "K", "\n", "\t", ""]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randrange(30))) for _ in range(3000)] + [*parts, "a <|endoftext|> B", "<|ENDOFTEXT|>"]
    tokens, plain = token_output.Tokens(PATH, most), Tokenizer.from_file(PATH)
    assert tokens.model is not None
    for text, got in zip(texts, ids_of(tokens, texts)):
        assert got == plain.encode(text, add_special_tokens=False).ids, text
    assert len(tokens) <= max(1, most // 2) and len(tokens.old) <= max(1, most // 2) and not any(len(c) > tokens.LONG for c in tokens)


def test_other_tokenizers_take_no_short_cut():
    tokenizer = Tokenizer.from_file(PATH)
    assert token_output._cuts_words(tokenizer)
    tokenizer.normalizer = None
    assert not token_output._cuts_words(tokenizer)


def test_short_blocks_stay_below_the_static_entropy():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    ids = np.frombuffer(b"".join(token_output.Tokens(PATH).encode([(t or "").encode() for t in texts])), "<u2").astype(np.int64)
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    coded = rangecoder.encode(ids, 1024, 49408)
    assert sum(map(len, coded)) * 8 / len(ids) < -(p * np.log2(p)).sum()  # with its table, and what the ends of blocks take
    rng = np.random.default_rng(6)
    follow = np.tile(rng.integers(0, 49408, 64), 2000)  # order 1 and 2 know what order 0 does not
    assert sum(map(len, rangecoder.encode(follow, 1024, 49408))) * 8 / len(follow) < 1.5


def test_carries_and_narrow_intervals():
    rng = np.random.default_rng(7)
    for ids in (np.zeros(70_000, np.int64), np.where(rng.random(70_000) < 0.0001, rng.integers(0, 65536, 70_000), 65535), np.arange(65536), np.repeat(np.arange(256), 256)[::-1]):
        for size in (256, 1024, 4096):
            coded = rangecoder.encode(ids, size, 65536)
            counts = [size] * (len(coded) - 1) + [len(ids) - size * (len(coded) - 1)]
            assert (rangecoder.decode(coded, counts, size, 65536) == ids).all()
            table = rangecoder.table_of(coded[0], 65536)
            assert [rangecoder.carries_table(b) for b in coded[:2]] == [True, False][: len(coded)]
            assert (rangecoder.decode(coded[-1:], counts[-1:], size, 65536, table) == ids[len(ids) - counts[-1] :]).all()
    with pytest.raises(ValueError):
        rangecoder.decode(coded[1:], counts[1:], size, 65536)


def test_readers_may_take_fewer_blocks_at_once():
    rng = np.random.default_rng(8)
    stream = token_output._Stream(49408, 256, 8)
    want, data = [], b""
    for doc in range(60):
        ids = rng.integers(0, 300, rng.integers(1, 400))
        want.append(ids)
        stream.add(doc, ids.astype("<u2").tobytes())
        data += b"".join(b + token_output.SYNC for b in stream.blocks(False))
    data += b"".join(b + token_output.SYNC for b in stream.blocks(True))
    for lanes in (1, 3, 8, 2048):
        pieces = list(token_output.read_ids(data, lanes))
        assert [k for k, _ in pieces if k is not False] == list(range(60))
        assert (np.concatenate([i for _, i in pieces]) == np.concatenate(want)).all()
