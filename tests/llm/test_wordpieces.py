"""Ids by pieces against the library's own."""

import random

import numpy as np
import public_tokenizers
import tokenizers

from foliosift.llm import wordpieces

PATH = public_tokenizers.path("word_bpe_49k.json")
LATIN = [chr(c) for c in (9, 10, 13, *range(0x20, 0x100)) if wordpieces.PLAIN_TEXT.fullmatch(chr(c))]


class Counting:
    """The library's tokenizer; counts the texts that get an encoding of their own."""

    asked = 0

    def __init__(self, path):
        self.whole = LIBRARY.from_file(path)
        self.model = self.whole.model

    @classmethod
    def from_file(cls, path):
        return cls(path)

    def encode_batch_fast(self, texts, **options):
        Counting.asked += len(texts)
        return self.whole.encode_batch_fast(texts, **options)


LIBRARY = tokenizers.Tokenizer


def test_latin_texts_need_no_encoding(monkeypatch):
    draw = random.Random(5)
    texts = ["".join(draw.choices(LATIN, k=draw.randint(0, 60))).replace("<|", "<") for _ in range(3000)]
    expected = [np.array(e.ids, "<u4").tobytes() for e in LIBRARY.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    monkeypatch.setattr(wordpieces, "_encoders", {})
    Counting.asked = 0
    assert wordpieces.encoder(PATH)(texts) == expected
    assert Counting.asked == 0
    odd = ["<|endoftext|>", "a <|x é", "日本 go", "İx Σς", "é é"]
    assert wordpieces.encoder(PATH)(odd) == [np.array(e.ids, "<u4").tobytes() for e in LIBRARY.from_file(PATH).encode_batch(odd, add_special_tokens=False)]
    assert Counting.asked > 0
