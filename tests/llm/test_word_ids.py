"""Ids word by word against the whole tokenizer."""

from __future__ import annotations

import random

import numpy as np
from tokenizers import Tokenizer

from canopyflow.llm import packing

PARTS = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|", "|>", "İ", "ı", "ǰ", "ß", "É", "e\u0301",
         "\u0307", "straße", "Word", "WORD", "don't", "It's", "I'LL", "12", "3.5", "a", "Z", "日本", "\u200d", "😀", "é", "ΑΣ", "ς", "ﬁ", "\u00a0"]
JOINS = ["", "", "", " ", " ", "\t", "\n", ".", ",", ";", ":", "!", "?", "?!", "'", "-", "_"]


def test_ids_equal_the_whole_tokenizer():
    rng = random.Random(31)
    texts = ["".join(rng.choice(PARTS) + rng.choice(JOINS) for _ in range(rng.randint(1, 9))) for _ in range(30_000)]
    texts += [p + j for p in PARTS for j in JOINS] + ["", " ", "\n\n"]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.WordIds(packing.default_tokenizer()).encode(texts)
    for text, ids, coded in zip(texts, got, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == coded.ids, text
