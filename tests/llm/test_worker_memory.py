"""F1 of round 3: workers remember no texts."""

import tracemalloc

import numpy as np
import pytest

from riskloom.llm.linking import gram_hashes, hashing, words_of
from riskloom.llm.queries import tokenizer_file

ODD = ["", " ", "  a  b ", "a\n\n b\t c", "don't, DON'T.", "x" * 3000, " " * 3000 + "y", "1,234.5 ²³", "ab c　 d", "日本語 text 🙂🙂", "<|endoftext|> a", "a<unk> <s>"]


def test_encoder_equals_the_library_and_remembers_nothing():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from riskloom.llm.packing import encoder

    path = tokenizer_file("byte_bpe_50k.json")
    library, encode = Tokenizer.from_file(path), encoder(path)
    rng = np.random.default_rng(4)
    mixed = ["".join(rng.choice(list("ab 1.,'\n\té🙂"), 60)) for _ in range(200)]
    for text in ODD + mixed:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    word_hash = hashing()
    tracemalloc.start()
    for i in range(300):
        text = " ".join(f"w{i}x{j}y" for j in range(100))
        encode(text)
        gram_hashes(words_of(text), 4, word_hash)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1 << 20
