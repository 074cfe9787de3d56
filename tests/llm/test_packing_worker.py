"""F1 of round 3: what a packing worker loads and keeps."""

import pytest

from riskloom.llm.queries import tokenizer_file


def test_a_packing_worker_loads_the_library_for_special_strings_only(monkeypatch):
    pytest.importorskip("public_tokenizers")
    import sys

    import numpy as np
    from tokenizers import Tokenizer

    from riskloom.llm.common import forget
    from riskloom.llm.packing import encoder

    path = tokenizer_file("byte_bpe_50k.json")
    shelf = sys.__dict__.setdefault("_riskloom_llm_objects", {})
    shelf.pop(f"tokenizer:{path}", None)
    encode = encoder(path)
    encode("plain text, nothing special")
    assert f"tokenizer:{path}" not in shelf
    odd = "a <|endoftext|> b"
    assert np.frombuffer(encode(odd), "<u4").tolist() == Tokenizer.from_file(path).encode(odd, add_special_tokens=False).ids
    assert f"tokenizer:{path}" in shelf
    forget(objects=True)
    assert not shelf
