"""The checks that decide whether a text is cut at its spaces agree with the two regular expressions they stand for."""

import random

import public_tokenizers

from quire.llm import token_store as K


def test_checks_agree_with_the_expressions():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        e = K.Encoder(f.read())
    r, found = random.Random(1), set()
    for _ in range(20_000):
        text = "".join(r.choice("abc.é中 \n\t\r\v\f\x01\x0e\x7f\x85") for _ in range(r.randrange(7)))
        want = bool(e.plain(text) and not e.gap(text))
        found.add(want)
        assert e._falls_apart(text) == want, repr(text)
    assert found == {True, False}
