"""op9's encoder: a word that was met before is not encoded again, whatever symbols follow it, and ids are those of the library."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quire.llm import token_store as K


class Counted:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, lib):
        self.lib, self.seen = lib, []

    def encode(self, text, **k):
        self.seen.append(text)
        return self.lib.encode(text, **k)

    def encode_batch(self, texts, **k):
        self.seen += texts
        return self.lib.encode_batch(texts, **k)

    def encode_batch_fast(self, texts, **k):
        self.seen += texts
        return self.lib.encode_batch_fast(texts, **k)


def content():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_words_are_encoded_once():
    e, lib = K.Encoder(content()), Tokenizer.from_str(content())
    e.encode(["x unlikelyword été. a*** a,% a,\nunlikelyword\nété"])
    for name in ("tokenizer", "model"):
        setattr(e, name, Counted(getattr(e, name, None)))
    text = "x unlikelyword*** été, unlikelyword,%\nunlikelyword. a,\nété***"
    ids, n = e.encode([text])
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids)]
    assert e.tokenizer.seen + e.model.seen == ["x"]


def test_ids_are_those_of_the_library():
    e, lib, r = K.Encoder(content()), Tokenizer.from_str(content()), random.Random(3)
    bits = ["word", "Wort", "été", "ñandú", "слово", "ΑΩ", "ª", "x", "12", "½", "²", "'s", "'", "***", ".", "!?", "\x7f", "…", "€", "×", "_", "`", "~", "\t", "<|endoftext|>", "中", "é"]
    gaps, cut = [" "] * 8 + ["\n", "\n", "  ", "\n\n", " \n"], 0
    for _ in range(30):
        texts = ["".join(r.choice(["", " ", "\n"]) + "".join(r.choices(bits[: r.choice([8, 24, 27])], k=r.randrange(4))) + r.choice(gaps[: r.choice([10, 13])]) for _ in range(r.randrange(12))).strip(r.choice(["", " ", "\n "])) for _ in range(60)]
        cut += sum(map(e._falls_apart, texts))
        texts += ["a\n", "a ", "a \x01b", "\n", " ", ""]
        ids, n = e.encode(texts, np.array([2], "<u4").tobytes())
        want = [[*x.ids, 2] for x in lib.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    assert 300 < cut < 1700
