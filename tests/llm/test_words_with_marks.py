"""Words before a final mark have the ids that the whole tokenizer gives them."""

import sys

import public_tokenizers
from tokenizers import Tokenizer

from tracetally.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_every_letter_before_a_point_or_comma():
    encode, plain = K.WordEncoder(PATH), Tokenizer.from_file(PATH)
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha() and not "\ud800" <= c <= "\udfff"]
    words = [b + c + t for c in letters for b in ("", "AL") for t in ".,"]
    for i in range(0, len(words), 20_000):
        part = words[i : i + 20_000]
        want = plain.encode_batch_fast(part, add_special_tokens=False)
        wrong = [w for w, e in zip(part, want) if encode(w) != b"".join(x.to_bytes(4, "little") for x in e.ids)]
        assert not wrong


def test_dotted_capital_i():
    encode, plain = K.WordEncoder(PATH), Tokenizer.from_file(PATH)
    text = "ALİ. was ALI. and ALİ, too"
    assert encode(text) == b"".join(x.to_bytes(4, "little") for x in plain.encode(text, add_special_tokens=False).ids)
