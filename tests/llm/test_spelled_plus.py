"""What decides whether the transducers run sees every text that they change."""

import random

from tracetally.llm import pii


def added(text):
    return pii.hidden_spans(text, pii.base_spans(text))


def test_plus_before_plain_digits():
    text = "call plus 49 170 1234567"
    (kind, start, end), = added(text)
    assert kind == "phone" and text[start:end] == "plus 49 170 1234567"


def test_number_does_not_depend_on_other_disguises():
    for text in ("Plus 49 170 1234567", "tel:plus 49 170 1234567", "plus 1 555 oh-oh-5 1234", "5oh,oh,1"):
        lone = added(text)
        assert [x for x in added(text + " mail [at] host") if x[2] <= len(text)] == lone


def test_hint_sees_all_changes():
    rng = random.Random(8)
    parts = ["plus", "PLUS", "oh", "one", "Nine", "4", "49", "1a", "a", "_", "at", "dot", "[at]", "(dot)", "{ . }", "x.y", "-", ","]
    changed = 0
    for _ in range(20_000):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", "", ",", "-"]) for _ in range(rng.randrange(1, 9)))
        if list(pii.spelled(text)) or list(pii.disguises(text)):
            changed += 1
            assert pii.HINT.search(text), text
    assert changed > 1000
