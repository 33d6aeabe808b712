"""Personal data in very long texts, and values that earlier patterns cut short."""

from __future__ import annotations

import time

import pytest

from corpusgraph.llm import pii

FOUND = {
    "account number: 1234 5678 9012 3456 7890 1234 5678 9012 3456 7890 1234 5678 end": "account number: [ACCOUNT] end",
    f"account: {'1' * 50} x": "account: [ACCOUNT] x",
    "account: ABCDE1234567 ok": "account: [ACCOUNT] ok",
    "IBAN GB82 WEST 1234 5698 7654 32 and": "IBAN [ACCOUNT] and",
    "ACCOUNT 12345678 PLEASE CALL 5 TIMES": "ACCOUNT [ACCOUNT] PLEASE CALL 5 TIMES",
    "IBAN 12 ACCOUNT 1234567": "IBAN 12 ACCOUNT [ACCOUNT]",
    "password: p@ssw0rd123, next": "password: [SECRET], next",
    "pwd=ab1!@cd%xyz99": "pwd=[SECRET]",
    "password: correct-horse-battery": "password: [SECRET]",
    "secret: 12345678": "secret: [SECRET]",
    'api_key: "onlyletterskey" z': 'api_key: "[SECRET]" z',
    "http://me:pw@h.org/x?y, http://h.org/z@q": "[URL], http://h.org/z@q",
}
CLEAN = ["password: protected content", "the token of love", "password reset link", "account manager", "IBAN DE89370400440532013001", "see http://h.org/a@b"]
LONG = {
    "addresses": lambda k: f"http://u{k}:p@h{k}.org/x,",
    "mails": lambda k: f"user{k}@host{k}.org,",
    "tel": lambda k: "tel:",
    "schemes": lambda k: "a://@",
    "accounts": lambda k: "account 1 ",
    "ACCOUNTS": lambda k: "ACCOUNT 1 ",
    "ibans": lambda k: "IBAN 12 ",
    "secrets": lambda k: "token=x@,",
    "quoted": lambda k: 'password="',
    "digits": lambda k: "account 1234 ",
}


@pytest.mark.parametrize("text", FOUND)
def test_values_are_redacted_whole(text):
    assert pii.redacted(text) == FOUND[text]


@pytest.mark.parametrize("text", CLEAN)
def test_what_is_no_value_stays(text):
    assert pii.redacted(text) == text


def _seconds(text: str) -> float:
    start = time.process_time()
    pii.find(text)
    return time.process_time() - start


@pytest.mark.parametrize("kind", LONG)
def test_time_is_linear_in_the_text(kind):
    texts = ["".join(LONG[kind](k) for k in range(n)) for n in (20_000, 80_000)]
    once, four = (min(_seconds(x) for _ in range(2)) for x in texts)
    assert four < 9 * once + 1  # quadratic work would take sixteen times as long


def test_a_text_of_20_mb():
    text = "".join(f"http://u{k}:p@h{k}.org/x,tel:+{k}," for k in range(600_000))
    assert len(text) > 20_000_000 and _seconds(text) < 120
