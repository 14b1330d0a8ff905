"""Spans of confirmed keys whatever follows them, and that the work grows with the text."""

from __future__ import annotations

import base64
import random
import re
import time

import pytest
from test_llm_secrets import PKCS1, PKCS8, SEC1, der, number

from tidewatch.llm import secret_scan as S


def field(data):
    return len(data).to_bytes(4) + data


def openssh(private):
    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + b"\0\0\0\1" + field(b"k" * 51) + field(private)


def wrapped(letters, width, between="\n"):
    return between.join(re.findall(f".{{1,{width}}}", letters))


@pytest.mark.parametrize("extra", range(3))
@pytest.mark.parametrize("tail", ["", "\nThens words", "\nThen words", "\nMIIBVQIBADANBgkq", "\n-----END OPENSSH PRIVATE KEY-----", " x"])
def test_an_openssh_key_ends_by_its_own_lengths(extra, tail):
    body = wrapped(base64.b64encode(openssh(b"s" * (300 + extra))).decode(), 70)
    text = f"é\n{body}{tail}"
    assert S.confirmed_spans(text) == [("key_openssh", 2, 2 + len(body))]
    assert S._redact(text, "*") == f"é\n*{tail}"


def test_a_cut_openssh_key_goes_as_far_as_its_lines():
    body = wrapped(base64.b64encode(openssh(b"s" * 300)).decode()[:400], 70)
    assert S.confirmed_spans(body + "\n\n") == [("key_openssh", 0, len(body))]
    assert S.confirmed_spans(wrapped(base64.b64encode(b"openssh-key-v2\0" + b"\0" * 300).decode(), 70)) == []


def test_keys_of_all_lengths_and_forms_are_whole():
    rng = random.Random(1)
    for size in range(40, 60):
        key = der(0x30, number(0), *[number(None, size) for _ in range(8)])
        letters = base64.b64encode(key).decode()
        for between in ("\n", "\\n", "\n    ", '" +\n  "', "\\r\\n"):
            body = wrapped(letters, rng.choice([20, 64, 76]), between)
            for tail in ("", "\nmore words", '"', between + "-----END"):
                text = f'x "{body}{tail}'
                assert S.confirmed_spans(text) == [("key_base64", 3, 3 + len(body))], (size, between, tail)
                assert not re.search(r"[A-Za-z0-9+/]{16}", S._redact(text, "*"))


def test_wrapped_hex_is_found():
    for key in (PKCS1, PKCS8, SEC1, der(0x30, number(1), der(4, b"k" * 32))):
        for form in (key.hex(), key.hex().upper(), wrapped(key.hex(), 32), wrapped(key.hex(), 64, "\n  ")):
            text = f"key = {form}\nnext"
            assert S.confirmed_spans(text) == [("key_hex", 6, 6 + len(form))]
        assert S.confirmed_spans(wrapped(key.hex()[:-2], 64)) == []
        assert S.confirmed_spans(key.hex() + "00") == []
    assert S.confirmed_spans("3045" + "00" * 69) == []


LINES = ["b3BlbnNz", "MIN///8wDQYJKoZI", "MIIEowIBAAKCAQEA", "b3BlbnNzaC1rZXktdjEA", "3082" + "02" * 14, "MAAAAAAAAAAA"]


@pytest.mark.parametrize("line", LINES)
def test_time_doubles_when_the_text_doubles(line):
    def seconds(n):
        text = "\n".join([line] * n)
        started = time.perf_counter()
        S.confirmed_spans(text)
        return time.perf_counter() - started

    seconds(1000)
    small = min(seconds(20_000) for _ in range(3))
    assert min(seconds(80_000) for _ in range(2)) < 10 * small  # in proportion it is 4, with the square 16
    assert seconds(40_000) < 5


def test_a_long_text_of_keys_is_read_once():
    packed = [base64.b64encode(k).decode() for k in (PKCS1, PKCS8, SEC1)]
    text = "\n".join(packed * 400)
    started = time.perf_counter()
    spans = S.confirmed_spans(text)
    assert time.perf_counter() - started < 10
    assert [text[a:b] for _, a, b in spans] == packed * 400
