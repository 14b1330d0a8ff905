from __future__ import annotations

import base64
import hashlib
import json
import re

from tidewatch.llm import secret_scan as S

DOCS = "doc_id long, text string, spans string, n_hex long"
EMPTY = hashlib.sha256(b"").hexdigest()


def der(tag, *parts):
    body = b"".join(parts)
    if len(body) < 128:
        return bytes([tag, len(body)]) + body
    size = len(body).to_bytes((len(body).bit_length() + 7) // 8)
    return bytes([tag, 0x80 | len(size)]) + size + body


def number(n, size=40):
    return der(2, b"\x11" * size if n is None else bytes([n]))


PKCS1 = der(0x30, number(0), *[number(None) for _ in range(8)])
PKCS8 = der(0x30, number(0), der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(5)), der(4, PKCS1))
SEC1 = der(0x30, number(1), der(4, b"k" * 32), der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
OPENSSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4) + x for x in (b"none", b"none", b"")) + b"\0\0\0\1" + b"z" * 60


def plain_base(text):
    """The base rules with the patterns as they are given."""
    flags = re.ASCII | re.IGNORECASE
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", m.start(), m.end()) for m in re.finditer(pattern, text, flags) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_matches_the_plain_patterns_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    found = S.secrets(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        base = plain_base(texts[r["doc_id"]] or "")
        kinds = [k for k, _, _ in base]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(map(kinds.count, ("assign", "access", "hex")))
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in found) > 10


def test_odd_texts_match_the_plain_patterns():
    texts = [
        "token=token: abcdefgh", "API_KEY : 'abc' apikey=\"abcdef\"", "ſecret=abcdefgh", "paKey token==abcdef",
        "é" * 5 + "AKIA" + "A" * 16 + "b" + "0" * 24, "AKIAAKIA" + "0" * 11, "f" * 23, "F" * 30 + "0a" * 12, "",
        "secret:\nabcdefgh", "password=abcde password=abcdef",
    ]
    for text in texts:
        assert sorted(S.base_spans(text)) == sorted(plain_base(text)), text


def test_structures_are_confirmed_and_lookalikes_are_not():
    def kinds(text):
        return [k for k, _, _ in S.confirmed_spans(text)]

    for key in (PKCS1, PKCS8, SEC1):
        packed = base64.b64encode(key).decode()
        assert kinds(f"see {packed} here") == ["key_base64"]
        assert kinds(f"see {key.hex()} here") == ["key_hex"]
        broken = base64.b64encode(key[:-1]).decode()
        assert kinds(f"see {broken} here") == []
        assert kinds(f"see {key[:-2].hex()} here") == []
    lines = "\n".join(re.findall(".{1,64}", base64.b64encode(PKCS8).decode()))
    start = "-----BEGIN PRIVATE KEY-----\n"
    (span,) = S.confirmed_spans(f"{start}{lines}\n-----END PRIVATE KEY-----\nThen words")
    assert span == ("key_base64", len(start), len(start) + len(lines))
    assert S.confirmed_spans(lines + "\nwords go on") == [("key_base64", 0, len(lines))]
    assert kinds(base64.b64encode(OPENSSH).decode()) == ["key_openssh"]
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    assert kinds(f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2lnbmVk") == ["jwt"]
    assert kinds(f"{part({'typ': 'JWT'})}.{part({'sub': 1})}.c2lnbmVk") == []
    assert kinds("eyJhbGciOiJ.eyJzdWIiOjF9.c2lnbmVk") == []
    assert kinds("x" * 200 + "ab" * 100) == []
    certificate = der(0x30, der(0x30, number(5)), der(0x30, der(6, b"\x2a\x03\x04")), der(3, b"\0" * 40))
    assert kinds(base64.b64encode(certificate).decode()) == []


def test_wrapped_escaped_and_listed_keys_are_found():
    for key in (PKCS1, PKCS8, SEC1):
        packed = base64.b64encode(key).decode()
        for width in (30, 64, 76):
            lines = re.findall(f".{{1,{width}}}", packed)
            forms = ["\\n".join(lines), "\\r\\n".join(lines), "\\\\n".join(lines), "\n    ".join(lines), "\n> ".join(lines)]
            forms += ['" +\n  "'.join(lines), "',\n'".join(lines), "\\n".join(lines).replace("/", "\\/")]
            for form in forms:
                text = f'é "-----BEGIN PRIVATE KEY-----\\n{form}\\n-----END PRIVATE KEY-----"'
                (span,) = S.confirmed_spans(text)
                assert span[0] == "key_base64" and text[span[1] : span[2]] == form
    first, second = (base64.b64encode(k).decode() for k in (PKCS8, SEC1))
    assert [k for k, _, _ in S.confirmed_spans(f"{first}\n{second}\n{first}")] == ["key_base64"] * 3
    other = base64.b64encode(bytes(range(200)) * 2).decode().rstrip("=")
    spans = S.confirmed_spans(f"{other}\n{second}")
    assert spans == [("key_base64", len(other) + 1, len(other) + 1 + len(second))]
    opened = "\\n".join(re.findall(".{1,70}", base64.b64encode(OPENSSH).decode()))
    assert [(k, b - a) for k, a, b in S.confirmed_spans(f"x\\n{opened}\\n-----END")] == [("key_openssh", len(opened))]


def test_null_empty_repeated_rows_and_clashing_columns(frame):
    token = "token=abcdefgh"
    rows = [(1, None, "x", 9), (2, "", "x", 9), (3, token, "x", 9), (3, token, "x", 9), (None, token, "x", 9)]
    found = sorted(map(str, (tuple(r) for r in S.secrets(frame(rows, DOCS)).collect())))
    digest = hashlib.sha256(b"assign:0:14").hexdigest()
    expected = [(1, 0, 0, 0, EMPTY, ""), (2, 0, 0, 0, EMPTY, "")] + [
        (i, 1, 0, 0, digest, "assign:0:14") for i in (3, 3, None)
    ]
    assert found == sorted(map(str, expected))
    assert S.secrets(frame([], DOCS)).count() == 0


def test_long_text_and_redaction(frame):
    secret = "secret: " + "0a" * 20
    text = "words and words " * 50_000 + secret + " é " + "AKIA" + "Z" * 16
    found = S.secrets(frame([(1, text, "", 0)], DOCS)).first()
    assert (found["n_assign"], found["n_access"], found["n_hex"]) == (1, 1, 1)
    shown = frame([(1, text, "", 0), (2, None, "", 0), (3, "clean", "", 0)], DOCS)
    out = {r["doc_id"]: r["t"] for r in shown.select("doc_id", S.redacted(shown["text"]).alias("t")).collect()}
    assert out[1] == "words and words " * 50_000 + "[secret] é [secret]"
    assert (out[2], out[3]) == (None, "clean")
