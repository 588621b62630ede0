import random
import re

from aeroledger.llm.queries import secret_digest
from aeroledger.llm.secret_scan import BASE_KINDS, KINDS, automaton, checksum62, redact, spans_of

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def brute(text):
    found = []
    for i, kind in enumerate(BASE_KINDS):
        pattern, group, least = BASE[kind]
        found += [(m.start(), i, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def test_base_kinds_equal_the_expressions():
    random.seed(4)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "=", ": ", " = ", '"', "'", "AKIA", "ABCDEF0123456789", "a", "f" * 31,
            "f" * 32, "0123456789abcdef", " ", "\n", "İ", "ſecret", "é", "x" * 8, "toKen=", "-", "g"]
    words = automaton()
    for _ in range(3000):
        text = "".join(random.choices(bits, k=random.randrange(25)))
        assert [s for s in spans_of(text, words) if s[1] < 3] == brute(text), text


def test_checksums():
    body = "abcdefghij0123456789ABCDEFGHIJ"
    good, bad = f"ghp_{body}{checksum62(body)}", f"ghp_{body}000000"
    assert [KINDS[k] for _, k, _ in spans_of(f"x {good} {bad} npm_{body}{checksum62(body)}", automaton())] == ["github", "npm"]
    assert checksum62("") == "000000"


def test_digest_and_redaction(spark, documents, rows):
    long = "word " * 100_000 + "AKIA" + "A" * 16
    table = documents((1, "token = 12345678, secret: é"), (2, None), (3, ""), (4, long), (4, long), (None, "f" * 40))
    found = secret_digest(table)
    assert found.count() == 6
    got = rows(found)
    assert got[1]["spans"] == "assign:0:16" and (got[1]["n_assign"], got[1]["n_hex"]) == (1, 0)
    assert got[2]["base_sha256"] == got[3]["base_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert got[4]["spans"] == "access:500000:500020" and got[None]["n_hex"] == 1
    clean = redact(table)
    assert clean.columns == table.columns
    got = rows(clean)
    assert got[1]["text"] == "[secret], secret: é" and got[2]["text"] is None and got[1]["token"] == "x"
    assert got[4]["text"].endswith(" [secret]")
    assert secret_digest(documents()).count() == redact(documents()).count() == 0
