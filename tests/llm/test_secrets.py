"""Secret scans: the plain patterns against Python's re over characters, and what the lexer adds."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakwork.llm import secrets

PLAIN = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}


def plain(text):
    out = []
    for place, (kind, (pattern, group, least)) in enumerate(PLAIN.items()):
        out += [(m.start(), place, m.end(), kind) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def named(text):
    return [text[a:b] for a, b, kind in secrets.spans_of(text.encode())[1] if kind == "named"]


PIECES = ["password", "Passwd", "SECRET", "tok", "token", "api_key", "APIKEY", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "=", ":", " ", "  ", "'", '"', "é", "日本", "ſecret", "\n", "x", ".", "+/_-", "Zz9Zz9Zz9"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_plain_patterns(text):
    base, every = secrets.spans_of(text.encode())
    assert base == plain(text)
    assert [s for s in every if s[2] != "named"] == base


@pytest.mark.parametrize(
    "text, want",
    [
        ('db_pwd = "hunter2#9x!"', ["hunter2#9x!"]),
        ("DB_PASS='s3cr3t!pass'", ["s3cr3t!pass"]),
        ('{"client_secret_value": "p@55-w0rd!"}', ["p@55-w0rd!"]),
        ('conn["passphrase"] = "Tr0ub4dor&3"', ["Tr0ub4dor&3"]),
        ("aws_secret_access_key: wJalrXUtnFEMI/K7MDENG\n", ["wJalrXUtnFEMI/K7MDENG"]),
        ("password: str = 'qW3$rT6y!'", ["qW3$rT6y!"]),
        ('const privateKey = "Zx9!kLm2@Qw"', ["Zx9!kLm2@Qw"]),
        ('$token => "A1b2!C3d4"', ["A1b2!C3d4"]),
        ('connect(user="joe", password="aB3$eF6&")', ["aB3$eF6&"]),
        ('a = "Xy7!pQ2#mN"\nb = a\npassword = b', ["Xy7!pQ2#mN"]),
        ('password = b\nb = a\na = "Xy7!pQ2#mN"', ["Xy7!pQ2#mN"]),
        ('first = "Xy7!pQ2#"\nsecret_key = first + "mN4$vB8%"', ["Xy7!pQ2#", "mN4$vB8%"]),
        ('a = b\nb = a\ntoken = a\nb = "Xy7!pQ2#mN"', ["Xy7!pQ2#mN"]),
        # neither names nor values of this kind
        ('colour = "Xy7!pQ2#mN"', []),
        ('password = "changeme"', []),
        ('password = "your password here"', []),
        ('password_file = "Xy7!pQ2#mN"', []),
        ('password = "/etc/app/secret.txt"', []),
        ('password = "${DB_PASSWORD}"', []),
        ("password = os.environ.get2", []),
        ('if password == "Xy7!pQ2#mN":', []),
        ("The password: please choose a good one", []),
        ("Token: see http://example.org/x1", []),
    ],
)
def test_names_and_literals(text, want):
    assert named(text) == want


def test_spans_inside_plain_ones_are_not_added():
    text = 'password = "abcdefGH1234" and DB_PWD = "0123456789abcdef00"'
    assert [s[2] for s in secrets.spans_of(text.encode())[1]] == ["assign", "hex"]


def test_code_points():
    text = 'été 日本 passwort = "Xy7!pQ2#mNé"'
    ((a, b, kind),) = secrets.spans_of(text.encode())[1]
    assert kind == "named" and text[a:b] == "Xy7!pQ2#mNé"


def test_long_texts_take_linear_time():
    def took(n):
        text = "".join(f"name{i % 50} = name{(i + 1) % 50}\nx=\"y='z=\n" for i in range(n)) + " " * n + "token" * n + "a:" * n + '"' * n
        start = time.perf_counter()
        secrets.spans_of(text.encode())
        return time.perf_counter() - start

    took(500)
    assert took(16_000) < 60 * max(took(1000), 0.01)


def test_rows(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(60))) for _ in range(80)] + [None, "", 'pwd = "Xy7!pQ2#mN"'] * 2
    rows = [(rng.choice([i, 3, None]), t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = sorted((tuple(r) for r in secrets.report(df).collect()), key=repr)
    want = []
    for i, text, _ in rows:
        base = plain(text or "")
        every = secrets.spans_of((text or "").encode())[1]
        kinds = [k for _, _, k in every]
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        want.append((i, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, ",".join(f"{k}:{a}:{b}" for a, b, k in every), kinds.count("named")))
    assert got == sorted(want, key=repr)
    assert secrets.report(df.limit(0)).collect() == []
