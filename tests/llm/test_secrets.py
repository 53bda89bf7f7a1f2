"""The automaton against Python's regular expressions, rule by rule."""

import random
import re

from tessera.llm import secrets as S

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def brute(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16])


def ours(text: str) -> list[tuple[int, int, int]]:
    one, data = S.scanner(), text.encode()
    found = one.spans(data)
    to = S.characters(data, sorted({x for s, _, e in found for x in (s, e)}))
    return [(to[s], k, to[e]) for s, k, e in found if k < 3]


def test_random_texts_agree_with_re():
    parts = ["token", "TOKEN", "password", "passwd", "secret", "api_key", "apikey", "API_KEY", '"', "'", " ", "  ", ":", "=", "==", "abcdef0123456789", "0123456789abcdefABC", "AKIA", "AKIAAKIA", "ABCDEFGHIJ0123456789", "xyz", "é", "ü€", "\n", "tok", "-", "short", "secret: ", "aaaaaaaaaaaa"]
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert ours(text) == brute(text), text


def test_a_failing_match_still_consumes_its_text():
    assert ours("token=secret: abcdefghijklmno") == brute("token=secret: abcdefghijklmno") == []


def test_further_rules_add_spans():
    one = S.scanner()
    text = b"-----BEGIN RSA PRIVATE KEY----- ghp_" + b"a1B2" * 9 + b" xoxb-1234567890ab"
    assert {one.kinds[k] for _, k, _ in one.spans(text)} >= {"key", "github", "slack"}


def test_query_rows(spark):
    docs = spark.createDataFrame([(1, "é token = \"abcdef0123456789\" x", "q"), (2, None, "q"), (3, "", None), (None, "AKIA" + "A" * 20, "q"), (1, "é token = \"abcdef0123456789\" x", "q")], "doc_id long, text string, spans string")
    got = sorted((r.asDict() for r in S.scan(docs).collect()), key=str)
    assert len(got) == 5
    one = [r for r in got if r["doc_id"] == 1]
    assert one[0] == one[1] and (one[0]["n_assign"], one[0]["n_hex"]) == (1, 1)
    assert one[0]["spans"] == "assign:2:27,hex:11:27"
    assert [r for r in got if r["doc_id"] == 2][0]["spans"] == ""
    assert S.scan(docs.limit(0)).count() == 0
