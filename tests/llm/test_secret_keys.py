"""Planted keys of every encoding, bare and as name=value, among ordinary runs: which spans op4 adds."""

import random

import pytest

from strandline.llm.secrets import ALPHABETS, battery, encoding_of, find_secrets, pieces

SCHEMA = "doc_id long, text string"
WORDS = "internationalization/and_localization settings_of_the_reader THE_DEFAULT_TIMEOUT_SECONDS responsibilities=characteristics src/main/resources-of/the_application"
FORMS = ["{}", "AWS_ACCESS_NAME={}", "https://x.org/a?sig={}&b=1", "-----/+={}"]


def key(r, name, n):
    return "".join(r.choice(ALPHABETS[name]) for _ in range(n))


@pytest.mark.parametrize("name", ALPHABETS)
def test_planted(spark, name):
    r = random.Random(name)
    docs, want = [], {}
    for i in range(80):
        # Digits and lower-case hex of 32 or more are spans of the fixed patterns.
        k, form = key(r, name, {"decimal": 31, "hex": 31}.get(name, 64)), FORMS[i % len(FORMS)]
        text = f"{WORDS} {form.format(k)} {WORDS}"
        want[i] = f"{text.index(k)}:{text.index(k) + len(k)}"
        docs.append((i, text))
    got = {x["doc_id"]: x["spans"] for x in find_secrets(spark.createDataFrame(docs, SCHEMA)).collect()}
    for form in range(len(FORMS)):
        mine = [i for i in want if i % len(FORMS) == form]
        assert sum(f"random:{want[i]}" in got[i].split(",") for i in mine) >= 0.85 * len(mine)
    # A planted key and at most a few in a hundred besides.
    assert sum(len(x.split(",")) for x in got.values() if x) <= 1.05 * len(docs)


@pytest.mark.parametrize("name", ALPHABETS)
@pytest.mark.parametrize("n", [24, 40, 64])
def test_random_keys_fit(name, n):
    r = random.Random(f"{name} {n}")
    assert sum(battery(key(r, name, n)) is None for _ in range(1500)) <= 0.03 * 1500


def test_pieces():
    def cut(text, spans=()):
        return [text[s:e] for s, e in pieces(text, list(spans))]

    a, b = "a1B2c3D4e5F6g7H8i9J0k", "Z9y8X7w6V5u4T3s2R1q0P"
    assert cut(f"{a}={b}== {a}") == [a, f"{b}==", a]
    assert cut(f"={a}=={b}") == [a, b]
    assert cut(f"{a}+{b}") == [f"{a}+{b}"]
    assert set(cut(f"{a}/{b}-x")) == {a, f"{a}/{b}", b, f"{b}-x"}
    assert cut(f"{a}{'0' * 32}{b}", [(len(a), len(a) + 32, "hex")]) == [a, b]
    assert cut(f"{a} {b}", [(0, 5, "assign"), (2, 4, "hex"), (3, len(a) + 1, "hex")]) == [b]
    assert encoding_of("ABCDEF0189") == "hex_upper" and encoding_of("xyz0189") == "base36" and encoding_of("XYZ0189") == "base36_upper" and encoding_of("XYZ234") == "base32"
