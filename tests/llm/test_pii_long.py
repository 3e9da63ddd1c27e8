"""Personal data in texts that strain a regular expression's stack or time."""

import re

import pytest

from vismatch.llm import pii

PIECES = ["a@b" + ".c" * 5_000 + " ", "a@b" + ".c" * 130 + " ", ".c", "a.", "a@", "a@b.", "a@b.c", "%+-", "-", "@", "1999-01-01", "1999-", "123-", "123-45-6789", "+", "+1", "+12 (3) ", "(1) ", "(123) 456-7890", "1", "1.", "10.0.0.1 ", "10.0.0.1.", "4111 ", "4111-1111-", "0123456789abcdef", "0123456789ABCDEF ", "é@é.é", " "]


def test_no_text_ends_a_jvm(spark):
    size = 1_000_000
    texts = ["a@b" + ".c" * 5_000, "x" * size + "@b.c", "a@" + "b" * size + ".c", "a@b." + "c" * size] + [p * (size // len(p)) for p in PIECES]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    made = {r.doc_id: r.text for r in pii.pseudonymise(frame, "k").collect()}
    found = {r.doc_id: r for r in pii.find_private(frame, "k").collect()}
    assert len(made) == len(texts) and all(len(made[i]) >= 0.9 * len(t) for i, t in enumerate(texts))
    assert all(made[i] != texts[i] and found[i].n_email == 1 for i in range(2, 4)) and found[0].n_email == 1
    plain = re.compile(pii.PATTERN)
    for i in (0, 2, 3, 4, 5, 14, 22):
        assert sum(found[i][f"n_{k}"] for k in pii.KINDS) <= len(plain.findall(texts[i])) if i in found else True


@pytest.mark.parametrize("text,n", [("10.1.1.1", 1), ("010.1.1.1", 0), ("10.001.1.1", 0), ("10.1.01.1", 0), ("0.0.0.0", 1), ("10.1.1.00", 0), ("256.1.1.1", 0), ("255.255.255.255", 1)])
def test_octets_have_no_leading_zeros(spark, text, n):
    frame = spark.createDataFrame([(1, f"at {text} now")], "doc_id long, text string")
    assert sum(r.n_ip for r in pii.find_private(frame, "k").collect()) == n
    made = pii.pseudonymise(frame, "k").first().text
    assert (made != f"at {text} now") == bool(n)
    again = pii.pseudonymise(spark.createDataFrame([(1, made)], "doc_id long, text string"), "k").first().text
    assert n == 0 or re.fullmatch(r"at (?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2}) now", again)
