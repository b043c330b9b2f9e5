"""Secrets planted in real documents by forms that were written down apart from the operator: recall by form, and what stays alone."""

import random
import string

import pytest

from tidemark.llm import secrets

LETTERS, DIGITS = string.ascii_letters, string.digits
ALPHABETS = {
    "letters and digits": LETTERS + DIGITS,
    "printable": LETTERS + DIGITS + "!@#$%^&*?~-_+=.",
    "base64": LETTERS + DIGITS + "+/",
    "lower and digits": string.ascii_lowercase + DIGITS,
    "base32": string.ascii_uppercase + "234567",
}
#: Ways in which people and programs give away a value, and the share of values that must be found.
FORMS = {
    "the password is {} today": 0.95,
    "db_pass = {}": 0.7,
    "auth: {}": 0.7,
    "my key is {}": 0.65,
    "the token is {}": 0.9,
    "export API_KEY={}": 0.85,
    '  password: "{}",': 0.9,
    "Authorization: Bearer {}": 0.9,
    "secret\n{}\n": 0.85,
    "client secret was {}": 0.9,
}


@pytest.fixture(scope="module")
def prose(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text) > 500][:40]


def covered(raw: bytes, value: bytes) -> bool:
    """Nine tenths of the value lie in the values of spans."""
    at = raw.index(value)
    return sum(max(0, min(end, at + len(value)) - max(begin, at)) for _, _, end, begin in secrets.find(raw)) >= 0.9 * len(value)


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_recall_by_form(prose, alphabet):
    rng = random.Random(alphabet)
    for form, least in FORMS.items():
        found = 0
        for _ in range(60):
            value = "".join(rng.choice(ALPHABETS[alphabet]) for _ in range(rng.randint(16, 32)))
            text = rng.choice(prose)
            at = rng.randint(0, len(text))
            found += covered(f"{text[:at]}\n{form.format(value)}\n{text[at:]}".encode(), value.encode())
        assert found / 60 >= least, (form, found / 60)


@pytest.mark.parametrize(
    "text, values",
    [
        ("the password is Tr0ub4dor&3xKq9!mZ today", ["Tr0ub4dor&3xKq9!mZ"]),
        ("db_pass = Q7xT2vLp9ZkR4mWcY8bN", ["Q7xT2vLp9ZkR4mWcY8bN"]),
        ("auth: Q7xT2vLp9ZkR4mWcY8bN", ["Q7xT2vLp9ZkR4mWcY8bN"]),
        ("my key is Q7xT2vLp9ZkR4mWcY8bN", ["Q7xT2vLp9ZkR4mWcY8bN"]),
        ("the token is a1b2.c3d4e5.f6g7h8i9j0kZ", ["a1b2.c3d4e5.f6g7h8i9j0kZ"]),
    ],
)
def test_said_values(text, values):
    assert [text[a:b] for a, _, b, _ in secrets.find(text.encode())] == values


@pytest.mark.parametrize(
    "text",
    ["key: 2024-05-01T10:00:00Z", "auth: John.Doe99@example.com", "token = getToken(User1Name2)", "Key: https://Example.com/a1B2c3d4e5", "The key is that 3rdGenerationSystem5 works", "key: 123e4567-e89b-12d3-a456-426614174000", "Monkey: gorilla-orangutan-bonobo", "pass: ../Some/Path1/To2/File3", "The turkey is unbelievable-and-extraordinary"],
)
def test_what_is_no_secret(text):
    assert secrets.find(text.encode()) == []


def test_documents_without_planted_secrets_are_left_alone(spark):
    """All spans of the given documents are those of the base patterns."""
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        assert all(kind < 3 for _, kind, _, _ in secrets.find((r.text or "").encode()))
