import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and long texts, ties, repeated rows, clashing column names.
LONG = "\n".join(" ".join(f"w{i % 977}x{i % 31}" for i in range(k, k + 50)) for k in range(0, 30_000, 50))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu\nshort line\nsecond paragraph with quite a few words here", "en", "src0"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu\nshort line\nsecond paragraph with quite a few words here", "en", "src1"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu\nshort line\nsecond paragraph with quite a few words here", "en", "src1"),
    (3, None, "de", None), (4, "", None, "src0"), (5, "   \n\t\n ", "fr", "src2"), (6, LONG, "en", "src0"), (7, LONG + " tail", "en", "src0"),
    (None, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "src0"), (8, "one", "en", "src3"), (9, "ONE", "en", "src3"),
    (10, "mail a.b@c.example.com and +1 (523) 555-1055 at 10.0.0.1, 999.1.1.1 card 4111 1111 1111 1111 token = \"abcdefgh12345\" AKIAABCDEFGHIJKL12 é 4242-4242-4242-4242", "en", "src4"),
    (11, "0123456789abcdef0123456789abcdef and x@y a@b.c@d.ef 1.2.3.4.5.6.7.8 password: short api_key=LONGENOUGH1 SECRET='zzzzzzzz'", "en", "src4"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, len(r[1]) if r[1] is not None else None) for r in ROWS]
    # columns whose names operators use themselves
    return spark.createDataFrame([(*r, "k", 1, "x") for r in rows], SCHEMA + ", bucket string, size int, fp string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
