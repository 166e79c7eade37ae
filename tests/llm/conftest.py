import pytest

PROSE = "the small river runs past old mills and over stones where children used to look for crabs on warm evenings in late spring before the long road was built"


@pytest.fixture(scope="session")
def docs_rows():
    """Rows (doc_id, text, keep_id clash, n_words clash): copies, near copies, ties and odd texts."""
    words = PROSE.split()
    long = " ".join(words[(i * 7) % len(words)] + str(i % 977) for i in range(30_000))
    near = PROSE.replace("crabs", "shells")
    texts = [
        (0, PROSE), (1, PROSE), (2, near), (3, None), (4, ""), (5, " \n\t "), (6, "Of."), (7, "Of."), (8, long), (9, long + " end"),
        (10, "first line here now\n" + PROSE), (11, "THE!! BIG!! SALE!! NOW!! " * 20), (12, "word " * 300), (13, "a\nb\na\n\nb\na"),
        (14, "x*** y### z&&& " * 30), (15, "日本語 テキスト 😀 ok"), (15, "日本語 テキスト 😀 ok"), (16, PROSE + "\n" + PROSE.upper()),
        (17, "mail a.b@c.de and +1 (456) 555-2186 or 4111 1111 1111 1111 at 10.0.0.1"), (18, "\x00odd\x0bcontrol\x0ctext"), (19, PROSE + " " + near),
    ]
    return [(i, t, "clash", -1.5) for i, t in texts]


SCHEMA = "doc_id long, text string, keep_id string, n_words double"


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
