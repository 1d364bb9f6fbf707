import pytest


@pytest.fixture(scope="session")
def corpus(spark, sf):
    """The smallest documents with edge rows: nulls, blanks, copies, repeated rows, a long text, clashing columns."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    shared = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    extra = [
        (100_001, None, "en", "src0"), (100_002, "", None, None), (100_003, " \t\n ", "en", "src1"), (100_004, "one", "en", "src1"),
        (100_005, "one", "en", None), (100_006, long, "en", "src1"), (100_007, long, "en", "src1"), (100_008, f"Before {shared} after", "en", "src2"),
        (100_009, f"Other start {shared}\nother end", "de", "src2"), (100_010, f"{shared} {shared}", "en", "src3"),
        (100_010, f"{shared} {shared}", "en", "src3"), (None, f"{shared} no id", None, "src3"), (None, None, None, None),
        (100_011, "é ü 日本語 　 a b ▁ x  y   z \u0000 12345 !!! <|endoftext|> <s> 😀", "fr", "src4"),
        (100_012, "  lead and trail  ", "es", "src4"), (100_013, "12345 67890 --- !!!", "en", "src4"),
    ]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, source string")
    for name in ("score", "ids", "n_words", "kept", "id", "cls", "row", "spans", "copies", "length"):
        frame = frame.selectExpr("*", f"'own' as `{name}`")
    return frame.selectExpr("*", "timestamp'2024-01-01 00:00:00' AS seen", "array(1, null) AS list", "map('a', 1) AS pairs")


@pytest.fixture(scope="session")
def plain(corpus):
    """Rows of the corpus as (doc_id, text, lang, source)."""
    return [tuple(r) for r in corpus.select("doc_id", "text", "lang", "source").collect()]
