import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, w string, key string"


@pytest.fixture
def store(spark, tmp_path):
    """Write small tables, the documents with extra columns whose names operators use inside."""

    def write(documents=None, benchmark=(), pages=None, embeddings=None):
        root = str(tmp_path)
        if documents is not None:
            rows = [(d, t, lang, source, None if t is None else len(t), "x", "y", "z") for d, t, lang, source in documents]
            spark.createDataFrame(rows, DOC).write.mode("overwrite").parquet(f"{root}/documents.parquet")
            spark.createDataFrame(list(benchmark), "item_id long, text string").write.mode("overwrite").parquet(f"{root}/benchmark.parquet")
        if pages is not None:
            spark.createDataFrame(pages, "page_id long, url string, html string, payload string, file string").write.mode("overwrite").parquet(f"{root}/pages.parquet")
        if embeddings is not None:
            spark.createDataFrame(embeddings, "vec_id long, embedding array<float>, label int, block int").write.mode("overwrite").parquet(f"{root}/embeddings.parquet")
        return root

    return write


LONG = " ".join(f"word{i % 977} Étude{i}" for i in range(20_000))
PASSAGE = "the quick brown fox jumps over the lazy dog and runs far away from the very old barking hound today"


@pytest.fixture
def odd_documents():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    copy = "one two three four five six seven eight nine ten eleven twelve " * 5
    return [
        (1, copy, "en", "a"),
        (2, copy, "en", "a"),
        (2, copy, "en", "a"),
        (3, copy + "and a little more", "en", None),
        (4, None, "en", "b"),
        (5, "", None, "b"),
        (6, " \t\n ", "de", ""),
        (7, "!!! ??? 12 34", "fr", "c"),
        (8, LONG, "en", "c"),
        (9, f"Intro words. {PASSAGE.upper()} — outro. {PASSAGE}", None, "d"),
        (None, "a text without a number, under the MIT license", "en", "a"),
        (10, "tiny text", "es", "é"),
        (11, "tiny text", "es", "é"),
    ]
