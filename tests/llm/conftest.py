import pytest

LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, short, very long, repeated and tied rows, and columns whose names operators use themselves."""
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b\f\r ", "en", None, 7),
        (4, "One", None, "a", 3),
        (5, LONG, "en", "b", len(LONG)),
        (6, "The same text of a few words, for a tie. ünïcode 中文 🙂 <|endoftext|>  two  spaces\r\n\n end ", "de", "b", 80),
        (6, "The same text of a few words, for a tie. ünïcode 中文 🙂 <|endoftext|>  two  spaces\r\n\n end ", "de", "b", 80),
        (7, "The same text of a few words, for a tie. ünïcode 中文 🙂 <|endoftext|>  two  spaces\r\n\n end ", "de", "c", 80),
        (None, "A text without an id", "en", "c", 20),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("size", "target", "taken", "shard", "places", "n_words", "kept", "toxic", "score", "predicted", "ids", "digest", "offset", "n_tokens", "label", "word", "uid", "severity"):
        df = df.withColumn(name, df.n_chars.cast("string"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture
def folder(odd, tmp_path):
    """sf_dir with the odd documents."""

    def make(df=odd, name="documents"):
        df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make
