import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, component int, _key string, _row int, _new string, hash string, shard int, good int, label_id long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of documents out of texts (or (doc_id, text) pairs), with columns of clashing names."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(k, t, (None, "en", "de")[i % 3], (None, "src0", "src0", "src5", "other")[i % 5], i, "n", 1, "k", 2, "w", "h", 3, 4, 5) for i, (k, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Texts that every operator must take: null, empty, blank, short, repeated, very long, with odd characters.
ODD = [None, "", " \n\t ", "one", "one two three four five six seven", "one two three four five six seven", "ONE two three four five six seven", "é ü 😀 　 \x00  x", "word " * 30_000, "x" * 60_000, "a  b\n\n c \r\n d", "<s> <unk> <|endoftext|> </s>"]


@pytest.fixture
def odd(docs):
    return docs([*enumerate(ODD), (None, "no id at all here"), (4, ODD[4]), (None, None)])
