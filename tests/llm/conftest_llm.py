import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # clashes with names that the operators make
    T.StructField("id", T.StringType()),
    T.StructField("key", T.LongType()),
    T.StructField("n_tokens", T.StringType()),
    T.StructField("kept", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("_m_key", T.StringType()),
])

WORDS = "amber birch cedar delta ember flint grove haven inlet jetty knoll ledge maple north ocean pearl quartz river stone tower".split()


def prose(seed, n):
    x, out = seed, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 50))
    return " ".join(out)


ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "Two words",
    "İstanbul ΣΑΣ 日本語 ́e😀 <|endoftext|> <|startoftext|> \x1c\x85",
    prose(5, 300),
    prose(5, 300),
    "x" * 5000 + " " + "ab " * 20000,
    " lead and trail ",
    "tab\tand\nline  two  spaces\n\n\nend ",
    "MIT License; licensed under the Apache License, Version 2.0. GNU General Public License, version 3 mit-license",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, extra columns with clashing names."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None if i % 5 else 7, "z", 1, "q", None, "s", "m") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[6], (6, "same id, other text", None, None, None, None, None, None, None, None, None), (None, "no id at all", None, "s1", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, odd):
    """Every document labelled: quality 0 for texts of signs, toxic 1 for the two that say so."""
    return spark.createDataFrame([(i, i % 2, int(i == 3)) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
