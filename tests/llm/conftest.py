import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_with_edges():
    """Nulls in each column, empty and very long texts, repeated rows, other capitals, marks and scripts."""
    rng = random.Random(7)
    words = ["house", "river", "stone", "night", "under", "green", "letter", "sing", "walk", "bright", "cold", "early"]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))

    passage = prose(60)
    rows = [(i, prose(rng.randint(1, 120)), "en", "s0", 0) for i in range(40)]
    rows += [(40, None, None, None, None), (41, "", "en", "s1", 0), (None, "no id here", "en", None, 1),
             (42, passage, "en", "s0", 0), (43, prose(20) + " " + passage + " " + prose(20), "de", "s0", 0),
             (44, passage.upper(), "en", "s0", 0), (45, passage, "en", "s0", 0), (45, passage, "en", "s0", 0),
             (46, prose(9000), "en", "s0", 0), (47, "x" * 30_000, "en", "s0", 0), (48, " " * 5000 + "end", "fr", "s0", 0),
             (49, "é́ ΣΑΣ 中文 😀 ½ <|endoftext|> it's\x85 x", "fr", "s0", 0), (50, "12 34 !?", "en", "s0", 0),
             (51, "na " * 300, "en", "s0", 0), (52, None, "en", "s0", 0)]
    return rows


@pytest.fixture(scope="session")
def edge_rows():
    return rows_with_edges()


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows over three partitions, with more columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows, SCHEMA).repartition(3, "n_chars", "text")
    return docs.withColumns({c: F.lit("clash") for c in (
        "score", "kept", "digest", "spans", "part", "base", "start", "text_hash", "row_no", "class_id", "label")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
