import os

import duckdb
import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sql():
    """Runs SQL on DuckDB over the tables of a folder, or over given frames by name."""

    def run(text, folder=None, **frames):
        con = duckdb.connect()
        for name in TABLES if folder else []:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
        for name, frame in frames.items():
            con.register(name, frame.toArrow() if hasattr(frame, "toArrow") else frame)
        return [tuple(r) for r in con.execute(text).fetchall()], [d[0] for d in con.description]

    return run


@pytest.fixture(scope="session")
def same_rows(sql):
    def check(df, text, folder=None, **frames):
        want, names = sql(text, folder, **frames)
        got = [tuple(r) for r in df.select(*names).collect()]
        order = lambda rows: sorted(rows, key=repr)
        assert order(got) == order(want)

    return check


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns whose names clash with results."""
    passage = "The committee met on Monday and agreed to publish its findings before the end of the year."
    rows = [
        (1, f"{passage}\nfirst own line that is long enough\nshort", "en", "a", 10),
        (2, f"  {passage.upper()}\t\nsecond own line that is long enough", "en", "b", 10),
        (3, f"x\n{passage}\n{passage}\n", None, "b", None),
        (4, None, "en", "c", None), (5, "", "en", None, 0), (6, "\n\n \n", "fr", None, 4),
        (7, "été " * 30 + "漢字 🏽‍ naïve\n" + "ß" * 20, "de", "a", 1), (8, "ß" * 20 + "\nother", "de", "d", 1), (9, "ß" * 20, "de", "d", 1),
        (10, "word " * 5000, "en", "e", 25000), (11, "a b c a b c a b c d " * 10, "en", "e", 1),
        (12, "one", None, "e", 3), (13, "one", None, "e", 3), (14, "$#& % *** <a|b>", "en", "e", 3),
    ]
    rows += [(20 + i, " ".join(f"w{j}" for j in range(i, 60 + i)), "en", "a", 1) for i in range(6)]
    rows += [(40 + i, " ".join(f"v{j}" for j in range(80)) + f" end{i // 2}", "en", "c", 1) for i in range(6)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for clash in ("n_words", "key", "ids", "size", "row_no", "n_lines", "links", "score"):
        from pyspark.sql import functions as F

        df = df.withColumn(clash, F.lit("clash"))
    return df
