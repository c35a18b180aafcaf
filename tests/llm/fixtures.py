"""Small tables with the awkward cases: NULLs, empty and very long texts, ties, repeats, clashing columns."""

from pyspark.sql import DataFrame, SparkSession

LONG = ("the quick brown fox\n" * 30_000) + "x" * 50_000
TEXTS = [
    (1, "Released under the MIT License. MIT license again."),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "you are an idiot and a moron"),
    (6, "you are an idiot and a moron"),
    (6, "you are an idiot and a moron"),
    (None, "no id here\tand  two   spaces \n\n"),
    (None, None),
    (7, "   "),
    (8, "naïve café   \x00 <|endoftext|> 中文 😀"),
]
#: Names that operators use inside or add.
CLASHES = ("score", "scan", "coded", "digest", "n_tokens", "n_bytes", "simhash", "component_id", "fp", "row_digest_0", "y", "_page", "_html", "grp")


def edge_docs(spark: SparkSession) -> DataFrame:
    columns = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, *(["z"] * len(CLASHES))) for i, t in TEXTS], f"doc_id long, text string, {columns}")


def edge_labels(spark: SparkSession) -> DataFrame:
    rows = [(1, 1, 0), (4, 0, 0), (5, 1, 1), (6, 1, 1), (6, 0, 0), (None, 1, 1), (7, None, None), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
