"""Small inputs that every operator has to take: nulls in any column, empty and
very long texts, ties, repeated rows, no rows, and columns with clashing names."""

LONG = "Lorem ipsum dolor sit amet, the quick brown fox.\n" * 4000

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", "a"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa.", "en", "a"),
    (3, None, None, None),
    (4, "", "en", None),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", "a"),
    (None, None, None, None),
    (5, LONG, "en", "b"),
    (6, "   \n\t ", "en", "b"),
    (7, "Été à la plage, мир, 世界 \U0001f600 & <|end|> </s>", "fr", "b"),
    (7, "Été à la plage, мир, 世界 \U0001f600 & <|end|> </s>", "fr", "b"),
    (7, "same id, other text", "fr", "b"),
]
CLASHING = "row long, level int, name string, fp long, root long, shard int, slot long, _task int, block long, label int, value string, start int"


def documents(spark, rows=None):
    """ROWS with the columns of documents and others whose names the operators use inside."""
    from pyspark.sql import functions as F
    d = spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string, lang string, source string")
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    for column in CLASHING.split(", "):
        name, kind = column.split()
        d = d.withColumn(name, F.lit(None).cast(kind))
    return d
