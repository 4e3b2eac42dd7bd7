"""Small tables that hold the awkward cases: nulls, empty and long texts, repeated rows, columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, score double, kept string, t string"


def documents(spark, texts, langs=None):
    """Documents 0, 1, ... with the given texts and with extra columns whose names operators use themselves."""
    rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), -1, -1, -1.0, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Documents with every awkward case; the last two rows repeat the first."""
    long = " ".join(f"word{i}" for i in range(30000))
    texts = ["one two three four five six seven", None, "", " \n\t ", "x", "é ß 日本", long, "one two three four five six seven"]
    docs = documents(spark, texts)
    null = spark.createDataFrame([(None, "one two three four five six seven", None, None, None, None, None, None, None, None)], SCHEMA)
    return docs.unionByName(null).unionByName(docs.where("doc_id = 0"))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
