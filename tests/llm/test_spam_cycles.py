from millrace.llm import spam

CYCLE = "buy cheap shoes in berlin "
SPAM = [
    CYCLE * 200, (CYCLE.strip() + "\n") * 40, "buy cheap red winter shoes in berlin at low price today or rent new city bikes with free maps " * 30,
    CYCLE * 60 + "iPhone case (new) " + CYCLE * 60,
]
CONTENT = [
    "The loader keeps its cursor in the second field. " * 40, "Похоже, буфер удаляется слишком рано. " * 20,
    "def load(x):\n    return x\n" * 20, "if the batch is empty then the loader must not move its cursor, but if the batch is full then it must move it\n",
]


def test_cycles_of_keywords(spark, data):
    reference = spark.read.parquet(f"{data}/../sf0.01/documents.parquet").select("doc_id", "text")
    df = spark.createDataFrame(list(enumerate(SPAM + CONTENT)), "doc_id long, text string")
    assert {r.doc_id for r in spam.spam_pages(df, reference).collect()} == set(range(len(SPAM)))
