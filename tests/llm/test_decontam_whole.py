"""Items of numbers mostly, and long items with one mention changed."""

from tidemark.llm import decontam


def test_numbers_and_one_changed_mention(spark):
    sums = "Compute 12 + 30 * 7 - 4"
    long = "quiet rivers run under old stone bridges while Anna and the other children watch small boats go by in the warm summer evening before they walk home along the narrow road that leads up to the village where old friends of Anna wait with bread and cheese and a bowl of soup for everyone who comes in from the fields"
    filler = "some words that have nothing to do with any of this at all. "
    bench = spark.createDataFrame([(1, sums), (2, long)], "item_id long, text string")
    rows = [(1, filler + sums + " and so on"), (2, filler + sums.replace("30", "31")), (3, filler + long), (4, filler + long.replace("friends of Anna", "friends of Maria")), (5, filler), (6, long.replace("Anna", "Maria"))]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1): "exact", (3, 2): "exact", (4, 2): "reparameterised", (6, 2): "reparameterised"}
