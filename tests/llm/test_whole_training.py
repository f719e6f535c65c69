"""op5 learns from every labelled row, however many there are."""

from pyspark.sql import functions as F

from seqloom.llm import toxicity


def test_every_labelled_row_trains(spark):
    """A word of toxic rows that come after the first 4000 in the order of the ids' hash is learnt too, and so are rows that repeat an id."""
    ids = spark.range(1, 10001).withColumnRenamed("id", "doc_id").filter(~toxicity.is_held_out(F.col("doc_id")))
    order = [r["doc_id"] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    toxic = order[:4700]
    said = dict.fromkeys(toxic[:4000], "scum") | dict.fromkeys(toxic[4000:], "vermin")
    rows = [(d, f"the w{d % 300} and w{d % 299} {said.get(d, 'fine')} of w{d % 298}") for d in order]
    table = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(d, int(d in said)) for d in order], "doc_id bigint, toxic int")
    assert toxicity.training_table(table, labels).count() == len(rows) + 1
    model = toxicity.fit(table, labels)
    assert model.score("the scum of w5") >= 0.5 and model.score("the vermin of w5") >= 0.5 and model.score("the fine of w5") < 0.5


def test_texts_without_a_label_do_not_move(spark):
    """Labels by far too many to be broadcast: texts still meet a filter of the ids before they move, and rows with a label all come through."""
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"))
    docs = docs.unionByName(docs.filter("doc_id < 30")).unionByName(spark.createDataFrame([(None, "no id")], "doc_id bigint, text string"))
    one = spark.range(0, 20000, 10).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    met, _ = toxicity.labelled(docs, one)
    assert sorted(r["doc_id"] for r in met.collect()) == sorted([*range(0, 20000, 10), 0, 10, 20])
    tree = met._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(k for k, x in enumerate(tree) if "SortMergeJoin" in x)
    moved = next(k for k, x in enumerate(tree[at:]) if "Exchange hashpartitioning" in x)
    assert any("BroadcastHashJoin" in x for x in tree[at + moved :]) and not any("BroadcastHashJoin" in x for x in tree[:at])
    assert toxicity.labelled(docs, one.limit(0))[0].count() == 0
