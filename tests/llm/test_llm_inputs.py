"""What operators keep on the driver."""

from pyspark import Broadcast
from pyspark.sql import functions as F

from clausegrid.llm import lm


def test_moves_of_weights_come_a_part_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"the word {k % 7} of the text {k % 3}") for k in range(60)], "doc_id long, text string")
    voc, _ = lm.vocabulary(lm.count_words(docs.select("text")))
    known = spark.sparkContext.broadcast(voc)
    texts = lm.encode(docs.withColumn("key", F.xxhash64("doc_id")), known, ["key"]).select("key", "ids")
    gone = []
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a, **b: gone.append(self))
    monkeypatch.setattr(type(docs), "collect", lambda self: (_ for _ in ()).throw(AssertionError("all moves at once")))
    weights = lm.train(texts, voc, known)
    assert len(gone) == lm.ROUNDS and any((a != b).any() for a, b in zip(weights, voc.weights()))
