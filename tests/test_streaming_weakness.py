"""The weakness stream against the batch operator: answers shuffled, repeated and late, restarts, batches that run twice."""

import random

from quillspark.operators import core as O
from quillspark.streaming import weakness as W

SCHEMA = "answer_id long, student string, concept string, correct boolean"


def test_stream_equals_batch_after_restarts_and_repeats(spark, tmp_path):
    rng = random.Random(7)
    answers = [(i, f"s{rng.randrange(6)}", f"c{rng.randrange(4)}", rng.random() < 0.4) for i in range(400)]
    rng.shuffle(answers)
    parts = [answers[k::4] for k in range(4)]
    parts[2] += rng.sample(parts[0], 30)  # come again in a later batch
    parts[3] += [(None, "s1", "c1", False), (9000, None, "c1", True), (9001, "s1", "c1", None)]
    source, path, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        W.keep(stream(), path, mark).awaitTermination(120)  # each a start of its own from the checkpoint
        seen = {a[0]: a for p in parts[: k + 1] for a in p if a[0] is not None and a[1] is not None}
        batch = O.weakness(spark.createDataFrame([(s, c, bool(ok)) for _, s, c, ok in seen.values()], "student string, concept string, correct boolean"))
        assert sorted(map(tuple, W.scores(W.current(spark, path)).collect())) == sorted(map(tuple, batch.collect()))
    # a batch that is run again replaces its own rows
    before = sorted(map(tuple, W.current(spark, path).collect()))
    again = spark.read.parquet(f"{path}/batch=3")
    rows = again.collect()
    spark.createDataFrame(rows, again.schema).write.mode("overwrite").parquet(f"{path}/batch=3")
    assert sorted(map(tuple, W.current(spark, path).collect())) == before
    W.keep(stream(), path, mark).awaitTermination(120)  # nothing new
    assert sorted(map(tuple, W.current(spark, path).collect())) == before
