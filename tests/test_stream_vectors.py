"""Vectors kept from a stream of changes, against a dictionary."""

import random

from termloom.streaming.vectors import current_vectors, last_changes, publish_stream

SCHEMA = "index_name string, id string, at long, deleted boolean, embedding array<double>, extra string"


def run(spark, folder, parts):
    """Each part is one micro-batch; the stream is started anew for each."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{folder}/changes")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/changes")
        publish_stream(last_changes(stream, ["at"], 2), f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    rows = current_vectors(spark.read.parquet(f"{folder}/out")).collect()
    found = {(r.index_name, r.id): tuple(r.embedding) for r in rows}
    assert len(found) == len(rows)
    return found


def expected(parts):
    last = {}
    for name, key, at, deleted, vector, _ in (row for part in parts for row in part):
        if deleted or (vector and len(vector) == 2 and None not in vector):
            change = (at, bool(deleted), () if deleted else tuple(vector))
            last[name, key] = max(last.get((name, key), change), change)
    return {k: v for k, (_, deleted, v) in last.items() if not deleted}


def test_last_change_wins_late_and_replayed(spark, tmp_path):
    rng = random.Random(1)

    def change(at):
        vector = rng.choice(([rng.random(), 1.0], [rng.random(), 2.0], [1.0], [None, 1.0], None))
        return rng.choice("ab"), rng.choice([*"0123456789", None]), at, rng.choice((True, False, None, False)), vector, "x"

    first = [change(rng.randint(0, 50)) for _ in range(120)]
    late = [change(rng.randint(0, 40)) for _ in range(60)]
    parts = [first, late + first[:40], [change(rng.randint(30, 60)) for _ in range(30)] + late]
    got = run(spark, str(tmp_path), parts)
    assert got == expected(parts) and 5 < len(got) < 22


def test_late_upsert_does_not_undo_a_delete(spark, tmp_path):
    parts = [[("a", "1", 5, True, None, ""), ("a", "2", 5, None, [1.0, 2.0], "")], [("a", "1", 4, None, [1.0, 1.0], ""), ("a", "2", 5, True, None, "")]]
    assert run(spark, str(tmp_path), parts) == {}
