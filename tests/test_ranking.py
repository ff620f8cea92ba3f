"""The live ranking over restarts, replays and late scores."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from sparkloom.streaming import ranking

SCHEMA = "candidate_key string, probability string, position long, seq long, at timestamp"
BEGAN = datetime(2024, 1, 1)


def test_live_ranking(spark, tmp_path):
    rng, source, folder = random.Random(5), str(tmp_path / "in"), str(tmp_path / "out")
    known, seq = {}, 0
    for step in range(3):
        rows = []
        for _ in range(60):
            seq += 1
            rows.append((f"k{rng.randrange(40)}", f"0.{rng.randrange(5)}{'0' * rng.randrange(2)}", rng.randrange(9), seq, BEGAN + timedelta(seconds=seq)))
        if step:
            rows.append(("k1", "0.9", 0, 1, BEGAN))  # a late score, older than what is known
        rows += [(None, "0.1", 0, 999, BEGAN), ("k2", None, 0, 999, BEGAN), ("k3", "0.1", 0, 999, None)] + rows[:3]
        for r in rows:
            if r[0] and r[1] and r[4] and r[3] > known.get(r[0], (None, None, 0))[2]:
                known[r[0]] = r[1:4]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ranking.follow(stream, folder, every=8, shards=3)  # goes on from the checkpoint
        got = {r["candidate_key"]: (r["probability"], r["position"], r["seq"]) for r in ranking.complete(spark, folder).collect()}
        assert got == known
        some = {r["candidate_key"]: r["seq"] for r in ranking.live(spark, folder).collect()}
        assert some and all(known[k][2] >= s for k, s in some.items())
    ranking.follow(spark.readStream.schema(SCHEMA).parquet(source), folder, every=8, shards=3)  # nothing new
    order = sorted(known, key=lambda k: (-Decimal(known[k][0]), k))
    rows = ranking.ranked(ranking.complete(spark, folder)).collect()
    assert [r["candidate_key"] for r in sorted(rows, key=lambda r: r["rank"])] == order and {r["rank"] for r in rows} == set(range(1, len(order) + 1))


def test_no_more_stores_than_shards_fill(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(f"k{i % 50}", f"0.{i % 7}", i, i, BEGAN + timedelta(seconds=i)) for i in range(300)], SCHEMA).write.parquet(source)
    ranking.follow(spark.readStream.schema(SCHEMA).parquet(source), folder, shards=1)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert len(list((tmp_path / "out" / "checkpoint" / "state" / "0").glob("[0-9]*"))) == 2
    assert {r["candidate_key"]: r["seq"] for r in ranking.complete(spark, folder).collect()} == {f"k{i}": 250 + i for i in range(50)}
