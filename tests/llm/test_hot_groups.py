"""Groups that hold most rows: rows without ids, one source and one length."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tramline.llm import mixing, sharding
from tramline.llm.sampling import LEAST_SALTS, SALT_ROWS, salts_for, spread


def documents(spark, n=6000):
    """A third of the rows without doc_id, a third of one source, language and length."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("w "), F.hex("id")).alias("text"),
        F.when(F.col("id") % 3 == 1, F.lit("en")).otherwise(F.concat(F.lit("l"), F.col("id") % 5)).alias("lang"),
        F.when(F.col("id") % 3 == 1, F.lit("s")).otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("source"),
        F.lit(3).cast("long").alias("n_chars"),
    )


def test_salts_follow_the_rows_and_rows_without_id_spread(spark):
    assert salts_for(0) == salts_for(1000) == LEAST_SALTS
    assert all(n / salts_for(n) <= SALT_ROWS for n in (10**6, 10**9, 10**11))
    salt = F.pmod(spread(F.col("doc_id"), F.col("text")), F.lit(64))
    counts = [r["count"] for r in documents(spark).where("doc_id is null").groupBy(salt).count().collect()]
    assert len(counts) == 64 and max(counts) < 4 * 2000 / 64


def test_results_do_not_depend_on_salts_being_many(spark, monkeypatch):
    docs = documents(spark)
    for salts in (LEAST_SALTS, 1000):
        monkeypatch.setattr(sharding, "salts_for", lambda n, salts=salts: salts)
        monkeypatch.setattr(mixing, "salts_for", lambda n, salts=salts: salts)
        placed = sharding.shard(docs).select("shard", "slot").collect()
        sizes = Counter(r.shard for r in placed)
        assert sum(sizes.values()) == 6000 and max(sizes.values()) - min(sizes.values()) <= 1
        assert len(set(placed)) == 6000 and all(r.slot < sizes[r.shard] for r in placed)
        mixed = mixing.mix(docs, carry=["source"]).select("row.source", "size", "target", "copies").collect()
        assert len(mixed) == 6000
        taken, target = Counter(), {}
        for r in mixed:
            taken[r.source] += r.copies * r.size
            target[r.source] = r.target
        assert all(abs(taken[s] - t) <= 2 for s, t in target.items())
        assert np.isclose(sum(target.values()), 1.5 * sum(r.size for r in mixed))
