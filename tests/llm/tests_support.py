"""Brute-force versions that several tests use, and the plan that a skewed join ends with."""


def brute_lines(docs):
    from test_lines import brute

    return brute(docs)


def brute_near(texts):
    from test_neardup import brute

    return brute(texts)


def levels(sizes):
    from test_mix import levels as of

    return of(sizes)





SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8",
}


def final_plan(df) -> str:
    """The plan that Spark ended with, where partitions of a few KB count as skewed."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        conf.set(k, v)
    try:
        again = df.select("*")
        again.collect()
        return again._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
