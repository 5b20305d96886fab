"""What the jobs of a test shuffle."""


def shuffled_records(spark, run) -> int:
    """Records that the stages of run's jobs write to shuffles, with joins not broadcast by size."""
    sc, group = spark.sparkContext, f"counted-{id(run)}"
    sc.setJobGroup(group, "")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
