"""What a query cost: rows shuffled and tasks of the stages that it ran."""

import uuid


def cost(spark, action) -> dict[str, int]:
    """Of what action() runs: rows written to shuffles, the most rows that a task read from one, tasks."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, group)
    try:
        action()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    out = {"shuffled": 0, "most": 0, "read": 0, "written": 0}
    for s in stages:
        data = store.lastStageAttempt(s)
        out["shuffled"] += data.shuffleWriteRecords()
        out["read"] += data.inputRecords()
        out["written"] += data.outputRecords()
        tasks = store.taskList(s, data.attemptId(), 100_000)
        for k in range(tasks.size()):
            m = tasks.apply(k).taskMetrics()
            if m.isDefined():
                out["most"] = max(out["most"], m.get().shuffleReadMetrics().recordsRead())
    return out
