"""What a run shuffles."""

from __future__ import annotations


def shuffled(spark, df) -> int:
    """Bytes that the stages of a run of df write for shuffles."""
    jvm = spark._jvm

    def total() -> int:
        empty = jvm.java.util.ArrayList
        stages = spark._jsc.sc().statusStore().stageList(empty(), False, False, jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Double.TYPE, 0), empty())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    spark._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    df.write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before
