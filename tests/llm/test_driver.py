"""What written tables leave in the driver."""

from foliosift.llm.common import alone, cut


def test_a_heap_that_has_grown_is_collected(spark):
    jvm = spark._jvm
    beans = list(jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    runtime = jvm.java.lang.Runtime.getRuntime()
    # the lists are held, so that the heap can't be smaller
    held = [jvm.java.util.ArrayList(1 << 22) for _ in range(runtime.maxMemory() * 55 // 100 >> 24)]
    assert 2 * runtime.totalMemory() > runtime.maxMemory()
    before = full()
    assert alone(lambda: cut(spark.range(3).toDF("n"), "numbers"), "result").count() == 3
    assert full() > before
    assert held[0].isEmpty()
