"""What a scope does at its end."""

from barloom.llm.storage import materialize, scope


def collections(spark) -> int:
    """Whole collections of the driver's heap so far."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_finished_jobs_are_collected_with_each_scope(spark):
    before = collections(spark)
    with scope(spark) as kept:
        table = materialize(spark.range(100))
        kept.append(table)
    assert collections(spark) > before
    assert table.count() == 100
