"""What tables in the shared folder leave in the driver."""

import re

import pytest

from linkspark.sources import storage


def trimmed(spark) -> float:
    """MB that the driver's JVM had freed and still held."""
    n, unit = re.search(r"\(([+-]?\d+)([BKMG])\)", storage.trim(spark)).groups()
    return -int(n) * {"B": 1e-6, "K": 1 / 1024, "M": 1, "G": 1024}[unit]


def fill(spark):
    """Has the JVM take over 100 MB of the C library's memory and free all but the last piece."""
    made = [spark._jvm.java.util.zip.Deflater() for _ in range(1200)]
    for x in made[:-1]:
        x.end()
    return made[-1]


def test_freed_memory_goes_back(spark):
    """What threads of the driver have freed does not stay with the driver after the next table."""
    if not storage.trim(spark):
        pytest.skip("this JVM can't trim")
    last = fill(spark)
    assert trimmed(spark) > 60
    last.end()
    last = fill(spark)
    storage.materialize(spark.range(10))
    assert trimmed(spark) < 25
    last.end()


def test_release_collects_garbage(spark):
    """Java objects that nothing refers to are gone."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    used = lambda: (runtime.totalMemory() - runtime.freeMemory()) >> 20
    text = spark._jvm.java.lang.StringBuilder(100 << 20)
    storage.release(spark)
    most = used()
    text.trimToSize()
    storage.release(spark)
    assert most - used() > 80
