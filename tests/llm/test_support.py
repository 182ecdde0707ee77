from pathlib import Path

from strandline.llm.support import tidy


def test_freed_memory_of_the_driver_goes_back(spark):
    """What the JVM has freed but its allocator keeps; one block that stays in use after the others holds it there."""
    jvm = spark.sparkContext._jvm
    memory = jvm.org.apache.spark.unsafe.Platform
    pages = lambda: int(Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/statm").read_text().split()[1])
    tidy(spark)
    blocks = [memory.allocateMemory(1 << 16) for _ in range(1600)]
    for at in blocks:
        memory.setMemory(at, 1, 1 << 16)
    for at in blocks[:-1]:
        memory.freeMemory(at)
    before = pages()
    tidy(spark)
    assert (before - pages()) * 4096 > 50 << 20
    memory.freeMemory(blocks[-1])
