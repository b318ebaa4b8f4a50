"""Memory that the driver's JVM has freed goes back to the machine whenever a table is written."""

from tessella.llm import common


def test_freed_native_memory_is_given_back(spark):
    jvm = spark.sparkContext._jvm
    field = next(f for f in jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredFields() if f.getName() == "theUnsafe")
    field.setAccessible(True)
    unsafe, status = field.get(None), f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps"
    size = 100_000

    def resident(at):
        """kB in memory of the mapping that holds this address."""
        inside = False
        for line in open(status):
            first = line.split()[0]
            if "-" in first:
                low, high = (int(x, 16) for x in first.split("-"))
                inside = low <= at < high
            elif inside and first == "Rss:":
                return int(line.split()[1])

    blocks = [unsafe.allocateMemory(size) for _ in range(400)]
    for b in blocks:
        unsafe.setMemory(b, size, 1)
    kept = blocks[::40]  # these stand between the rest and the end of the heap, so that it doesn't shrink by itself
    before = resident(kept[4])
    for b in set(blocks) - set(kept):
        unsafe.freeMemory(b)
    freed = resident(kept[4])
    common.written(spark.range(3), "memory")
    after = resident(kept[4])
    for b in kept:
        unsafe.freeMemory(b)
    assert freed > before - 5_000 and after < before - 20_000  # of 36 MB
