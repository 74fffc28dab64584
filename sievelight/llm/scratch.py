"""Tables of one run of an operator, written to the shared folder that spark.checkpoint.dir names.

A written table cuts lineage as a checkpoint does and outlives executors; unlike one it can be deleted as
soon as nothing reads it, so that a loop holds its last tables only."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the one that the context already uses.  One of our own is
    made only where neither is set and the master is local, as in tests."""
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if (own := sc._jsc.sc().getCheckpointDir()).isDefined():
        return own.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sievelight-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def trim_native(spark: SparkSession) -> bool:
    """Give memory that the driver's JVM has freed outside its heap back to the system; whether that JVM can.

    The JIT and Spark's code generator use and free many buffers, and the allocator keeps what is free in each thread's arena: a
    driver that plans hundreds of queries grows by it, whatever its heap.  HotSpot on glibc has a command for it."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # by reflection on the interface, as the server's own class is not open to others
        kinds = [jvm.javax.management.ObjectName, jvm.java.lang.String, "[Ljava.lang.Object;", "[Ljava.lang.String;"]
        types, values = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for i, kind in enumerate(kinds):
            types[i] = jvm.java.lang.Class.forName(kind if isinstance(kind, str) else kind._fqn)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", types).invoke(server, values)
    except Py4JError:
        return False
    return True


#: Seconds between two collections of the driver's garbage: short runs need none.
PAUSE = 3.0


class Scratch:
    """A folder of tables below the shared one, deleted at the latest when the driver ends."""

    collected = time.monotonic()

    def __init__(self, spark: SparkSession):
        self.spark, self.count, self.paths, self.named = spark, 0, {}, {}
        self.path = f"{shared_folder(spark)}/sievelight-{uuid.uuid4().hex}"
        self._fs().deleteOnExit(self._hadoop(self.path))

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _next(self) -> str:
        self.count += 1
        return f"{self.path}/{self.count}"

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        path = self._next()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def keep_dealt(self, df: DataFrame, key: str, parts: int, moved: bool = False) -> DataFrame:
        """df as a table bucketed and sorted by key: joins on key with as many partitions move only the other side.

        moved: df's last step deals it by key into as many partitions already."""
        path, name = self._next(), f"sievelight_{uuid.uuid4().hex}"
        (df if moved else df.repartition(parts, key)).write.bucketBy(parts, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        self.paths[id(out)], self.named[id(out)] = path, name
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for table in tables:
            if name := self.named.pop(id(table), None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if path := self.paths.pop(id(table), None):
                self._fs().delete(self._hadoop(path), True)

    def release(self, *tables: DataFrame) -> None:
        """Delete tables, and let Spark delete the shuffle files of finished queries: it does so when the driver's JVM collects
        the plans that made them, and a driver with little to collect would keep them for long."""
        self.drop(*tables)
        if time.monotonic() - Scratch.collected < PAUSE:
            return
        Scratch.collected = time.monotonic()
        # what Python lets go in the first round, the JVM can collect in the second
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.2)
        trim_native(self.spark)
