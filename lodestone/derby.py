"""A JDBC server for queries and tests: the Derby that comes with Spark, in the driver's process.

Derby is seen by its own process only and Spark has no network server for it. Where executors are other processes,
Bridge.java puts one in front of it: Janino, which Spark has for its generated code, compiles it, and executors get it
as a jar. Databases are on the driver's disk, in a folder that goes with its process.
"""

from __future__ import annotations

import secrets
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

EMBEDDED = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def database(spark: SparkSession, *statements: str) -> dict[str, str]:
    """A new database after these statements; the options of an entry for its tables."""
    folder, options = _server(spark)
    jvm, name = spark.sparkContext._jvm, f"lodestone{uuid.uuid4().hex}"
    connection = jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(f"jdbc:derby:{folder}/{name};create=true", jvm.java.util.Properties())
    # tasks that insert wait for one another as long as it takes: locks of many rows become one of the table
    for statement in ("CALL SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.locks.waitTimeout', '-1')", *statements):
        connection.createStatement().execute(statement)
    connection.close()
    return options | {"url": f"{options['url']}/{name}"}


def _server(spark: SparkSession) -> tuple[str, dict[str, str]]:
    """This application's folder of databases and the options that all of them share; the server starts once."""
    context = spark.sparkContext
    if found := getattr(context, "_lodestone_derby", None):
        return found
    utils = context._jvm.org.apache.spark.util.Utils
    folder = utils.createTempDir(utils.getLocalDir(context._jsc.sc().conf()), "derby").getPath()
    context._lodestone_derby = folder, {"url": f"jdbc:derby:{folder}", "driver": EMBEDDED} if context._jsc.sc().isLocal() else _bridge(spark, folder)
    return context._lodestone_derby


def _bridge(spark: SparkSession, folder: str) -> dict[str, str]:
    """Starts the server on the driver and gives its driver class to all processes of the application."""
    context = spark.sparkContext
    jvm, conf = context._jvm, context.getConf()
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook((Path(__file__).parent / "Bridge.java").read_text())
    jar = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone-bridge.jar"  # on the driver; Spark serves it to executors
    with zipfile.ZipFile(jar, "w") as out:
        for name, code in compiler.getBytecodes().items():
            out.writestr(name.replace(".", "/") + ".class", bytes(code))
    context._jsc.addJar(str(jar))
    jvm.Thread.currentThread().getContextClassLoader().addURL(jvm.java.net.URL(jar.as_uri()))
    host, password = conf.get("spark.driver.host"), secrets.token_hex(16)
    port = jvm.lodestone.Bridge.serve(conf.get("spark.driver.bindAddress", host), folder, password)
    return {"url": f"jdbc:derby://{host}:{port}", "driver": "lodestone.Bridge", "user": "lodestone", "password": password}
