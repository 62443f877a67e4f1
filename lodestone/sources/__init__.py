"""Sources and sinks: each module has `read(spark, entry, name, requests)`, and `append(df, entry)` if it can be written.

`append` returns the number of rows where Spark's observation of the frame doesn't tell it.
"""

from . import files, frames, http_json, mysql, synthetic

SOURCES = {"file": files, "http": http_json, "mysql": mysql, "test": synthetic, "frame": frames}

__all__ = ["SOURCES"]
