"""The list of named queries and their SQL twins."""

from ..sources.canonical import Tables, with_ctes

QUERIES, ORACLES = {}, {}


def query(key, ctes="", body=None, extra=""):
    """Register ``fn(Tables) -> DataFrame`` under ``key``, with its SQL when there is one."""
    def add(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark, path):
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold UTC times without a zone
            return fn(Tables(spark, path))
        QUERIES[key] = run
        if body:
            ORACLES[key] = with_ctes(ctes, body, extra)
        return fn
    return add
