"""Folders on whatever file system their path names: what is finished, what is inside, what can go."""


def _at(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def finished(spark, path) -> bool:
    """Whether a write to the folder was committed: a folder left by a failed job has no ``_SUCCESS``."""
    fs, p = _at(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def children(spark, path) -> list:
    """Names inside a folder, sorted; none if there is no such folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark, path):
    fs, p = _at(spark, path)
    fs.delete(p, True)
