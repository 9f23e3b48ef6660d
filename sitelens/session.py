"""Spark session helpers: recommended settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every audit job relies on. AQE re-plans joins at runtime (broadcast
# when a side is measured small, skew-join splitting of hot page URLs) and
# coalesces the small shuffle partitions of per-page aggregates.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # One page row can be large; keep Arrow batches to the element pass small,
    # by count and by bytes (a batch of very large pages stays bounded).
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def build_session(master: str | None = None, app: str = "sitelens",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with the recommended settings. Master, memory and shuffle
    partitions are set only if asked for (or, for a local master, to suit one
    machine), so what ``spark-submit`` gives holds."""
    b = SparkSession.builder.appName(app)
    conf = dict(RECOMMENDED_CONF)
    if master:
        b = b.master(master)
        if master.startswith("local["):
            conf.update({"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                         "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable recommended settings to an existing session."""
    for k, v in RECOMMENDED_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared cluster session: keep theirs
            pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set; it is read as is. Only where it is unset
    and the master is local (tests) a scratch folder is made and registered.
    """
    sc = _context(spark)
    if sc is None:  # a remote (Connect) session: the setting is all there is
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="sitelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def _context(spark: SparkSession):
    """The SparkContext of a classic session, None for a Connect session."""
    try:
        return spark.sparkContext
    except Exception:
        return None


def app_id(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.applicationId if sc is not None else spark.conf.get("spark.app.id", str(id(spark)))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, in whatever store it is. A Connect
    session has no such access; there the owner of the checkpoint folder clears it."""
    if _context(spark) is None:
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application).

    The package is zipped from its installed location into the checkpoint
    folder and added with ``addPyFile``, the standard way code reaches
    executors. (The zip is written with local file calls, so the folder must
    be mounted on the driver; otherwise install the package on the cluster.)
    """
    sc = _context(spark)
    app = app_id(spark)
    if app in _SHIPPED:
        return
    import uuid
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    # the archive goes to the shared checkpoint folder (a local path when the
    # session is local), from where addPyFile serves it to the executors
    ck = checkpoint_dir(spark)
    if "://" in ck and not ck.startswith("file:"):
        # a remote store is not writable with local file calls: stage the
        # archive on the driver, addPyFile serves it to the executors
        out_dir = tempfile.mkdtemp(prefix="sitelens-pyfiles-")
    else:
        out_dir = os.path.join(ck.replace("file://", "").replace("file:", ""), f"pyfiles-{uuid.uuid4().hex}")
        os.makedirs(out_dir, exist_ok=True)
    zpath = os.path.join(out_dir, "sitelens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(zpath)
    else:  # Spark Connect: ship as a Python artifact
        spark.addArtifacts(zpath, pyfile=True)
    _SHIPPED.add(app)
