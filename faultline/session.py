"""Session settings every plan relies on, and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: A side of a join is broadcast only when a count proves it has at most this many rows.
BROADCAST_ROWS = 50_000


def prepare(spark: SparkSession) -> SparkSession:
    """UTC clock, last-wins maps; ANSI stays on, data-dependent casts use try_*."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: executors need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_faultline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="faultline-")) / "faultline.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".json", ".txt"):
                z.write(p, Path("faultline") / p.relative_to(root))
    sc.addPyFile(str(archive))
    sc._faultline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, as named by spark.checkpoint.dir. Only a session that runs in one process (master local or local[..]) may leave
    it unset and gets a temporary folder; on a cluster that would be a disk of one machine, so there it is an error."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or ""
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="faultline-"))
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from the written copy, so that
    several consumers read it and a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def proven_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when a bounded count shows that `df` has at most `rows` rows."""
    return df.select(df.columns[:1]).limit(rows + 1).count() <= rows


def join_dimension(fact: DataFrame, dim: DataFrame, key: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join to a dimension with unique keys. The dimension is broadcast only after a bounded
    count; beyond the bound it is an ordinary join, where adaptive execution splits hot keys."""
    from pyspark.sql import functions as F

    return fact.join(F.broadcast(dim) if proven_small(dim, rows) else dim, key, "left")


def fence(df: DataFrame, *cols: str) -> DataFrame:
    """Values unchanged; the optimizer no longer substitutes the long expressions behind `cols` into filters
    above (a chain of steps that each use the one before several times would grow exponentially)."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.expr(f"if(spark_partition_id() < 0, null, `{c}`)") for c in cols})
