"""What the operators of this subpackage share: table access, stored intermediates, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A session on one machine that names none gets a new folder of its own,
    once; on a cluster that is an error, since executors would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = _own.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='jotspark-')}"
        _own[spark.sparkContext.applicationId] = path
    return path


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/jotspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn names it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def positional(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str, list[tuple[str, str]]]:
    """docs with its columns named by place, so that none can clash; the names of id and text; and pairs of new and old names."""
    names = [(f"__c{i}", c) for i, c in enumerate(docs.columns)]
    new = {old: new for new, old in names}
    return docs.toDF(*new.values()), new[id_col], new[text_col], names


def free(name: str, taken: list[str]) -> str:
    """name, or name_1 and so on if a column has it (Spark compares names without case)."""
    used, k, out = {c.lower() for c in taken}, 0, name
    while out.lower() in used:
        k += 1
        out = f"{name}_{k}"
    return out
