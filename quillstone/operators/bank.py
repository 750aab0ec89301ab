"""Content-addressed form bank: keys, lookup chain, and a folder of tables with commits."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def key(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 32)


def form_id(k: Column) -> Column:
    return F.concat(F.lit("upload_"), k)


def key_of(ident: Column) -> Column:
    return F.nullif(F.regexp_extract(ident, "^upload_([0-9a-f]{32})$", 1), F.lit(""))


def valid_hash(h: Column) -> Column:
    return F.left(F.lower(h), F.lit(32)).rlike("^[0-9a-f]{32}$")


def display_name(name: Column) -> Column:
    base = F.regexp_replace(F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1), r"(?i)\.pdf$", "")
    safe = F.left(F.trim(F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9 ._()&-]+", " "), " +", " ")), F.lit(80))
    return F.when(safe.startswith(".") | (safe == ""), "Uploaded form").otherwise(F.coalesce(safe, F.lit("Uploaded form")))


def looked_up(asked: DataFrame, curated: DataFrame, banked: DataFrame) -> DataFrame:
    """asked: key. Curated forms come before banked ones; found_in is null where neither has the key."""
    c = curated.select("key", F.col("form").alias("curated")).dropDuplicates(["key"])
    b = banked.select("key", F.col("form").alias("banked")).dropDuplicates(["key"])
    j = asked.join(c, "key", "left").join(b, "key", "left")
    where = F.when(F.col("curated").isNotNull(), "curated").when(F.col("banked").isNotNull(), "banked")
    return j.select(*asked.columns, F.coalesce("curated", "banked").alias("form"), where.alias("found_in"))


def nothing(spark: SparkSession) -> DataFrame:
    """A bank that never has a form."""
    return spark.createDataFrame([], "key string, form string")


def banked(spark: SparkSession, folder: str | None) -> DataFrame:
    """(key, form) of the bank in a folder as it is now, or of none where there is no folder; forms that can't be read as JSON are missing."""
    if not folder:
        return nothing(spark)
    return _rows(spark, folder, snapshot(spark, folder)[1]).filter(F.try_parse_json("form").isNotNull())


def backend(folder: str | None, token: str | None) -> str:
    """Which bank is meant: a folder before a remote store, and none where nothing is set."""
    return "folder" if folder else "remote" if token else "none"


# A bank's folder holds tables that are never changed and commits, each a small file that lists the tables of one state. A commit's file is
# renamed into place under the next number, which fails if another writer has taken it: of two writers one goes first, and the other looks again.


def _path(spark: SparkSession, folder: str, *parts: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((folder.rstrip("/"), *parts)))
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _rows(spark: SparkSession, folder: str, tables: list[str]) -> DataFrame:
    if not tables:
        return nothing(spark)
    return spark.read.schema("key string, form string").parquet(*["/".join((folder.rstrip("/"), t)) for t in tables])


def snapshot(spark: SparkSession, folder: str) -> tuple[int, list[str]]:
    """The newest commit's number and tables; 0 and none for a folder without commits."""
    p, fs = _path(spark, folder, "commits")
    if not fs.exists(p):
        return 0, []
    last = max((f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().isdigit()), default=None)
    return (0, []) if last is None else (int(last), [r[0] for r in spark.read.text(f"{folder.rstrip('/')}/commits/{last}").collect()])


def _committed(spark: SparkSession, folder: str, number: int, tables: list[str]) -> bool:
    """Puts a commit in place; False if its number is taken."""
    jvm = spark.sparkContext._jvm
    new, fs = _path(spark, folder, "commits", f".{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray("\n".join(tables), "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(new).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(new), fs.makeQualified(_path(spark, folder, "commits", f"{number:012d}")[0]), never_over)
    except Py4JJavaError as e:
        fs.delete(new, False)
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
            raise
        return False
    return True


def _changed(spark: SparkSession, folder: str, work: Callable[[list[str]], tuple[DataFrame, list[str]] | None], tries: int = 20) -> int:
    """Writes what work makes of the newest state's tables and commits it with the tables that stay; looks again if another writer was first. A writer that fails commits nothing."""
    for _ in range(tries):
        number, tables = snapshot(spark, folder)
        made = work(tables)
        if made is None:
            return number
        rows, stay = made
        name = f"table-{uuid.uuid4().hex}"
        rows.select("key", "form").write.parquet(f"{folder.rstrip('/')}/{name}")
        if _committed(spark, folder, number + 1, [*stay, name]):
            return number + 1
        p, fs = _path(spark, folder, name)
        fs.delete(p, True)
    raise RuntimeError(f"the bank was changed by others {tries} times in a row")


def append(new: DataFrame, folder: str) -> int:
    """Adds forms (key, form) whose key isn't banked yet: the first writer of a key wins. Gives the number of the commit."""
    spark = new.sparkSession
    return _changed(spark, folder, lambda tables: (new.dropDuplicates(["key"]).join(_rows(spark, folder, tables).select("key"), "key", "left_anti"), tables))


def compacted(spark: SparkSession, folder: str) -> int:
    """Puts the tables of a bank together into one. Readers of an older state keep theirs until cleaned() is called."""
    return _changed(spark, folder, lambda tables: (_rows(spark, folder, tables), []) if len(tables) > 1 else None)


def cleaned(spark: SparkSession, folder: str) -> int:
    """Deletes tables that the newest state doesn't list; only for times when nobody writes or reads an older one. Gives their number."""
    _, tables = snapshot(spark, folder)
    p, fs = _path(spark, folder)
    gone = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("table-") and f.getPath().getName() not in tables]
    for g in gone:
        fs.delete(g, True)
    return len(gone)
