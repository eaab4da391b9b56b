"""Readers and writers of logs, traces, metric files and label tables. All take an explicit schema; none needs a second pass to infer one."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MESSAGES = "event_uid string, message_uid string, previous_event_uid string, trajectory_uid string, sequence_index bigint, event_type string, round_index bigint, stage string, sender string, role string, content string, extra_json string"
TRAJECTORIES = "trajectory_uid string, problem_uid string, benchmark_id string, slice_id string, protocol_id string, actor_model_id string, evaluator_model_id string, run_id string, final_answer string, final_correct string, release_status string, provenance_status string"
METRIC = "section string, metric string, value double, numerator double, denominator double, source string, notes string"
#: Metadata of a file source: where a row came from.
_FILE = "_metadata.file_path"


def parquet(spark: SparkSession, path: str, schema: str | StructType | None = None, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A projected scan; the columns and the condition reach the files."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the folder that all executors share (spark.checkpoint.dir) and reads it back.

    For results that several branches of one plan read and that cost more than their size: branches then prune and filter the files.
    Only a local session may do without the setting.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="episodica-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STORED: dict[tuple, DataFrame] = {}


def stored_once(spark: SparkSession, name: str, source: str, make) -> DataFrame:
    """stored(make()), written once a session for one state of the files at `source`: their paths, sizes and times of change are part of the key."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    key = (spark.sparkContext.applicationId, name, *sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))
    if key not in _STORED:
        _STORED[key] = stored(make(), name)
    return _STORED[key]


def messages(spark: SparkSession, path: str, schema: str = MESSAGES) -> DataFrame:
    """The message log as uid, seq and so on. A row without an index is placed where it arrived: by file and row in it."""
    df = spark.read.schema(schema).parquet(path).withColumns({"_f": F.col(_FILE), "_r": F.col("_metadata.row_index")})
    w = Window.partitionBy("trajectory_uid").orderBy("_f", "_r")
    arrived = (F.row_number().over(w) - 1).cast("long")
    x = df.withColumn("arrival", arrived).withColumn("_s", F.coalesce("sequence_index", "arrival"))
    seq = (F.row_number().over(Window.partitionBy("trajectory_uid").orderBy("_s", "arrival")) - 1).cast("long")
    return x.withColumns({"seq": seq, "event_uid": F.coalesce("event_uid", "message_uid", F.concat(F.lit("sequence:"), F.col("_s")))}).withColumnRenamed("trajectory_uid", "uid").drop("_f", "_r", "_s")


def broken_runs(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Keys whose rows are not one run in one file, as a reader of batches would meet them again after they had ended: key, files, rows, span.
    One aggregate with partial sums; a null key is a key."""
    at = F.col("_metadata.row_index")
    x = spark.read.parquet(path).select(key, F.col(_FILE).alias("_f"), at.alias("_i")).groupBy(key, "_f").agg(F.count("*").alias("rows"), (F.max("_i") - F.min("_i") + 1).alias("span"))
    return x.groupBy(key).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("span").alias("span")).where("files > 1 OR rows <> span")


def require_runs(spark: SparkSession, path: str, key: str) -> None:
    """Raises at a key that re-appears (broken_runs)."""
    if bad := broken_runs(spark, path, key).orderBy(key).first():
        raise ValueError(f"{key} {bad[0]} re-appears: {bad['rows']} rows in {bad['files']} files over {bad['span']} places")


def require_unique(df: DataFrame, key: str) -> None:
    """Raises at a key of more than one row."""
    if bad := df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").orderBy(key).first():
        raise ValueError(f"{key} {bad[0]} has {bad['rows']} rows")


def table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; fields may hold line ends."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, multiLine=True, escape='"', quote='"', mode="FAILFAST")


def json_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Drops NUL bytes, blank lines and lines that aren't objects of the schema."""
    text = spark.read.text(path).select(F.regexp_replace("value", "\\x00", "").alias("v")).where("trim(v) <> ''")
    row = F.from_json("v", StructType.fromDDL(schema).add("_corrupt_record", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return text.select(row.alias("r")).where("r IS NOT NULL AND r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")


def last_by_key(df: DataFrame, key: Column, position: str) -> DataFrame:
    """One row per key: the last wins. A null, empty or zero key gives way to the position."""
    k = F.when(key.isNull() | key.cast("string").isin("", "0"), F.col(position).cast("string")).otherwise(key.cast("string"))
    return df.withColumn("key", k).withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.col(position).desc()))).where("_r = 1").drop("_r")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file below a folder: path, modificationTime, length, and tier, mode, chunk and part as its path says."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime", "length")
    part = lambda p: F.nullif(F.regexp_extract("path", p, 1), F.lit(""))
    return found.withColumns({"tier": part(r"(?i)/tier_?(\d+)").cast("int"), "chunk": part(r"(?i)/(?:chunk|chunck)_?(\d+)").cast("int"), "part": part(r"(?i)/part_?(\d+)").cast("int"), "mode": F.coalesce(part(r"(?i)/tier_?\d+/([^/]+)/"), part(r"(?i)/([^/]+)/tier_?\d+"))})


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of each file below a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return read.select("path", "length", F.sha2("content", 256).alias("sha256"))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text traces (*.trace.txt), one row per turn: trace_path, task, example_idx, input_text, label, turn_idx, turn_label, agent_id, agent_name, content.

    A file is one task's log and read whole; its examples stand between rules of 80 "=".
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.trace.txt").text(path, wholetext=True).withColumn("trace_path", F.col(_FILE))
    ids, names = (F.regexp_extract_all("value", F.lit(r"(?m)^(A\d+): name=(\S+)"), F.lit(i)) for i in (1, 2))
    x = text.select("trace_path", F.regexp_extract("value", r'"task":\s*"([^"]*)"', 1).alias("task"), F.map_from_arrays(ids, names).alias("agents"), F.posexplode(F.split("value", "={80}")).alias("at", "body"))
    x = x.where(r"body RLIKE '(?m)^EXAMPLE \\d+'")
    get = lambda p: F.regexp_extract("body", p, 1)
    x = x.select("trace_path", "task", "agents", get(r"(?m)^EXAMPLE (\d+)").cast("long").alias("example_idx"), get(r"(?m)^input: (.*)$").alias("input_text"), get(r"(?m)^label: (.*)$").alias("label"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?m)^(T\d+(?:_\d+)?: [^\n]*)$"), F.lit(1))).alias("turn_idx", "line"))
    one = lambda i: F.regexp_extract("line", r"^(T\d+(?:_\d+)?): ([^:]+): ?(.*)$", i)
    return x.select("trace_path", "task", "example_idx", "input_text", "label", F.col("turn_idx").cast("long"), one(1).alias("turn_label"), one(2).alias("agent_id"), F.coalesce(F.try_element_at("agents", one(2)), one(2)).alias("agent_name"), one(3).alias("content"))


def render_traces(turns: DataFrame) -> DataFrame:
    """The text of each example as traces() reads it: example_idx, value. Line ends in texts become spaces. turns: example_idx, input_text, label, turn_idx, agent_id, content."""
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " ")
    line = F.struct("turn_idx", F.concat(F.lit("T"), "turn_idx", F.lit(": "), "agent_id", F.lit(": "), flat(F.col("content"))).alias("s"))
    x = turns.groupBy("example_idx").agg(F.first("input_text").alias("i"), F.first("label").alias("l"), F.array_sort(F.collect_list(line)).alias("lines"))
    body = F.concat(F.lit("=" * 80 + "\nEXAMPLE "), "example_idx", F.lit("\ninput: "), flat(F.col("i")), F.lit("\nlabel: "), flat(F.col("l")), F.lit("\n"), F.array_join(F.transform("lines", lambda r: r["s"]), "\n"))
    return x.select("example_idx", body.alias("value"))


def problems(raw: DataFrame, position: str) -> DataFrame:
    """Benchmark rows under one name each: problem, answer (the first of answer_number, answer and label that isn't blank), tier, domain."""
    have = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in raw.columns), F.lit(None).cast("string"))
    return raw.select(F.col(position).alias("position"), have("question", "problem", "input", "text").alias("problem"), have("answer_number", "answer", "label").alias("answer"), have("difficulty_tier", "tier").alias("tier"))


def remaining(df: DataFrame, written: DataFrame, key: list[str], start: str | None = None, low: int = 0, high: int | None = None) -> DataFrame:
    """Rows of a range that aren't written yet."""
    if start:
        df = df.where(F.col(start) >= low) if high is None else df.where((F.col(start) >= low) & (F.col(start) < high))
    return df.join(written.select(*key).distinct(), key, "left_anti")


def write_table(df: DataFrame, path: str, fields: list[str], sep: str = ",") -> None:
    """CSV or TSV of some columns in a fixed order, nested ones as JSON, nulls empty. Spark commits the folder as a whole."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c)
    df.select(*map(cell, fields)).write.mode("overwrite").csv(path, header=True, sep=sep, escape='"', nullValue="", emptyValue="")


def best_sidecar(spark: SparkSession, path: str, stems: list[str], suffix: str = ".metrics.jsonl") -> DataFrame:
    """The metrics file of a folder to read, as `path` and `lines`: one named like a trace if there is any, then the one with the most lines that aren't blank, the latest, the last by name. No row if the folder has none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    # Spark's own listing leaves empty files out.
    listed = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, f"*{suffix}"))
    found = spark.createDataFrame([(s.getPath().toString(), s.getModificationTime(), s.getPath().getName()) for s in listed], "path string, modified bigint, name string")
    lines = spark.read.option("pathGlobFilter", f"*{suffix}").text(path).where("trim(value) <> ''").groupBy(F.col(_FILE).alias("path")).agg(F.count("*").alias("lines"))
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  both readers name a local file in their own way
    x = found.withColumn("_at", same("path")).join(lines.select(same("path").alias("_at"), "lines"), "_at", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    return x.orderBy(F.col("name").isin([f"{s}{suffix}" for s in stems]).desc(), F.col("lines").desc(), F.col("modified").desc(), F.col("name").desc()).select("path", "lines").limit(1)


def write_or_remove(df: DataFrame, path: str, fields: list[str]) -> bool:
    """Writes a report as CSV; if it has no row, removes the one that a run before may have left. Returns whether it was written."""
    if not df.isEmpty():
        write_table(df, path, fields)
        return True
    spark = df.sparkSession
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return False


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_manifest(spark: SparkSession, counts: dict, outputs: str, path: str) -> None:
    """The digests of the files below `outputs` as a table, `path`-files (path below outputs, length, sha256), and as one line of JSON with
    sorted keys the counts, the number of files and the table's own digest, which doesn't depend on the order of its rows."""
    root = spark._jvm.org.apache.hadoop.fs.Path(outputs)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    digests(spark, outputs, "part-*").select(F.substr("path", F.lit(len(base) + 2)).alias("path"), "length", "sha256").write.mode("overwrite").parquet(f"{path}-files")
    # Digests of rows, of the sorted rows of each of 4,096 parts, and of the sorted parts: no row grows with the table.
    whole = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    rows = spark.read.parquet(f"{path}-files").select(F.sha2(F.to_json(F.struct("path", "length", "sha256")), 256).alias("row"))
    found = rows.groupBy(F.substring("row", 1, 3)).agg(whole("row").alias("part"), F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), whole("part").alias("sha256")).first()
    spark.createDataFrame([(json.dumps({"counts": counts, "files": {"count": found.n, "sha256": found.sha256}}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
