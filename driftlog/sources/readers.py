"""Readers: Parquet with a known schema, typed CSV, JSON documents, word problems and shard manifests."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.functions.answers import rational


def require(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The frame, if it has all the columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, pruned by its partition folders; a schema spares the read of footers."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None, missing_ok: bool = False) -> DataFrame:
    """CSV with a header, read by column name; an empty text is NULL. A missing file is an error, or no rows."""
    from pyspark.errors import AnalysisException

    names = spark.createDataFrame([], schema)
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
            return names
        raise
    require(raw, required or [], path)
    return raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in names.schema))


def file_hashes(spark: SparkSession, path: str, most: int = 1 << 30, glob: str = "*") -> DataFrame:
    """``(path, size_bytes, sha256)`` of every file under a path, hashed where it is read.

    Files of up to ``most`` bytes (2 GB is what a row holds) come as one value, by any file system of Spark's;
    larger ones are read as a stream of pieces in a task of their own, from a local or mounted path or a store that Arrow reads.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    small = files.where(F.col("length") <= most).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > most).select("path", F.col("length").alias("size_bytes"))  # names and sizes, no content
    return small.unionByName(large.mapInArrow(_streamed(8 << 20), "path string, size_bytes bigint, sha256 string"))


def _streamed(piece: int):
    """Hashes of files by pieces, so that a task holds one piece; free of this module so that workers need not have it."""

    def run(batches):
        import hashlib
        import re

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            out = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size_bytes").to_pylist(), strict=True):
                local = re.match("file:/*(/.*)", path)
                system, name = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)
                whole, n = hashlib.sha256(), 0
                with system.open_input_stream(name) as stream:
                    while block := stream.read(piece):
                        whole.update(block)
                        n += len(block)
                if n != size:
                    raise OSError(f"{path} changed while it was read")
                out.append(whole.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size_bytes"), pa.array(out, pa.string())], ["path", "size_bytes", "sha256"])

    return run


def tree_hash(spark: SparkSession, path: str) -> dict[str, Any]:
    """One hash of a folder's files: of the list of their relative paths, sizes and hashes. An empty folder is an error."""
    import hashlib

    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    top = system.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    name = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath().removeprefix(top)
    records, listed = {}, system.listFiles(root, True)
    while listed.hasNext():  # names and sizes; empty files are never opened
        at = listed.next()
        if not at.getLen():
            records[name(at.getPath().toString())] = (0, hashlib.sha256(b"").hexdigest())
    for r in file_hashes(spark, path).collect() if system.exists(root) else []:  # a row a file, no content
        records[name(r.path)] = (r.size_bytes, r.sha256)
    if not records:
        raise ValueError(f"{path} has no files")
    files = [{"path": p, "size_bytes": n, "sha256": h} for p, (n, h) in sorted(records.items())]
    text = json.dumps(files, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {"tree_sha256": hashlib.sha256(text.encode()).hexdigest(), "file_count": len(files), "total_bytes": sum(f["size_bytes"] for f in files), "files": files}


def table(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, str]:
    """A typed CSV table with its required columns, and the hash of its file."""
    found = file_hashes(spark, path).select("path", "sha256").orderBy("path").collect()  # a row a file
    if not found:
        raise FileNotFoundError(path)
    import hashlib

    own = found[0].sha256 if len(found) == 1 else hashlib.sha256("".join(r.sha256 for r in found).encode()).hexdigest()
    return csv(spark, path, schema, required), own


def document(spark: SparkSession, path: str) -> dict[str, Any]:
    """A JSON object from any file system that Spark reads."""
    rows = spark.read.text(path, wholetext=True).collect()
    out = json.loads(rows[0].value)
    if not isinstance(out, dict):
        raise ValueError(f"{path} is not a JSON object")
    return out


def protocol(spark: SparkSession, path: str) -> dict[str, Any]:
    """A YAML configuration of nested mappings, lists and scalars, as a dictionary; its text's hash under ``sha256``."""
    import hashlib

    text = spark.read.text(path, wholetext=True).collect()[0].value
    try:
        import yaml
    except ImportError:
        out = _yaml(text)
    else:
        out = yaml.safe_load(text)
    return {**out, "sha256": hashlib.sha256(text.encode()).hexdigest()}


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    named = {"true": True, "false": False, "null": None, "~": None, "": None}
    if text.lower() in named:
        return named[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _yaml(text: str) -> dict[str, Any]:
    """Block mappings and lists of scalars, by indentation; for where no YAML library is installed."""
    lines = [(len(x) - len(x.lstrip()), x.split(" #")[0].strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(i: int, depth: int) -> tuple[Any, int]:
        out: Any = [] if lines[i][1].startswith("- ") else {}
        while i < len(lines) and lines[i][0] == depth:
            line = lines[i][1]
            if isinstance(out, list):
                out.append(_scalar(line[2:]))
                i += 1
                continue
            key, _, value = line.partition(":")
            i += 1
            if value.strip():
                out[key.strip()] = _scalar(value)
            elif i < len(lines) and (lines[i][0] > depth or lines[i][0] == depth and lines[i][1].startswith("- ")):
                out[key.strip()], i = block(i, lines[i][0])
            else:
                out[key.strip()] = None
        return out, i

    return block(0, lines[0][0])[0] if lines else {}


def word_problems(spark: SparkSession, path: str) -> DataFrame:
    """Problems from a JSON array: body and question as one text, the numeric answer as a rational, an id from their hash."""
    rows = spark.read.schema("ID string, Body string, Question string, Answer string, Type string").option("multiLine", True).json(path)
    text = F.concat_ws("\n", F.trim("Body"), F.trim("Question"))
    return rows.select(F.sha2(F.to_json(F.struct(F.col("ID").alias("id"), text.alias("question"))), 256).alias("prompt_id"), F.col("ID").alias("source_id"), text.alias("question"), rational(F.regexp_replace("Answer", r"\.0+$", "")).alias("gold"), "Type")


def pinned(spark: SparkSession, path: str, rows: int, schema: str | None = None) -> DataFrame:
    """Parquet of an expected number of rows."""
    df = parquet(spark, path, schema)
    n = df.count()
    if n != rows:
        raise ValueError(f"{path} has {n} rows, not {rows}")
    return df


def summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Many small JSON documents of one schema, with the file of each."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


MANIFEST = "data_file string, sha256 string, row_count bigint, unit string, parquet struct<local_path: string, file_sha256: string, row_count: bigint>, sample_start bigint, sample_end_exclusive bigint, shard_index bigint"


def shard_manifests(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``(data_file, sha256, row_count, unit, manifest_file)`` of shard manifests as they stand; ``shard_breaks`` holds them against their files.

    A manifest says these itself, or under ``parquet`` (local_path, file_sha256, row_count); then its unit is
    its range of samples and index under the folder that all its shards are in. With ``recursive``, every
    manifest.json in a folder "shard=..." below the path is read.
    """
    reader = spark.read.schema(MANIFEST).option("multiLine", True)
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json")
    rows = reader.json(path).withColumn("manifest_file", F.col("_metadata.file_path"))
    if recursive:
        rows = rows.where(F.col("manifest_file").rlike("/shard=[^/]*/[^/]*$"))
    group = F.regexp_extract(F.col("parquet.local_path"), "^(.*)/shard=[^/]*/[^/]*$", 1)
    own = F.when(F.col("parquet").isNotNull(), F.concat_ws("/", group, F.col("sample_start").cast("string"), F.col("sample_end_exclusive").cast("string"), F.col("shard_index").cast("string")))
    return rows.select(
        F.coalesce("data_file", "parquet.local_path").alias("data_file"),
        F.coalesce("sha256", "parquet.file_sha256").alias("sha256"),
        F.coalesce("row_count", "parquet.row_count").alias("row_count"),
        F.coalesce("unit", own).alias("unit"),
        "manifest_file",
    )


def _below(spark: SparkSession, folder: str, path: Column) -> Column:
    """The part of a file's path below a folder; a path that is relative is taken to be below it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    top = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    plain = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*(?=/)", "")
    inside = F.when(plain.startswith(F.lit(top)), F.substr(plain, F.lit(len(top) + 1))).otherwise(plain)
    return F.regexp_replace(inside, "^([.]/)+", "")


def shard_breaks(spark: SparkSession, manifests: DataFrame, folder: str, schema: str) -> DataFrame:
    """``(rule, row)`` of shards whose file is not there or has another hash or number of rows, and of files or units claimed twice.

    ``data_file`` is a path below ``folder``, or a whole one; shards may be in folders of their own with files named alike.
    A path that is none, as its root was another, is found by its last name if one file and one shard alone have that.
    """
    from driftlog.operators.checks import broken, duplicates

    files = file_hashes(spark, folder, glob="*.parquet").select(_below(spark, folder, F.col("path")).alias("_name"), F.col("sha256").alias("_sha256"))
    decoded = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "[+]", "%2B"))
    counts = _shards(spark, folder, schema).groupBy(_below(spark, folder, decoded).alias("_name")).agg(F.count(F.lit(1)).alias("_n"))
    last = F.element_at(F.split("_name", "/"), -1)
    alone = lambda df: df.groupBy("_last").agg(F.max("_name").alias("_other"), F.count(F.lit(1)).alias("_alike")).where("_alike = 1")
    named = manifests.withColumn("_name", _below(spark, folder, F.col("data_file"))).withColumn("_last", last)
    lost = named.select("_name", "_last").join(files, "_name", "left_anti")
    found = alone(lost).select("_last", F.col("_other").alias("_name")).join(alone(files.withColumn("_last", last)).select("_last", "_other"), "_last")
    named = named.drop("_last").join(found.select("_name", "_other"), "_name", "left").withColumn("_name", F.coalesce("_other", "_name")).drop("_other")
    both = named.join(files, "_name", "left").join(counts, "_name", "left")
    own = broken(both, {"missing": F.col("_sha256").isNull(), "sha256": F.col("_sha256") != F.col("sha256"), "row_count": F.col("_sha256").isNotNull() & (F.coalesce("_n", F.lit(0)) != F.col("row_count"))}, ["data_file", "unit"])
    twice = [duplicates(named.withColumn("data_file", F.col("_name")), [c]).select(F.lit(f"duplicate_{c}").alias("rule"), F.to_json(F.struct(c)).alias("row")) for c in ("data_file", "unit")]
    return own.unionByName(twice[0]).unionByName(twice[1])


def _shards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)


def verified_shards(spark: SparkSession, manifest_path: str, folder: str, schema: str, recursive: bool = False) -> DataFrame:
    """Rows of all shards, once their manifests hold."""
    from driftlog.operators.checks import assert_none

    assert_none(shard_breaks(spark, shard_manifests(spark, manifest_path, recursive), folder, schema))
    return _shards(spark, folder, schema)


def rescores(spark: SparkSession, path: str, schema: str, where: str, k: int) -> DataFrame:
    """Rescore rows of some pairs (a condition on partition columns), the first k samples, once their invariants hold."""
    from driftlog.operators import checks

    rows = spark.read.schema(schema).parquet(path).where(where).where(F.col("sample_index") < k)
    keys = ["split", "training_seed", "behavior_step", "target_step", "purpose", "prompt_id"]
    gaps = checks.completeness(rows, keys, k)
    checks.assert_none(checks.rescore_rows(rows).unionByName(gaps.select(F.lit("samples").alias("rule"), F.to_json(F.struct(*keys)).alias("row"))))
    return rows
