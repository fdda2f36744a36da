"""JSONL, manifests and exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE = "struct<head:string,body:array<string>>"
PROBLEM = f"problem_id string, tier string, split string, class string, seed string, signature string, problem struct<problem_id:string,background:struct<rules:array<{RULE}>,assumptions:array<string>,contraries:map<string,string>>,positive:array<string>,negative:array<string>,learnable:array<string>,domain:array<string>>"
SCORES = "problem_id string, arm string, sample_idx int, parse_ok boolean, valid boolean, clean boolean, exact boolean, agreement double, defeasible boolean, ref_defeasible boolean, error string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Rows of a JSONL file; a missing file is empty. Gold data fails on a bad line, answers keep it in _corrupt_record."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        return spark.createDataFrame([], kind)
    if strict:
        return spark.read.schema(kind).option("mode", "FAILFAST").json(path)
    return spark.read.schema(kind.add("_corrupt_record", "string")).option("mode", "PERMISSIVE").json(path)


def read_split(spark: SparkSession, path: str, schema: str, split: str) -> DataFrame:
    """Rows of one split; pruned where the data is partitioned by it."""
    return read(spark, path, schema).where(F.col("split") == split)


def write(df: DataFrame, path: str, order: list[str], files: int = 1) -> None:
    """Overwrite with the rows in order, in as many files as asked for."""
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def load_eval(spark: SparkSession, folder: str, eval_schema: str, prefixes: tuple[str, ...] = ("", "table1_")) -> DataFrame:
    """Evaluation rows with their problem, of every set of files <prefix>eval.jsonl and <prefix>problems.jsonl that is there."""
    out = None
    for prefix in prefixes:
        if not exists(spark, f"{folder}/{prefix}eval.jsonl"):
            continue
        rows = read(spark, f"{folder}/{prefix}eval.jsonl", eval_schema)
        part = rows.join(read(spark, f"{folder}/{prefix}problems.jsonl", PROBLEM).select("problem_id", "problem"), "problem_id").withColumn("set", F.lit(prefix.rstrip("_") or "corpus"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return read(spark, f"{folder}/eval.jsonl", eval_schema).withColumn("problem", F.lit(None).cast(T.StructType.fromDDL(PROBLEM)["problem"].dataType)).withColumn("set", F.lit("corpus"))
    return out


def stored_records(spark: SparkSession, folder: str, schema: str, prefixes: tuple[str, ...] = ("", "table1_")) -> DataFrame:
    """(problem_id, record): stored courses of all trace files, one for each problem."""
    parts = [read(spark, f"{folder}/{p}traces.jsonl", schema) for p in prefixes]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rest = [c for c in rows.columns if c != "problem_id"]
    return rows.select("problem_id", F.struct(*rest).alias("record"))


def without_torn_tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file whose writer may have died: a last line that does not parse is left out, any other bad line raises."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    kind = T.StructType.fromDDL(schema)
    lines = spark.read.text(path, lineSep="\n").select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("at")).where("trim(value) <> ''")
    parsed = lines.withColumn("row", F.from_json("value", kind.add("_bad", "string"), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    last = lines.groupBy("file_path").agg(F.max("at").alias("last"))
    checked = parsed.join(last, "file_path").where(F.col("row._bad").isNull() | (F.col("at") != F.col("last")))
    refused = F.when(F.col("row._bad").isNotNull(), F.raise_error(F.concat(F.lit("bad line in "), F.col("file_path")))).otherwise(F.col("row"))
    return checked.select(refused.alias("row")).select("row.*").drop("_bad")


def write_name_maps(problems: DataFrame, path: str) -> None:
    """(problem_id, name_map) as JSON lines, ordered by problem."""
    write(problems.select("problem_id", "name_map"), path, ["problem_id"])


def digests(df: DataFrame, keys: list[str], order: str, text: F.Column, width: int, *more: F.Column) -> DataFrame:
    """(keys.., n, more.., digest): a hash of the texts of each group in their order.

    Texts are hashed, hashes are joined for each range of `width` ids and hashed again, and the hashes of the ranges are hashed,
    so what is held at once is bounded by the width and by the number of ranges.
    """
    hashed = df.withColumn("__h", F.sha2(text, 256)).withColumn("__part", F.floor(F.col(order) / width))
    joined = lambda c, by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by), F.col(c)))), lambda x: x[c]), ""), 256)
    ranges = hashed.groupBy(*keys, "__part").agg(joined("__h", order).alias("__r")).groupBy(*keys).agg(joined("__r", "__part").alias("digest"))
    return hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *more).join(ranges, keys)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, n_bytes) of each file under path."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files whose checksum is not that of the manifest (name, sha256), or that are missing; empty when all is well."""
    found = checksums(spark, path).select("name", F.col("sha256").alias("found"))
    return manifest.join(found, "name", "left").where(~F.col("found").eqNullSafe(F.col("sha256"))).select("name", "sha256", "found")


def manifest(corpus: DataFrame, gate: DataFrame, tried: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One JSON row: counts by split, tier and class, symbols of the courses, gates, reject reasons, duplicate rates and file hashes."""
    from rulewright.operators.corpus import tallies

    as_json = lambda df, order: df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*order)))).alias("x"))
    counts = corpus.groupBy("split", "tier", "class").agg(F.count(F.lit(1)).alias("n"))
    out = as_json(counts, ["split", "tier", "class", "n"]).withColumnRenamed("x", "counts").crossJoin(gate.select(F.to_json(F.struct("*")).alias("gates")))
    if "solution" in corpus.columns:
        symbols = corpus.select(F.explode(F.from_json("solution", "steps array<struct<kind:string>>")["steps"]).alias("s")).groupBy(F.col("s.kind").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
        out = out.crossJoin(as_json(symbols, ["symbol", "n"]).withColumnRenamed("x", "symbols"))
    if tried is not None:
        reasons = tried.where("verdict <> 'accepted'").groupBy(F.regexp_extract("verdict", r"^[^:]+(?::(?!t\d)[^:]+)?", 0).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
        out = out.crossJoin(as_json(reasons, ["reason", "n"]).withColumnRenamed("x", "rejects")).crossJoin(as_json(tallies(tried), ["tier", "class", "attempts", "accepted", "duplicates", "duplicate_rate"]).withColumnRenamed("x", "duplicates"))
    if files is not None:
        out = out.crossJoin(as_json(files, ["name", "sha256"]).withColumnRenamed("x", "files"))
    return out  # every part is one row


#: Rows of a report table, at most; a longer result is no report.
REPORT_ROWS = 1000


def markdown(df: DataFrame, title: str) -> str:
    """A report table; a result of more than REPORT_ROWS rows raises instead of being brought to the driver."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows are no report")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def report(title: str, sections: dict[str, DataFrame], notes: list[str] = ()) -> str:
    """Several report tables under one title, with notes first."""
    tables = [markdown(df, name).replace("# ", "## ", 1) for name, df in sections.items()]
    return "\n".join([f"# {title}", "", *(f"- {n}" for n in notes), *([""] if notes else []), *tables])


def export_frameworks(df: DataFrame, path: str) -> None:
    """JSON with everything, CSV with the flat columns."""
    df.write.mode("overwrite").json(f"{path}/json")
    flat = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def problem_json(df: DataFrame, column: str = "problem") -> DataFrame:
    """The nested problem column as a JSON text."""
    return df.withColumn(column, F.to_json(column))


def problem_struct(df: DataFrame, column: str = "problem") -> DataFrame:
    kind = T.StructType.fromDDL(PROBLEM)["problem"].dataType
    return df.withColumn(column, F.from_json(column, kind))


def one_row(spark: SparkSession, values: dict) -> DataFrame:
    return spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "manifest string")
