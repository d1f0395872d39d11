"""Files of evaluations, observations and generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.functions.text import strip
from passageworks.operators.fragments import image_kind

SEEDS = "document string, kind string, question string, required_facts string, anchors string"
USAGE = "struct<calls:bigint,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
ROW = f"struct<id:string,answerable:boolean,latency_ms:double,result:struct<status:string,data_mode:string,model_usage:{USAGE}>>"
EXPERIMENT = f"name string, status string, expected bigint, config struct<split:string,dataset_sha256:string,mode:string>, rows array<{ROW}>"
ATTEMPT = f"case_id string, rubric_sha256 string, response struct<id:string,usage:{USAGE}>"
OBSERVATION = (
    "evidence_id string, device_id string, snapshot_id string, capability string, component string, fields array<string>, parameters map<string,string>, "
    "window_start timestamp, window_end timestamp, max_age_seconds bigint, values array<struct<field:string,value:string,unit:string,observed_at:timestamp>>, "
    "missing array<string>, status string, source string, raw_ref string")


def _parts(c: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(c, sep, -1), strip), lambda x: x != "")


def parse_seeds(raw: DataFrame) -> DataFrame:
    """S7. Multi-value fields: documents split at plus, facts and anchors at a double pipe; an anchor may
    name its document before a double colon and belongs to the first document otherwise."""
    docs = _parts(F.col("document"), r"\+")
    anchor = lambda a: F.struct(
        F.when(F.contains(a, F.lit("::")), strip(F.substring_index(a, "::", 1))).otherwise(docs[0]).alias("document"),
        F.when(F.contains(a, F.lit("::")), strip(F.substr(a, F.locate("::", a) + F.lit(2)))).otherwise(a).alias("anchor"))
    return raw.select("*", docs.alias("documents"), _parts(F.col("required_facts"), r"\|\|").alias("facts"),
                      F.transform(_parts(F.col("anchors"), r"\|\|"), anchor).alias("anchor_list"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """S7. A tab-separated seed file with a header line."""
    return parse_seeds(spark.read.schema(SEEDS).csv(path, sep="\t", header=True, quote=""))


def parse_experiments(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S8. ``path, value`` (one whole JSON document per row) to experiments, and the paths of documents
    that are none (not JSON, or a required part missing)."""
    x = raw.withColumn("e", F.from_json("value", EXPERIMENT)).select("path", "e.*")
    ok = F.col("name").isNotNull() & F.col("status").isNotNull() & F.col("expected").isNotNull() & F.col("config").isNotNull() & F.col("rows").isNotNull()
    return x.where(ok), x.where(~F.coalesce(ok, F.lit(False))).select("path")


def read_experiments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S8. Experiment files below a folder; other JSON files are listed, not read."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return parse_experiments(raw.select(F.col("_metadata.file_path").alias("path"), "value"))


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """S8. Judge attempts, one JSON object per line; unreadable lines keep their text."""
    schema = T.StructType.fromDDL(ATTEMPT).add("_corrupt_record", T.StringType())
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


MAX_RECORD = 1 << 20  # fixed value: bytes of an observation that is read


def parse_observations(lines: DataFrame, raw: str = "value") -> DataFrame:
    """S12. One JSON object a line to the observation's columns and ``malformed``: the line itself where it is no such object
    or longer than ``MAX_RECORD`` bytes, else null. No line is lost; other columns stay in front."""
    schema = T.StructType([*T.StructType.fromDDL(OBSERVATION).fields, T.StructField("malformed", T.StringType())])
    fits = F.octet_length(raw) <= MAX_RECORD
    got = F.from_json(F.when(fits, F.col(raw)), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"})
    others = [c for c in lines.columns if c != raw]
    o = lines.select(*others, raw, got.alias("o"))
    # text that is JSON but no object parses to nothing at all
    lost = ~fits | F.col("o").isNull() | F.col("o.malformed").isNotNull() | ~F.startswith(strip(F.col(raw)), F.lit("{"))
    names = T.StructType.fromDDL(OBSERVATION).fieldNames()
    return o.select(*others, *[F.when(~lost, F.col(f"o.{n}")).alias(n) for n in names], F.when(lost, F.col(raw)).alias("malformed"))


def read_observations(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """S12. The monitor's observations as a table or as a stream of files; blank lines are none."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return parse_observations(lines.where(strip(F.col("value")) != ""))


def read_images(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """T15. Cached image files as a table or a stream: ``path, url_sha`` (the file's name without its ending), ``bytes`` and ``kind``, which is
    null for what is no supported image. Only leading bytes leave the scan; Spark reads no empty files."""
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary") if stream else spark.read).format("binaryFile")
    f = reader.option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).alias("url_sha"), F.col("length").alias("bytes"), image_kind(F.col("content")).alias("kind"))


def split_observations(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S12. Headers, and one row per value."""
    v = obs.select("evidence_id", "device_id", F.explode("values").alias("v")).select("evidence_id", "device_id", "v.*")
    return obs.drop("values"), v


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """S13. A report as CSV, JSON or Parquet, written by the tasks that hold its rows."""
    w = df.write.mode("overwrite")
    (w.option("header", "true") if fmt == "csv" else w).format(fmt).save(path)


def generation_counts(frags: DataFrame, reps: DataFrame) -> DataFrame:
    """S14. What a generation holds, per document: fragments and representations."""
    f = frags.groupBy("document_id").agg(F.count("*").alias("fragments"))
    r = reps.join(frags.select("fragment_id", "document_id"), "fragment_id").groupBy("document_id").agg(F.count("*").alias("representations"))
    return f.join(r, "document_id", "left").fillna(0, ["representations"])


def generation_gaps(counts: DataFrame, manifest: DataFrame) -> DataFrame:
    """S14. Documents whose counts differ from the manifest's."""
    m = manifest.select("document_id", F.col("fragments").alias("want_f"), F.col("representations").alias("want_r"))
    j = counts.join(m, "document_id", "full")
    return j.where(~(F.col("fragments").eqNullSafe(F.col("want_f")) & F.col("representations").eqNullSafe(F.col("want_r")))).select(
        "document_id", "fragments", "want_f", "representations", "want_r")


def publish_generation(frags: DataFrame, reps: DataFrame, manifest: DataFrame, root: str, generation: str) -> bool:
    """S14. Write a generation beside the others, compare what was written with the manifest, and only
    then add it to ``current``. Readers take the newest generation there, so a failed write loses nothing."""
    spark = frags.sparkSession
    frags.write.mode("overwrite").parquet(f"{root}/fragments/generation={generation}")
    reps.write.mode("overwrite").parquet(f"{root}/representations/generation={generation}")
    back = [spark.read.parquet(f"{root}/{t}/generation={generation}") for t in ("fragments", "representations")]
    if not generation_gaps(generation_counts(*back), manifest).isEmpty():
        return False
    spark.createDataFrame([(generation,)], "generation string").withColumn("published_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/current")
    return True


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """S14. A table of the generation published last."""
    g = spark.read.parquet(f"{root}/current").agg(F.max_by("generation", "published_at")).first()[0]
    return spark.read.parquet(f"{root}/{table}").where(F.col("generation") == g)
