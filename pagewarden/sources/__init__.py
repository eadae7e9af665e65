"""Sources and sinks: capture logs, screenshots, label files, page fixtures, result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden import schema
from pagewarden.functions import boxes as B
from pagewarden.sources.named import read_named, through_files, through_own_files, write_named

ROLE_LISTS = {"links": "link", "buttons": "button", "controls": "control", "frames": "frame", "canvases": "canvas"}


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The capture log: one JSON document a step; unreadable files give rows of nulls."""
    return spark.read.schema(schema.LOG).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def stream_captures(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream of arriving files."""
    r = spark.readStream.schema(schema.LOG).option("multiLine", True).option("pathGlobFilter", "*.json")
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).json(path)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def read_screenshots(spark: SparkSession, path: str) -> DataFrame:
    """(stem, mime, content) of saved screenshots; join a capture log by the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,webp,jpg}").load(path)
    end = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    return files.select(stem(F.col("path")).alias("stem"), F.when(end == "jpg", "image/jpeg").otherwise(F.concat(F.lit("image/"), end)).alias("mime"), "content")


def decode_base64(data: Column) -> Column:
    """Bytes of base64 text; null, never an error, for anything else."""
    return F.try_to_binary(data, F.lit("base64"))


def encode_base64(data: Column) -> Column:
    return F.base64(data)


def write_captures(captures: DataFrame, path: str, id: str = "id") -> None:  # noqa: A002
    """The capture log: a file <id>.json for each capture; null fields are left out."""
    write_named(captures.select(F.col(id), F.to_json(F.struct(*captures.columns))), path, ".json")


def label_lines(files: DataFrame) -> DataFrame:
    """(image_id, id, line_no, cls, cx, cy, w, h) of label files (name, content), a line a box; blank lines are dropped before counting."""
    lines = F.filter(F.split(F.trim("content"), r"\r?\n"), lambda x: F.trim(x) != "")
    parts = files.select(F.col("name").alias("image_id"), F.posexplode(lines).alias("line_no", "line")).withColumn("p", F.split(F.trim("line"), r"\s+"))
    number = lambda i: F.get("p", F.lit(i)).try_cast("double")
    return parts.select("image_id", F.concat(F.lit("gt_"), F.col("line_no").cast("string")).alias("id"), "line_no", F.get("p", F.lit(0)).try_cast("int").alias("cls"), *(number(i).alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """label_lines of the files <image_id>.txt in a folder, or of one file."""
    return label_lines(read_named(spark, path, ".txt"))


def stream_labels(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream of arriving files."""
    return label_lines(read_named(spark, path, ".txt", files_per_trigger, stream=True))


def label_contents(boxes: DataFrame) -> DataFrame:
    """(image_id, content): each image's label lines; ``boxes`` has image_id, cls, idx, box, vw, vh."""
    line = B.norm_line(F.col("cls"), B.box("x", "y", "width", "height"), F.col("vw"), F.col("vh"))
    of_image = F.sort_array(F.collect_list(F.struct("idx", line.alias("line"))))
    return boxes.groupBy("image_id").agg(F.concat(F.array_join(F.transform(of_image, lambda r: r["line"]), "\n"), F.lit("\n")).alias("content"))


def write_labels(boxes: DataFrame, path: str) -> None:
    """A file <image_id>.txt of label lines for each image; ``boxes`` as in label_contents."""
    write_named(label_contents(boxes), path, ".txt")


_ITEM = "array<struct<label:string,bbox:struct<x:double,y:double,width:double,height:double>>>"
_PLAIN = "array<struct<x:double,y:double,width:double,height:double>>"
_KINDS = {k: _PLAIN if k in ("frames", "canvases") else _ITEM for k in ROLE_LISTS}
FIXTURE = "viewport struct<width:double,height:double>, " + ", ".join(f"{k} {v}" for k, v in _KINDS.items())


def fixture_rows(pages: DataFrame) -> DataFrame:
    """(page, role, pos, label, box, vw, vh) of page fixtures; ``pages`` has page and the columns of FIXTURE."""
    # All lists of a file as one, so that files are read once and not once a role.
    whole = lambda e: F.struct(F.lit(None).cast("string").alias("label"), e.alias("bbox"))
    same = {k: (F.transform(k, whole) if _KINDS[k] == _PLAIN else F.col(k)).cast(_ITEM) for k in ROLE_LISTS}
    lists = F.array(*(F.struct(F.lit(role).alias("role"), same[k].alias("items")) for k, role in ROLE_LISTS.items()))
    rows = pages.select("page", "viewport", F.explode(lists).alias("of")).select("page", "viewport", F.col("of.role").alias("role"), F.posexplode("of.items").alias("pos", "e"))
    return rows.select("page", "role", "pos", F.col("e.label").alias("label"), *(F.col(f"e.bbox.{k}").alias(k) for k in ("x", "y", "width", "height")), F.col("viewport.width").alias("vw"), F.col("viewport.height").alias("vh"))


def fixture_lines(files: DataFrame) -> DataFrame:
    """fixture_rows of page fixtures (name, content)."""
    return fixture_rows(files.select(F.col("name").alias("page"), F.from_json("content", FIXTURE).alias("f")).select("page", "f.*"))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """fixture_rows of the files <page>.json in a folder, or of one file."""
    return fixture_rows(spark.read.schema(FIXTURE).option("multiLine", True).json(path).withColumn("page", stem(F.input_file_name())))


def write_results(df: DataFrame, path: str) -> None:
    """Results both as JSON rows and as a table."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").parquet(f"{path}/table")
