"""Sources and sinks: files and tables of files, prompts, the usage log and the score cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import vocab as V


def read_files(spark: SparkSession, paths, glob: str | None = None, suffixes=V.CODE_SUFFIXES, ignored=V.IGNORED_DIRS) -> DataFrame:
    """(file_path, body) of text files below paths; binary files and ignored folders are left out.

    A file is binary if it has a NUL among its first 2,048 bytes or is not UTF-8."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(paths).select(F.col("path").alias("file_path"), "content")
    if suffixes:
        files = files.where(F.regexp_extract("file_path", r"(\.[^./]*)$", 1).isin(*suffixes))
    parts = F.split("file_path", "/")
    files = files.where(~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in ignored])))
    return files.where(~is_binary(F.col("content"))).select("file_path", F.col("content").cast("string").alias("body"))


def is_binary(content: Column) -> Column:
    """Whether bytes have a NUL among the first 2,048 or are not UTF-8."""
    nul = F.position(F.unhex(F.lit("00")).cast("string"), F.substring(content, 1, 2048).cast("string")) > 0
    return nul | ~F.call_function("is_valid_utf8", content.cast("string"))


def candidate_inputs(inputs: DataFrame, files: DataFrame) -> DataFrame:
    """(no, candidate, is_path) of input lines (no, value): `path:rest` is cut to its path if there is such a file."""
    head = inputs.withColumn("head", F.substring_index("value", ":", 1))
    known = files.select(F.col("file_path").alias("head")).distinct().withColumn("is_path", F.lit(True))
    out = head.join(known, "head", "left").withColumn("is_path", F.coalesce("is_path", F.lit(False)))
    return out.select("no", F.when(F.col("is_path"), F.col("head")).otherwise(F.col("value")).alias("candidate"), "is_path")


def prepared_inputs(inputs: DataFrame, files: DataFrame) -> DataFrame:
    """(file_idx, file_path, body) of input lines: a known path's file, or the line itself as raw text without a path."""
    told = candidate_inputs(inputs, files)
    held = told.join(files.select(F.col("file_path").alias("candidate"), F.col("body").alias("found")), "candidate", "left")
    return held.select(F.col("no").alias("file_idx"), F.when(F.col("is_path"), F.col("candidate")).alias("file_path"), F.when(F.col("is_path"), F.col("found")).otherwise(F.col("candidate")).alias("body"))


def sliced_once(files: DataFrame, cut) -> DataFrame:
    """cut(files) with each distinct body cut once: slices are made for one file of a body and placed at all its paths.

    cut: (file_idx, file_path, body) -> slices whose id and symbol begin or end with the path they were cut for."""
    keyed = files.withColumn("__body", F.sha2("body", 256))
    # where the symbol is the file's name, it is that of the path where the slice is placed
    one = keyed.groupBy("__body").agg(F.first("body").alias("body")).select(F.lit(0).cast("bigint").alias("file_idx"), F.col("__body").alias("file_path"), "body")
    slices = cut(one).withColumnRenamed("file_path", "__body").drop("file_idx")
    placed = slices.join(keyed.select("__body", "file_idx", "file_path"), "__body")
    rest = F.expr("substring(id, length(__body) + 1)")
    symbol = F.when(F.col("symbol") == F.col("__body"), F.regexp_extract("file_path", "[^/]*$", 0)).otherwise(F.col("symbol"))
    return placed.withColumns({"id": F.concat("file_path", rest), "symbol": symbol}).drop("__body")


def fresh_expansions(cache: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Rows of an expansion cache (key, terms, ts in milliseconds) that are younger than `days`."""
    return cache.where(F.lit(now_ms) - F.col("ts") < days * 86_400_000)


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_idx, file_path, body): the documents table seen as a tree of text files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return docs.select(F.col("doc_id").alias("file_idx"), F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), part("doc_id"), F.lit(".txt")).alias("file_path"), F.coalesce("text", F.lit("")).alias("body"))


def raw_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Inputs that are no paths, as rows of a file table without a path."""
    return spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "file_idx bigint, file_path string, body string")


def resolve_paths(files: DataFrame, patterns: list[str], most: int = 200) -> DataFrame:
    """Files whose path fits a glob (`**/`, `*`, `?`) or lies below a named folder, each once, `most` of them."""
    keep = F.lit(False)
    for p in patterns:
        keep = keep | F.col("file_path").rlike(glob_to_regex(p)) | F.col("file_path").startswith(p.rstrip("/") + "/")
    for d in V.IGNORED_DIRS:
        keep = keep & ~F.contains("file_path", F.lit(f"/{d}/"))
    return files.where(keep).dropDuplicates(["file_path"]).orderBy("file_path").limit(most)


def glob_to_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c
            i += 1
    return f"^{out}$"


def path_keyword_files(files: DataFrame, words: list[str], most: int = 30) -> DataFrame:
    """Files ranked by how many query words of three letters or more their path holds."""
    score = sum((2 * F.contains(F.lower("file_path"), F.lit(w)).cast("int") for w in dict.fromkeys(words) if len(w) > 2), F.lit(0))
    return files.withColumn("path_score", score).orderBy(F.desc("path_score"), "file_idx").limit(most)


def last_user_request(lines: DataFrame) -> DataFrame:
    """The last user input of a transcript of JSON lines (line_no, value), between its request tags."""
    parsed = lines.select("line_no", F.from_json("value", "type string, content string", {"mode": "PERMISSIVE"}).alias("j")).where("j.type = 'USER_INPUT'")
    inner = F.regexp_extract("j.content", r"(?s)<USER_REQUEST>\s*(.*?)\s*</USER_REQUEST>", 1)
    return parsed.agg(F.max_by(F.when(inner != "", inner).otherwise(F.trim("j.content")), "line_no").alias("request"))


def append_usage(rows: DataFrame, path: str) -> None:
    """Append usage rows as JSON lines; queries are cut to 500 characters."""
    rows.withColumn("query", F.substring("query", 1, 500)).write.mode("append").json(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The usage log; torn lines are skipped."""
    return spark.read.schema(schemas.USAGE).option("mode", "DROPMALFORMED").json(path)


def parse_usage(lines: DataFrame) -> DataFrame:
    """Usage rows of JSON lines (value); torn lines are skipped."""
    return lines.select(F.from_json("value", schemas.USAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("u"), F.expr("try_parse_json(value)").isNotNull().alias("whole")).where("whole").select("u.*")


def read_score_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCORE_CACHE).option("mergeSchema", "true").parquet(path)


def put_scores(scores: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache rows to append: never ambiguous or failed ones, none that the cache has, newest per key."""
    fresh = scores.where("not coalesce(ambiguous, false) and not coalesce(failed, false)")
    newest = fresh.groupBy("cache_key").agg(F.max_by(F.struct(*[c for c in fresh.columns if c != "cache_key"]), "created_at").alias("r")).select("cache_key", "r.*")
    return newest.join(cache.select("cache_key"), "cache_key", "left_anti")


def open_score_cache(spark: SparkSession, path: str) -> DataFrame:
    """The score cache at a path, made empty if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        spark.createDataFrame([], schemas.SCORE_CACHE).write.parquet(path)
    return read_score_cache(spark, path)


def store_scores(scores: DataFrame, path: str) -> None:
    """Append to the cache at a path what put_scores lets in."""
    cache = open_score_cache(scores.sparkSession, path)
    new = put_scores(scores, cache)
    new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in cache.schema]).write.mode("append").parquet(path)
