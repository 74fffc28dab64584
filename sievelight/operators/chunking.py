"""Files into line-addressed chunks."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.session import cut

NEWLINE = "\r\n|\r|\n"


def lines_of(body: Column) -> Column:
    """The lines of a text, without an empty last one.  Ends of lines are made alike first, as a split by one sign needs no pattern, and
    the split is worked out once."""
    one = F.replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return T.held(F.split(one, "\n"), lambda x: F.when(F.get(x, F.size(x) - 1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def _numbered(lines: Column, first: Column) -> Column:
    return F.array_join(F.transform(lines, lambda line, i: F.concat((first + i).cast("string"), F.lit(": "), line)), "\n")


def windows(files: DataFrame, size: int = 120, overlap: int = 30) -> DataFrame:
    """Sliding line windows, stopping with the one that reaches the end; empty files give none.

    files: file_idx, file_path, body.  chunk ids are file:start-end."""
    step = size - overlap
    base = files.select("file_idx", "file_path", lines_of(F.col("body")).alias("lines")).withColumn("n", F.size("lines"))
    # no start for an empty file: a filter would go below the split and work it out again
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n") - size) / F.lit(step))).cast("int") * step, F.lit(step)))
    cut = base.select("file_idx", "file_path", "lines", "n", F.explode(starts).alias("s"))
    part = F.slice("lines", F.col("s") + 1, F.lit(size))
    end = F.least(F.col("n"), F.col("s") + size)
    before = F.aggregate(F.slice("lines", F.lit(1), F.col("s")), F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x) + 1)
    own = F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x) + 1)
    content = _numbered(part, F.col("s") + 1)
    return cut.select(
        "file_idx",
        F.concat("file_path", F.lit(":"), (F.col("s") + 1).cast("string"), F.lit("-"), end.cast("string")).alias("id"),
        "file_path",
        (F.col("s") + 1).alias("start_line"),
        end.alias("end_line"),
        before.alias("start_byte"),
        (before + own - 1).alias("end_byte"),
        F.lit(None).cast("string").alias("symbol"),
        content.alias("content"),
    ).withColumns({"token_est": T.token_estimate(F.col("content")), "content_hash": F.sha2("content", 256), "is_test": T.is_test_substring(F.col("file_path"))})


def slices(files: DataFrame, size: int = 100, overlap: int = 20) -> DataFrame:
    """Windows that keep a trailing empty line (an empty file is one slice), with the first declared
    symbol of the slice, else the file's name."""
    step = size - overlap
    declares = r"^(?:export\s+|public\s+|static\s+|async\s+)*(?:class|interface|struct|function|def|fn|func|type)\s+([A-Za-z0-9_]+)"
    base = files.select("file_idx", "file_path", F.split("body", "\n").alias("lines")).withColumn("n", F.size("lines"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n") - size) / F.lit(step))).cast("int") * step, F.lit(step))
    cut = base.select("file_idx", "file_path", "lines", "n", F.explode(starts).alias("s")).withColumn("part", F.slice("lines", F.col("s") + 1, F.lit(size)))
    found = F.filter(F.transform("part", lambda line: F.regexp_extract(line, declares, 1)), lambda x: x != "")
    cut = cut.withColumns({"declared": F.get(found, F.lit(0)), "end_line": F.least(F.col("n"), F.col("s") + size)})
    return cut.select(
        "file_idx",
        F.concat("file_path", F.lit(":"), (F.col("s") + 1).cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.coalesce(F.concat(F.lit(":"), "declared"), F.lit(""))).alias("id"),
        "file_path",
        (F.col("s") + 1).alias("start_line"),
        "end_line",
        F.coalesce("declared", F.regexp_extract("file_path", "[^/]*$", 0)).alias("symbol"),
        _numbered(F.col("part"), F.col("s") + 1).alias("content"),
    ).withColumn("token_est", F.ceil(F.length("content") / 4).cast("int"))


def with_index(chunks: DataFrame) -> DataFrame:
    """A surrogate chunk_idx for tie-breaks, following (file_idx, start_line) without a global sort:
    the file's index and the line in one number."""
    return chunks.withColumn("chunk_idx", F.shiftleft(F.col("file_idx").cast("bigint"), 32) + F.col("start_line"))


def number_rows(rows: DataFrame, key: str, name: str, by: tuple[str, ...] = (), buckets: int = 4096) -> DataFrame:
    """rows with consecutive numbers from 0 (in each group of `by`) by (bucket of a hash of the key, key), without a task that
    sorts a whole group: rows are numbered within their bucket, and a bucket's first number is the sum of the sizes before it."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
    dealt = rows.withColumn("__bucket", bucket)
    own = dealt.withColumn("__own", F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(key)))
    sizes = dealt.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    # at most one row per bucket and group, so this window is short at any size
    first = sizes.withColumn("__first", F.sum("__size").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    return own.join(first.drop("__size"), [*by, "__bucket"]).withColumn(name, F.col("__first") + F.col("__own") - 1).drop("__bucket", "__own", "__first")


def number_in_order(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with consecutive numbers from 0 in the order of a key, as number_rows: rows are dealt by ranges of the key and kept
    so, numbered within a range, and a range's first number is the sum of the sizes before it."""
    dealt = cut(rows.repartitionByRange(F.col(key)).withColumn("__range", F.spark_partition_id()))
    own = dealt.withColumn("__own", F.row_number().over(Window.partitionBy("__range").orderBy(key)))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    first = sizes.withColumn("__first", F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    return own.join(F.broadcast(first.select("__range", "__first")), "__range").withColumn(name, F.col("__first") + F.col("__own") - 1).drop("__range", "__own", "__first")


_DEFINES = re.compile(r"^\s*(?:(?:export|default|public|private|protected|static|async|abstract|pub|final|inline|virtual|unsafe)\s+)*(?:function\*?|class|interface|struct|enum|trait|impl|fn|func|def|type|namespace|module)\s+([A-Za-z_$][\w$]*)")


def _spans(path: str, source: str, lines: list[str]) -> list[tuple[int, int, str]]:
    """(first line, last line, symbol) of root-level definitions.

    Python files go through the standard parser; other files, and those it rejects, by declaration
    lines and brace depth, which is approximate."""
    if path.endswith(".py"):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return []
        kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
        return [(min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.end_lineno, n.name) for n in tree.body if isinstance(n, kinds)]
    out, i = [], 0
    while i < len(lines):
        m = _DEFINES.match(lines[i])
        if not m or lines[i][:1].isspace():
            i += 1
            continue
        depth, opened, j = 0, False, i
        while j < len(lines):
            depth += lines[j].count("{") - lines[j].count("}")
            opened |= "{" in lines[j]
            if opened and depth <= 0 or not opened and j - i >= 3:
                break
            j += 1
        j = min(j, len(lines) - 1) if opened else i
        out.append((i + 1, j + 1, m[1]))
        i = j + 1
    return out


def syntax_chunks(files: DataFrame, long_span: int = 180, part_step: int = 100, part_length: int = 121) -> DataFrame:
    """One chunk per root-level definition; spans over long_span lines are cut into parts; blocks of
    three lines or more outside definitions are `module_scope` (a trailing block needs four).

    Files without a definition fall back to windows()."""

    def cut(frames):
        for pdf in frames:
            rows = []
            for idx, path, body in zip(pdf["file_idx"], pdf["file_path"], pdf["body"]):
                lines = re.split(NEWLINE, body or "")
                if lines and lines[-1] == "":
                    lines.pop()
                spans, at = [], 1
                found = _spans(path or "", body or "", lines)
                for s, e, name in found:
                    if s - at >= 3:
                        spans.append((at, s - 1, "module_scope"))
                    if e - s + 1 > long_span:
                        p = s
                        while True:
                            stop = min(e, p + part_length - 1)
                            spans.append((p, stop, f"{name} (part {p}-{stop})"))
                            if stop >= e:
                                break
                            p += part_step
                    else:
                        spans.append((s, e, name))
                    at = max(at, e + 1)
                if found and len(lines) - at >= 3:
                    spans.append((at, len(lines), "module_scope"))
                for s, e, name in spans:
                    own = lines[s - 1 : e]
                    if name == "module_scope" and all(not x.strip() or x.strip()[:1] == "#" or x.strip()[:2] == "//" for x in own):
                        continue
                    rows.append((idx, f"{path}:{s}-{e}:{name}", path, s, e, name, "\n".join(f"{s + k}: {x}" for k, x in enumerate(own))))
            yield pd.DataFrame(rows, columns=["file_idx", "id", "file_path", "start_line", "end_line", "symbol", "content"])

    schema = "file_idx bigint, id string, file_path string, start_line int, end_line int, symbol string, content string"
    parsed = files.select("file_idx", "file_path", "body").mapInPandas(cut, schema)
    plain = files.join(parsed.select("file_idx").distinct(), "file_idx", "left_anti")
    both = parsed.unionByName(windows(plain).select(*[c.split()[0] for c in schema.split(", ")]))
    return both.withColumns({"token_est": T.token_estimate(F.col("content")), "content_hash": F.sha2("content", 256), "is_test": T.is_test_substring(F.col("file_path"))})


def uncovered_blocks(lines: DataFrame, spans: DataFrame, least: int = 3) -> DataFrame:
    """(file_path, start_line, end_line): runs of lines (file_path, line_no) that no span covers."""
    free = lines.join(spans, (lines.file_path == spans.file_path) & lines.line_no.between(spans.start_line, spans.end_line), "left_anti")
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("file_path").orderBy("line_no"))
    return free.withColumn("island", island).groupBy("file_path", "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("file_path", "start_line", "end_line")
