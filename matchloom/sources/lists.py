"""Reading and writing records and id lists, and validation of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import written


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All strings, quoted with ", doubled inside; empty cells are empty strings."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote='"', escape='"', emptyValue="", nullValue="\u0000").fillna("")


def id_lists(pairs: DataFrame, s1s: DataFrame, score: str | None = None) -> DataFrame:
    """(s1, ids) with a row for each query: ids by descending score, then by id, without repeats or queries' own ids."""
    order = F.struct((-F.col(score) if score else F.lit(0)).alias("o"), "cand")
    lists = pairs.where(~F.col("cand").startswith("S1-")).groupBy("s1").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["cand"])).alias("l"))
    return s1s.select("s1").join(lists, "s1", "left").select("s1", F.coalesce(F.concat_ws(",", "l"), F.lit("")).alias("ids"))


def write_lists(lists: DataFrame, path: str, header: tuple[str, str]) -> None:
    lists.toDF(*header).write.csv(path, sep="\t", header=True, emptyValue="")


#: Columns of the two result files.
MATCHES, CANDIDATES = ("source1_entity_id", "matched_entity_ids"), ("source1_entity_id", "candidate_entity_ids")


def write_tsv(df: DataFrame, path: str) -> None:
    """What read_tsv() reads: all columns as strings, nulls as empty cells."""
    df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]).write.csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")


def write_results(matches: DataFrame, candidates: DataFrame, s1s: DataFrame, path: str, score: str | None = None) -> None:
    """Both result files under a path, with a row for each query. Raises if a match is not a candidate."""
    check_subset(matches, candidates)
    write_lists(id_lists(matches, s1s, score), f"{path}/matches", MATCHES)
    write_lists(id_lists(candidates, s1s, score), f"{path}/candidates", CANDIDATES)


def read_lists(lists: DataFrame) -> DataFrame:
    """(s1, cand) of (s1, ids)."""
    return lists.select("s1", F.explode(F.filter(F.transform(F.split("ids", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("cand"))


def validate(lists: DataFrame, s1s: DataFrame, pool: DataFrame) -> DataFrame:
    """(finding, n): repeated rows, repeats within a list, own ids, wrong prefixes, unknown ids, missing and extra queries."""
    lists = written(lists, "lists")  # seven findings read it
    flat = read_lists(lists)
    found = {
        "duplicate_rows": lists.groupBy("s1").count().where("count > 1"), "duplicate_ids": flat.groupBy("s1", "cand").count().where("count > 1"), "self_ids": flat.where(F.col("cand").startswith("S1-")),
        "wrong_prefix": flat.where(~F.col("cand").rlike("^S[123]-")), "unknown_ids": flat.join(pool, "cand", "left_anti"), "missing_s1": s1s.join(lists, "s1", "left_anti"), "extra_s1": lists.join(s1s, "s1", "left_anti"),
    }
    out = None
    for name, rows in found.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def validate_lines(lines: DataFrame, header: tuple[str, str] = MATCHES) -> DataFrame:
    """(finding, n) of the raw lines (file, line) of a result file: files without the header line, lines that are not two columns, quoted cells, and cells with blanks at an end. Blank lines don't count."""
    top, line = "\t".join(header), F.col("line")
    cells = F.split(line, "\t")
    rows = lines.where(F.trim(line) != "").withColumn("head", line == top)
    body = ~F.col("head")
    marks = {
        "columns": body & (F.size(cells) != 2), "quoted": body & line.contains('"'),
        "blanks": body & F.exists(cells, lambda x: x.rlike(r"^\s|\s$") | x.rlike(r"\s,|,\s")),
    }
    files = rows.groupBy("file").agg(F.max(F.col("head").cast("int")).alias("h")).agg(F.coalesce(F.sum(1 - F.col("h")), F.lit(0)).cast("long").alias("header"))
    counts = rows.agg(*[F.coalesce(F.sum(m.cast("long")), F.lit(0)).alias(k) for k, m in marks.items()])
    cell = lambda df, k: df.select(F.lit(k).alias("finding"), F.col(k).alias("n"))
    out = cell(files, "header")
    for k in marks:
        out = out.unionByName(cell(counts, k))
    return out


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of a result file or a folder of its parts."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def check_subset(matches: DataFrame, candidates: DataFrame) -> None:
    """Raise if a match is not a candidate."""
    if not matches.join(candidates, ["s1", "cand"], "left_anti").isEmpty():
        raise ValueError("some matches are not among the candidates")


def complete_pieces(pieces: DataFrame) -> DataFrame:
    """(side, country, ok) of (side, country, i, n): whether each set has pieces 0 to n - 1 of one n."""
    return pieces.groupBy("side", "country").agg(((F.count_distinct("n") == 1) & (F.count_distinct("i") == F.max("n")) & (F.min("i") == 0) & (F.max("i") == F.max("n") - 1)).alias("ok"))
