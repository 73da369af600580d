"""Scans: FASTA, delimited, JSON and file inventories, all through Spark's readers."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.functions import text as t
from glyphstream.operators.panels import keep_first, require_columns

FASTA = ("fa", "fasta", "fna", "ffn")
TABLES = ("csv", "tsv", "txt", "parquet")
#: Delimiters that a header line is searched for, and names of columns that an inventory lists at most.
DELIMITERS, NAMES = [",", "\t", ";", "|"], 80


def _records(rows: DataFrame) -> DataFrame:
    """Records of text split at '>' : header line, then body."""
    head = F.substring_index(F.regexp_replace("value", "\r", ""), "\n", 1)
    body = F.regexp_replace(F.substr(F.regexp_replace("value", "\r", ""), F.length(head) + 2), "\\s+", "")
    return rows.where(F.trim("value") != "").select(F.substring_index(F.trim(head), " ", 1).alias("seq_id"), F.trim(head).alias("description"), body.alias("sequence"), "source_file")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(seq_id, description, sequence, source_file); files are split at records, gzip by suffix, folders searched."""
    globs = f"*.{{{','.join([*FASTA, *(f'{x}.gz' for x in FASTA)])}}}"
    paths = [path] if isinstance(path, str) else path
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", ">")
    if not all(p.rsplit("/", 1)[-1].removesuffix(".gz").endswith(FASTA) for p in paths):
        reader = reader.option("pathGlobFilter", globs)
    return _records(reader.text(paths).select("value", F.col("_metadata.file_name").alias("source_file")))


def parse_entries(df: DataFrame, text_col: str) -> DataFrame:
    """Entries of FASTA texts with ``entity|chains|name|organism`` headers; other headers come whole as the name; letters only."""
    each = df.select(F.explode(F.split(F.col(text_col), "(?m)^>")).alias("value")).where(F.trim("value") != "")
    head = F.trim(F.substring_index("value", "\n", 1))
    fields = F.split(head, "\\|")
    full = F.size(fields) == 4
    pick = lambda i: F.when(full, F.trim(F.get(fields, F.lit(i))))
    body = F.upper(F.regexp_replace(F.substr("value", F.length(F.substring_index("value", "\n", 1)) + 1), "[^A-Za-z]", ""))
    return each.select(pick(0).alias("entity"), pick(1).alias("chains"), F.coalesce(pick(2), head).alias("name"), pick(3).alias("organism"), body.alias("sequence"))


def suffix_of(path: Column) -> Column:
    """The suffix that tells the kind, looking through .gz."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, "(?i)\\.gz$", ""), "\\.([A-Za-z0-9]+)$", 1))


def kind_of(path: Column) -> Column:
    s = suffix_of(path)
    return F.when(s.isin(*FASTA), "sequence").when(s.isin(*TABLES), "table").when(s.isin("json", "jsonl"), "json").otherwise("other")


def _listed(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Paths of all files below folders, empty ones included, sorted; the names that Spark's own index holds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return sorted(re.sub("^file:/+", "file:/", unquote(f)) for f in files.inputFiles())


def _named(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string")


def _literal(paths: list[str]) -> list[str]:
    """Paths whose brackets and stars aren't patterns."""
    return [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]


def _file() -> Column:
    """The path of the file that a row is read from."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, kind, size) of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    rows = _named(spark, _listed(spark, path)).join(files, "path", "left")  # empty files have no row
    return rows.select("path", suffix_of(F.col("path")).alias("suffix"), kind_of(F.col("path")).alias("kind"), F.coalesce("length", F.lit(0)).alias("size"))


def inspect_fasta(spark: SparkSession, path: str, most: int = 5000) -> DataFrame:
    """Records, shortest and longest among the first ``most``."""
    rows = read_fasta(spark, path).limit(most)
    return rows.agg(F.count("*").alias("n_records"), F.min(F.length("sequence")).alias("shortest"), F.max(F.length("sequence")).alias("longest"))


def read_table(spark: SparkSession, path: str, schema: str | None = None, needed: set[str] = frozenset()) -> DataFrame:
    """Parquet, or delimited text by suffix (tab for .tsv and .txt); blanks are null, the text NA stays."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", "true").option("sep", "\t" if path.removesuffix(".gz").endswith((".tsv", ".txt")) else ",")
        df = (reader.schema(schema) if schema else reader).csv(path)
    require_columns(df, set(needed), path)
    return df


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one of the schema where there is no such path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return read_table(spark, path, schema)
    return spark.createDataFrame([], schema)


def read_paired(spark: SparkSession, path: str | list[str], field: str, schema: str) -> DataFrame:
    """Records of a nested JSON array, one row each, with ``source_file``; an error if there are none."""
    files = spark.read.option("multiLine", "true").schema(f"{field} array<struct<{schema}>>").json(path)
    rows = files.select(F.inline(F.col(field)), F.col("_metadata.file_name").alias("source_file"))
    if not rows.limit(1).count():
        raise ValueError(f"no records of {field} in {path}")
    return rows


def read_once(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key by all columns, so that repeats don't multiply joins."""
    return keep_first(df, [key], [F.col(c) for c in df.columns])


def _paths(spark: SparkSession, glob: str) -> list[str]:
    """Paths that a glob matches, sorted; in any file system that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(str(f.getPath()) for f in found or [])


def _heads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, head) of every text file: its first line, null for an empty file."""
    lines = spark.read.text(_literal(paths)).where("_metadata.file_block_start = 0").select(_file().alias("path"), "value", F.monotonically_increasing_id().alias("place"))
    return _named(spark, paths).join(lines.groupBy("path").agg(F.min_by("value", "place").alias("head")), "path", "left")


def _inspected(rows: DataFrame, n: Column, columns: Column, notes: Column) -> DataFrame:
    return rows.select("path", n.cast("long").alias("n_records"), columns.cast("string").alias("columns"), notes.alias("notes"))


def inspect_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, n_records, columns, notes) of FASTA files, all of their records; a file without records has 0."""
    rows = _records(spark.read.option("lineSep", ">").text(_literal(paths)).select("value", _file().alias("source_file")))
    n = rows.groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("n"), F.min(F.length("sequence")).alias("low"), F.max(F.length("sequence")).alias("high"))
    notes = F.when(F.col("n").isNotNull(), F.format_string("min_len=%d;max_len=%d", "low", "high")).otherwise("")
    return _inspected(_named(spark, paths).join(n, "path", "left"), F.coalesce("n", F.lit(0)), F.lit(None), notes)


def inspect_delimited(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, n_records, columns, notes) of delimited texts: names by the most frequent delimiter of the first line, else
    the one that the suffix tells; records aren't counted. An empty file has no names."""
    each = lambda i, d: F.struct((F.length("head") - F.length(F.replace("head", F.lit(d)))).alias("n"), F.lit(-i).alias("place"), F.lit(d).alias("d"))
    best = F.array_max(F.array(*(each(i, d) for i, d in enumerate(DELIMITERS))))
    usual = F.when(suffix_of(F.col("path")).isin("tsv", "txt"), "\t").otherwise(",")
    rows = _heads(spark, paths).withColumn("sep", F.when(best["n"] > 0, best["d"]).otherwise(usual))
    names = F.transform(F.split("head", F.concat(F.lit("\\Q"), "sep", F.lit("\\E"))), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    label = F.when(F.col("sep") == "\t", "\\t").otherwise(F.col("sep"))
    notes = F.when(F.col("head").isNull(), "empty table").otherwise(F.concat(F.lit("sep="), label))
    return _inspected(rows, F.lit(None), F.array_join(F.slice(names, 1, NAMES), ","), notes)


def inspect_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, n_records, columns, notes) of JSON texts by their first line: an object's keys, another value's type."""
    rows = _heads(spark, paths)
    kind = F.lower(F.substring_index(F.schema_of_variant(F.try_parse_json("head")), "<", 1))
    empty = F.coalesce(F.trim("head") == "", F.lit(True))
    notes = F.when(empty, "empty json").when(kind == "object", "keys of the first line").when(kind.isNotNull(), F.concat(F.lit("first line: "), kind)).otherwise("first line is no json")
    return _inspected(rows, F.when(empty, 0), F.array_join(F.slice(F.json_object_keys("head"), 1, NAMES), ","), notes)


def inspect_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, n_records, columns, notes) of Parquet files, from their footers. The parts of a folder share its schema;
    other files are asked for their names one by one."""
    n = spark.read.parquet(*_literal(paths)).groupBy(_file().alias("path")).agg(F.count("*").alias("n"))
    group = lambda p: p.rsplit("/", 1)[0] if p.rsplit("/", 1)[1].startswith("part-") else p
    names = {k: ",".join(spark.read.parquet(*_literal([p])).columns[:NAMES]) for k, p in {group(p): p for p in reversed(paths)}.items()}
    listed = spark.createDataFrame([(p, names[group(p)]) for p in paths], "path string, names string")
    return _inspected(listed.join(n, "path", "left"), F.coalesce("n", F.lit(0)), F.col("names"), F.lit("parquet"))


def inspected_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, kind, size, n_records, columns, notes) of every file below a folder, by one job for each kind."""
    files = inventory(spark, path)
    found: dict[tuple[str, bool], list[str]] = {}
    for r in files.select("path", "kind", (F.col("suffix") == "parquet").alias("binary")).sort("path").toLocalIterator():
        found.setdefault((r.kind, bool(r.binary)), []).append(r.path)
    how = {("sequence", False): inspect_sequences, ("table", False): inspect_delimited, ("table", True): inspect_parquet, ("json", False): inspect_json}
    parts = [_inspected(files.limit(0), F.lit(None), F.lit(None), F.lit("")), *(how[k](spark, paths) for k, paths in found.items() if k in how)]
    return files.join(reduce(DataFrame.unionByName, parts), "path", "left")


def kinds(spark: SparkSession, path: str) -> DataFrame:
    """Files of each kind below a folder."""
    return inventory(spark, path).groupBy("kind").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class SourceSet:
    """Where the inputs are: folders of records, two metadata tables, paired records, and the folder searched for what isn't named."""

    parent: str
    roots: tuple[str, ...] = ()
    rich: str | None = None
    dedup: str | None = None
    paired: tuple[str, ...] = ()


def source_set(config: Mapping, base: str) -> SourceSet:
    """The sources that a configuration names; relative paths start at its project root, which starts at ``base``."""

    def at(path: str, root: str) -> str:
        return path if path.startswith("/") or "://" in path else f"{root.rstrip('/')}/{path}"

    root = at(config.get("project_root", "."), base)
    tables = config.get("metadata_paths") or {}
    one = lambda k: at(tables[k], root) if tables.get(k) else None
    many = lambda k: tuple(at(p, root) for p in config.get(k) or [])
    return SourceSet(at(config.get("parent_repo_root", ".."), root), many("local_data_roots"), one("rich_metadata"), one("dedup_metadata"), many("paired_dataset_paths"))


def detect(spark: SparkSession, sources: SourceSet, paired: str, rich: str, dedup: str) -> dict[str, list[str] | str | None]:
    """What there is of a source set: record files below its roots, and by globs below its parent what it doesn't
    name; of tables the first match by name. A root that isn't there is left out."""
    roots = [p for r in sources.roots for p in _paths(spark, r)]
    records: list[str] = []
    if roots:
        named = _named(spark, _listed(spark, _literal(roots)))
        records = sorted(r.path for r in named.where(kind_of(F.col("path")) == "sequence").toLocalIterator())
    first = lambda named, glob: named or next(iter(_paths(spark, f"{sources.parent}/{glob}")), None)
    return {"records": records, "paired": list(sources.paired) or _paths(spark, f"{sources.parent}/{paired}"), "rich": first(sources.rich, rich), "dedup": first(sources.dedup, dedup)}


def _first_of_file(rows: DataFrame, key: str, columns: list[Column]) -> DataFrame:
    """The columns of each key's first row in the order of the file, wherever its splits are read."""
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return keep_first(rows.select(*columns, at.alias("__at")), [key], [F.col("__at")]).drop("__at")


def read_rich(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of isolates, one row each: subtype, host, place, date, year and clade, normalised; a missing host isn't human."""
    rows = read_table(spark, path, needed={"Isolate_Id", "Subtype", "Host", "Location", "Collection_Date", "Clade"})
    parts, host = t.location_parts(F.col("Location")), F.lower(F.trim("Host"))
    return _first_of_file(rows, "epi_isl", [
        F.col("Isolate_Id").alias("epi_isl"), t.subtype(F.col("Subtype")).alias("metadata_subtype"), F.col("Host").alias("host"), host.alias("host_normalized"),
        F.col("Location").alias("location_raw"), F.get(parts, F.lit(0)).alias("region"), F.get(parts, F.lit(1)).alias("country"),
        F.col("Collection_Date").alias("metadata_collection_date"), t.leading_year(F.col("Collection_Date")).alias("metadata_year"),
        F.col("Clade").alias("clade_raw_rich"), t.major_clade(F.col("Clade")).alias("major_clade_rich"), F.coalesce(host == "human", F.lit(False)).alias("host_is_human"),
    ])


def read_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of deduplicated isolates, one row each, its columns renamed, the subtype normalised; other columns stay."""
    rows = read_table(spark, path, needed={"epi_isl", "subtype", "year", "month", "matched", "clade", "major_clade"})
    names = {"subtype": "dedup_subtype", "year": "dedup_year", "month": "dedup_month", "matched": "dedup_matched", "clade_raw": "clade_raw_dedup", "clade": "clade_dedup", "major_clade": "major_clade_dedup"}
    value = lambda c: t.subtype(F.col(c)) if c == "subtype" else F.col(c)
    return _first_of_file(rows, "epi_isl", [value(c).alias(names.get(c, c)) for c in rows.columns])


def read_metrics(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored metric tables of all panels by kind, their columns merged by name; an error if a kind has none."""
    found = {kind: _paths(spark, f"{folder}/*_{kind}_metrics.parquet") for kind in ("sequence", "codon")}
    if missing := [k for k, paths in found.items() if not paths]:
        raise FileNotFoundError(f"no {', '.join(missing)} metrics in {folder}")
    return {kind: spark.read.option("mergeSchema", "true").parquet(*paths) for kind, paths in found.items()}


def read_vectors(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """Stored vectors, refused unless each key is there once and all vectors have one length."""
    rows = read_table(spark, path, needed={key, vector})
    seen = rows.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.count(vector).alias("vectors"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
    if seen.n != seen.keys or seen.n != seen.vectors or seen.low != seen.high:
        raise ValueError(f"{path}: {seen.n} rows, {seen.keys} keys, {seen.vectors} vectors of {seen.low} to {seen.high} numbers")
    return rows
