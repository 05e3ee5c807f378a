"""Sources: samples from JSON, TSV, CSV and Parquet in one layout."""

from __future__ import annotations

import ast
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators.convert import options_of
from ..plans.protocol import provenance
from ..schema import blank


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """(eval_id, sample): the elements of JSON arrays, one file each, as variants, with their positions.

    A file is one value of one task, as JSON arrays can't be cut; larger sets belong into JSON lines (read_json_lines) or Parquet.
    """
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    found = raw.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return found.select(F.col("pos").cast("long").alias("eval_id"), F.col("value").alias("sample"))


def read_local(spark: SparkSession, path: str) -> DataFrame:
    """read_json_array() of samples that must not have an eval-id yet; one that has raises when it is read."""
    rows, own = read_json_array(spark, path), F.try_variant_get("sample", "$.eval-id", "string")
    return rows.withColumn("eval_id", F.when(own.isNotNull(), F.raise_error(F.lit("a sample has an eval-id already")).cast("long")).otherwise(F.col("eval_id")))


def numbered(rows: DataFrame, name: str = "eval_id") -> DataFrame:
    """Rows of a file scan with 0-based numbers in file order, files by path. For sources that read a file in one task."""
    at = rows.select("*", F.col("_metadata.file_path").alias("__f"), F.monotonically_increasing_id().alias("__m"))
    files = at.groupBy("__f").agg(F.min("__m").alias("__first"), F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return at.join(F.broadcast(files), "__f").withColumn(name, F.col("__m") - F.col("__first") + F.col("__before")).drop("__f", "__m", "__first", "__n", "__before")  # one row a file


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(eval_id, sample): one JSON value a line, as variants; eval_id is the sample's own eval-id, else null. Files are read in pieces."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.parse_json("value").alias("sample"))
    return rows.select(F.try_variant_get("sample", "$.eval-id", "long").alias("eval_id"), "sample")


def text_or_list(sample, path: str):
    """(array<string>, is_list) of a value that is a text or a list of texts; null stays null."""
    v = F.try_variant_get(sample, path, "variant")
    listed = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    one = F.try_variant_get(sample, path, "string")
    return F.when(listed, F.try_variant_get(sample, path, "array<string>")).when(one.isNotNull(), F.array(one)), listed


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Scoring input of result files: eval_id, id, answer and response as lists, question, options, choices, question_type, prompt."""
    rows = read_json_array(spark, path)
    s = F.col("sample")
    answer, is_list = text_or_list(s, "$.answer")
    msgs = F.try_variant_get(s, "$.messages", "array<variant>")
    first, last = F.try_element_at(msgs, F.lit(1)), F.try_element_at(msgs, F.lit(-1))
    response, _ = text_or_list(last, "$.response")
    reference, _ = text_or_list(s, "$.reference_response")
    options = F.try_variant_get(first, "$.options", "map<string,string>")
    pairs = F.array_sort(F.transform(F.map_entries(options), lambda e: F.struct(e["key"].alias("letter"), e["value"].alias("text"))))
    own = F.try_variant_get(s, "$.eval-id", "long")
    return rows.select(
        F.coalesce(own, "eval_id").alias("eval_id"), F.try_variant_get(s, "$.id", "string").alias("id"), answer.alias("answer"), is_list.alias("gt_is_list"), reference.alias("reference_response"), response.alias("pred"),
        F.try_variant_get(first, "$.question", "string").alias("question"), pairs.alias("options"), F.try_variant_get(first, "$.choices", "array<string>").alias("choices"),
        T.flat_letter_options((k, F.try_variant_get(first, f"$.{k}", "string")) for k in "ABCDEFGH").alias("flat_options"), F.try_variant_get(first, "$.prompt", "string").alias("prompt"), F.try_variant_get(s, "$.question_type", "string").alias("question_type"), F.to_json(F.try_variant_get(s, "$.dataset_meta", "variant")).alias("dataset_meta"),
    ).withColumn("gt", F.when(blank(F.col("answer"), F.col("gt_is_list")), F.col("reference_response")).otherwise(F.col("answer"))).withColumn("gt_is_list", F.col("gt_is_list") & ~blank(F.col("answer"), F.col("gt_is_list")))


def read_tsv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A tab-separated benchmark with known columns, all text; options from letter columns, media from image_url before image. eval_id
    is the column eval-id, or the row's number over all files; hint is empty where there is none."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = numbered(spark.read.csv(path, sep="\t", header=True, multiLine=True, quote='"', escape='"', schema=schema), "__row")
    if "hint" not in columns:
        rows = rows.withColumn("hint", F.lit(""))
    letters = {c: F.col(c) for c in columns if len(c) == 1 and c in T.ALPHABET}
    null = F.lit(None).cast("string")
    out = rows.withColumn("options", options_of(letters) if letters else F.array().cast("array<struct<letter:string,text:string>>"))
    out = out.withColumn("choices", F.transform("options", lambda o: o["letter"]))
    out = out.withColumn("media", T.media_paths(F.col("image_url") if "image_url" in columns else null, F.col("image") if "image" in columns else null))
    own = F.col("eval-id").cast("long") if "eval-id" in columns else F.lit(None).cast("long")
    return out.withColumn("eval_id", F.coalesce(own, "__row")).withColumn("hint", F.coalesce("hint", F.lit(""))).drop("image", "image_url", "__row", "eval-id", *letters)


def read_arrow_subset(spark: SparkSession, root: str, subset: str, split: str) -> DataFrame:
    """Parquet below root/subset/split, else root/default/split; messages decoded, media a list."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{subset}/{split}")
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    rows = spark.read.parquet(f"{root}/{subset if found else 'default'}/{split}")
    if dict(rows.dtypes).get("messages") == "string":
        rows = rows.withColumn("messages", F.from_json("messages", "array<struct<role:string,question:string,answer:string,options:map<string,string>,choices:array<string>,hint:string,prompt:string,response:string>>"))
    if "media" not in rows.columns:
        return rows.withColumn("media", F.array().cast("array<string>"))
    media = F.col("media")
    return rows.withColumn("media", F.coalesce(media if dict(rows.dtypes)["media"].startswith("array") else F.when(media.isNotNull(), F.array(media)), F.array().cast("array<string>")))


def choose_subset(manifest: Mapping, wanted: str | None = None) -> str:
    """The named subset, or the only one."""
    names = list(manifest["subsets"])
    if wanted is None and len(names) != 1:
        raise ValueError(f"name one of the subsets {names}")
    if wanted is not None and wanted not in names:
        raise ValueError(f"no subset {wanted}; there are {names}")
    return wanted or names[0]


def tagged_union(parts: Mapping[str, DataFrame], tag: str = "sub_dataset") -> DataFrame:
    """All parts in order, with their names; missing columns are null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def multipart(spark: SparkSession, pattern: str, first: int, last: int, reader) -> DataFrame:
    """Parts first..last of a path pattern, with their number as `part`."""
    return tagged_union({str(i): reader(spark, pattern.format(i)) for i in range(first, last + 1)}, "part")


def read_literal_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object or Python literal a line (None, True, tuples and single quotes too); lines that are neither give nulls."""

    @F.pandas_udf("string")
    def as_json(lines: pd.Series) -> pd.Series:
        def one(line: str | None) -> str | None:
            try:
                return json.dumps(ast.literal_eval(line.strip()))
            except (ValueError, SyntaxError, AttributeError, TypeError, MemoryError, RecursionError):
                return None

        return lines.map(one)

    strict = F.when(F.try_parse_json("value").isNotNull(), F.col("value"))  # only other lines are read as literals
    lines = spark.read.text(path).select("value", strict.alias("j")).withColumn("p", as_json(F.when(F.col("j").isNull(), F.col("value"))))
    return lines.select(F.from_json(F.coalesce("j", "p"), schema).alias("r")).select("r.*")


def fetch(spark: SparkSession, source: str, target: str) -> bool:
    """A local or shared copy of a file, made only if there is none: written beside its place and renamed, so that no reader sees half
    of it. Whether a copy was made."""
    paths = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    old, new, part = paths.Path(source), paths.Path(target), paths.Path(f"{target}.{uuid.uuid4().hex}.part")
    there = new.getFileSystem(conf)
    if there.exists(new):
        return False
    paths.FileUtil.copy(old.getFileSystem(conf), old, there, part, False, conf)
    if not there.rename(part, new):
        there.delete(part, False)
        raise OSError(f"{target} could not be written")
    return True


def named_benchmark(name: str, listed: Sequence[str], folder: str) -> str:
    """The path of a listed benchmark's TSV below `folder`; a name that is not on the list is refused."""
    if name not in set(listed):
        raise ValueError(f"no benchmark {name!r}; there are {sorted(set(listed))}")
    return f"{folder.rstrip('/')}/{name}.tsv"


def per_subject(subjects: Sequence[str], load: Callable[[str], DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """All subjects' rows with `subject` and its place as `subject_no`, missing columns null; and the errors of those that could not be
    loaded, which give no rows."""
    parts, errors = None, {}
    for i, name in enumerate(subjects):
        try:
            one = load(name).withColumn("subject", F.lit(name)).withColumn("subject_no", F.lit(i))
        except Exception as e:
            errors[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            continue
        parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
    return parts, errors


def splits_of(spark: SparkSession, root: str, subset: str = "default") -> list[str]:
    """The names of the splits below root/subset, else below root/default, else below root."""
    conf = spark._jsc.hadoopConfiguration()
    for folder in (f"{root}/{subset}", f"{root}/default", root):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            return sorted(f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory() and not f.getPath().getName().startswith(("_", ".")))
    raise FileNotFoundError(root)


def discover(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """Paths and sizes of files below root, by name."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length").orderBy("path")


def inspect(df: DataFrame, n: int = 5) -> list[tuple[str, str, list[str], list]]:
    """Name, type, types of the first values (of what a text holds as JSON, too) and those values, of each column."""
    rows = df.limit(n)
    kinds = {c: F.when(F.col(c).isNotNull(), F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(c))) if t == "string" else F.lit(t), F.lit(t))) for c, t in df.dtypes}
    seen = rows.select("*", *(k.alias(f"__kind_{c}") for c, k in kinds.items())).collect()
    return [(c, t, sorted({r[f"__kind_{c}"] for r in seen} - {None}), [r[c] for r in seen]) for c, t in df.dtypes]


def open_source(spark: SparkSession, spec: str, **options) -> DataFrame:
    """A path that ends in .tsv (with `columns`), looked at first; else kind@path: local@x.json, table@folder (Parquet), csv@x.csv,
    lines@x.jsonl (JSON), literals@x.txt (with `schema`), named@NAME (with `listed`, `folder` and `columns`), or artifact@folder
    (Parquet by subset and split, with `manifest` or `subset`, and `split`)."""
    if spec.endswith(".tsv"):
        return read_tsv(spark, spec, **options)
    kind, at, path = spec.partition("@")

    def named(s, name, listed, folder, columns):
        return read_tsv(s, named_benchmark(name, listed, folder), columns)

    def artifact(s, root, split, subset=None, manifest=None):
        return read_arrow_subset(s, root, choose_subset(manifest, subset) if manifest else subset or "default", split)

    readers = {
        "local": read_local, "table": lambda s, p: s.read.parquet(p), "csv": lambda s, p: s.read.csv(p, header=True, multiLine=True, escape='"'), "lines": read_json_lines, "literals": read_literal_lines, "named": named, "artifact": artifact,
    }
    if not at or kind not in readers:
        raise ValueError(f"unknown source {spec!r}")
    return readers[kind](spark, path, **options)


def write_json_array(rows: DataFrame, path: str, key: str, as_text: bool = False) -> None:
    """One JSON array in one file at `path`, sorted by key, as text if asked for. Rows are sorted by many tasks; the one file is put
    together from their parts in order by streaming, as one file asks for; null values are left out of objects."""
    order = F.col(key).cast("string") if as_text else F.col(key)
    spark, folder = rows.sparkSession, f"{path}.{uuid.uuid4().hex}.parts"
    sorted_rows = rows.withColumn("__k", order).repartitionByRange("__k").sortWithinPartitions("__k").drop("__k")
    sorted_rows.select(F.concat(F.lit(","), F.to_json(F.struct(*rows.columns))).alias("value")).write.text(folder)
    fs_of, jvm = spark._jvm.org.apache.hadoop.fs, spark._jvm
    parts, target, part = fs_of.Path(folder), fs_of.Path(path), fs_of.Path(f"{folder}.one")
    fs = parts.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-") and f.getLen())
    out = fs.create(part)
    out.write(bytearray(b"["))
    for i, name in enumerate(names):
        lines = fs.open(fs_of.Path(folder, name))
        lines.seek(0 if i else 1)  # no comma before the first
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(lines, out, 1 << 20, False)
        lines.close()
    out.write(bytearray(b"]\n"))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(parts, True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file, written beside its place and renamed over what is there."""
    fs_of = spark._jvm.org.apache.hadoop.fs
    target, part = fs_of.Path(path), fs_of.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def write_manifest(spark: SparkSession, manifest: Mapping, path: str) -> None:
    """A manifest as JSON with its keys in order of writing."""
    write_text(spark, json.dumps(manifest, indent=2, ensure_ascii=False) + "\n", path)


def write_batches(rows: DataFrame, path: str, batch: str = "batch") -> DataFrame:
    """Rows of batches that `path` does not hold yet are written there, one folder a batch; all that it then holds. A batch counts as
    held once its folder is there, which the committer puts in place as a whole."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    held = [f.getPath().getName().partition("=")[2] for f in fs.listStatus(folder) if f.isDirectory() and "=" in f.getPath().getName()] if fs.exists(folder) else []
    done = spark.createDataFrame([(int(b),) for b in held], "__b long")
    rows.join(F.broadcast(done), F.col(batch) == F.col("__b"), "left_anti").repartition(batch).write.mode("append").partitionBy(batch).parquet(path)
    return spark.read.parquet(path)


def write_results(rows: DataFrame, path: str, key: str = "eval_id") -> None:
    """Sorted JSON lines; files follow each other in key order."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def write_scores(rows: DataFrame, summary: DataFrame, config: Mapping, path: str) -> None:
    """samples and summary as Parquet, config with the provenance as a one-line text, all below path."""
    rows.write.mode("overwrite").parquet(f"{path}/samples")
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    rows.sparkSession.createDataFrame([(json.dumps({**config, "provenance": provenance()}, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def write_artifact(rows: DataFrame, path: str, split: str = "split", key: str = "id") -> None:
    """Parquet by split, sorted by id as text."""
    rows.repartitionByRange(split, key).sortWithinPartitions(split, key).write.mode("overwrite").partitionBy(split).parquet(path)
