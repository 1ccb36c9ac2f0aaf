"""JSON lines with rejects, log lines, pinned inputs, gated and append-only sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, required: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of the schema and rejects ``file, line, reason`` with the text of the line; blank lines are neither.

    A line is rejected if it isn't a JSON object or lacks a required field. The text is read once and stays splittable.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*wanted.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).filter("trim(line) != ''")
    parsed = lines.withColumn("row", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"row.{c}").isNull(), F.lit(c)) for c in required])) if required else F.array().cast("array<string>")
    broken = F.col("row").isNull() | F.col("row._corrupt").isNotNull() | ~F.startswith(F.ltrim("line"), F.lit("{"))
    judged = parsed.withColumn("reason", F.when(broken, "not a JSON object").when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", "))))
    good = judged.filter("reason is null").select(*[F.col(f"row.{f.name}").alias(f.name) for f in wanted.fields])
    return good, judged.filter("reason is not null").select("file", "line", "reason")


def read_log_lines(spark: SparkSession, path: str, pattern: str, fields: dict[str, str]) -> DataFrame:
    """Fields of the lines that match a regular expression, by group in order; an optional group that is absent is null."""
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return lines.select(*[F.expr(f"try_cast(nullif(regexp_extract(value, r'{pattern}', {k}), '') as {kind})").alias(name) for k, (name, kind) in enumerate(fields.items(), 1)])


def pinned(spark: SparkSession, path: str, sha256: str) -> str:
    """The path, if the file's content has this hash; otherwise an error. The file is hashed where it is read."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).collect()
    if [r[0] for r in found] != [sha256]:
        raise ValueError(f"{path} isn't the pinned input")
    return path


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    where, system = _hadoop(spark, path)
    system.delete(where, True)


def publish_if(df: DataFrame, violations: DataFrame, path: str) -> bool:
    """Publish the rows if there is no violation; otherwise remove what was published before and publish nothing.

    The rows are written beside the target first, and the old table is set aside before the new one is moved in: readers
    never see a half-written table, only for a moment none, and the old one comes back if the move fails.
    """
    spark = df.sparkSession
    if not violations.isEmpty():
        _remove(spark, path)
        return False
    staged = f"{path}.staged"
    df.write.mode("overwrite").parquet(staged)
    (target, system), (source, _), (old, _) = (_hadoop(spark, p) for p in (path, staged, f"{path}.old"))
    system.delete(old, True)
    had = system.exists(target)
    if had and not system.rename(target, old):
        raise OSError(f"couldn't set {path} aside")
    if not system.rename(source, target):
        if had:
            system.rename(old, target)
        raise OSError(f"couldn't move {staged} to {path}")
    system.delete(old, True)
    return True


def append_events(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the log doesn't hold yet, once each; returns how many. Never overwrites."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    where, system = _hadoop(spark, path)
    if system.exists(where):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti").select(*df.columns)
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def read_by_folder(spark: SparkSession, root: str, name: str, schema: str, folder: str = "video_id") -> DataFrame:
    """The files ``<root>/<folder>/<name>`` of JSON lines as one table, with the folder's name as a column."""
    rows = spark.read.schema(schema).json(f"{root.rstrip('/')}/*/{name}")
    return rows.withColumn(folder, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_document(spark: SparkSession, path: str, schema: str, items: str) -> DataFrame:
    """The rows of the array ``items`` in each whole-file JSON object; an error if a file isn't an object with that array."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = F.when(F.startswith(F.ltrim("value"), F.lit("{")), F.from_json("value", f"{items} array<{schema}>"))
    whole = texts.select(parsed[items].alias("items"), "file")
    bad = [r["file"] for r in whole.filter("items is null").select("file").limit(5).collect()]
    if bad:
        raise ValueError(f"no object with {items}: {', '.join(bad)}")
    return whole.select(F.explode("items").alias("x")).select("x.*")


def upcast(rows: DataFrame, defaults: dict[str, object], aliases: dict[str, dict[str, str]]) -> DataFrame:
    """Rows of an older form in the present one: missing columns and nulls take the default, values their new names."""
    for name, value in defaults.items():
        own = F.col(name) if name in rows.columns else F.lit(None)
        rows = rows.withColumn(name, F.coalesce(own, F.lit(value)))
    for name, new in aliases.items():
        known = F.create_map(*[F.lit(x) for pair in new.items() for x in pair])
        rows = rows.withColumn(name, F.coalesce(F.try_element_at(known, F.col(name)), F.col(name)))
    return rows


def check_settings(given: dict, allowed: dict[str, tuple[type, float | None, float | None]], defaults: dict) -> dict:
    """The settings with defaults filled in; an error that names every unknown, ill-typed or out-of-range one."""
    wrong = [f"{k}: unknown" for k in given if k not in allowed]
    out = {**defaults, **{k: v for k, v in given.items() if k in allowed}}
    for k, (kind, low, high) in allowed.items():
        v = out.get(k)
        if v is None:
            wrong.append(f"{k}: missing")
        elif isinstance(v, bool) != (kind is bool) or not isinstance(v, (int, float) if kind is float else kind):
            wrong.append(f"{k}: not {kind.__name__}")
        elif (low is not None and v < low) or (high is not None and v > high):
            wrong.append(f"{k}: {v} is outside {low} to {high}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def refuse_inputs(rows: DataFrame, column: str, forbidden: DataFrame, *, paths: list[str] = (), barred: list[str] = ()) -> None:
    """The wall between data sets: an error if a key of the forbidden set occurs, or an input path holds a barred part."""
    hit = [p for p in paths if any(b in p for b in barred)]
    found = rows.join(forbidden.select(column).distinct(), column, "left_semi").select(column).distinct().limit(5).collect()
    if hit or found:
        raise ValueError(f"forbidden inputs: {[r[0] for r in found] + hit}")


def vector_violations(vectors: DataFrame, key: str, vector: str, dims: int, *, tolerance: float = 1e-3) -> DataFrame:
    """``key, rules``: what is wrong with each vector that isn't ``dims`` finite numbers of length one; all rows are judged."""
    v = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    whole = F.col(vector).isNotNull()
    rules = F.array_compact(F.array(
        F.when(~whole, F.lit("NULL")), F.when(whole & (F.size(vector) != dims), F.lit("SHAPE")), F.when(whole & odd, F.lit("NOT_FINITE")),
        F.when(whole & ~odd & (norm < 1e-12), F.lit("ZERO")), F.when(whole & ~odd & (norm >= 1e-12) & (F.abs(norm - 1) > tolerance), F.lit("NOT_UNIT")),
    ))
    return vectors.select(F.col(key), rules.alias("rules")).filter(F.size("rules") > 0)


def cached(rows: DataFrame, path: str, key: list[str], compute, value: str) -> DataFrame:
    """The rows with ``value``: from the cache where it has the key, computed and appended where it hasn't.

    compute: a function from the distinct missing keys to ``key, value``. Nothing in the cache is computed again.
    """
    spark = rows.sparkSession
    where, system = _hadoop(spark, path)
    wanted = rows.select(*key).distinct()
    missing = wanted.join(spark.read.parquet(path).select(*key), key, "left_anti") if system.exists(where) else wanted
    compute(missing).select(*key, value).write.mode("append").parquet(path)
    return rows.join(spark.read.parquet(path).dropDuplicates(key), key, "left")


def _sorted(field: T.DataType, c) -> object:
    if isinstance(field, T.StructType):
        inner = F.struct(*[_sorted(f.dataType, c.getField(f.name)).alias(f.name) for f in sorted(field.fields, key=lambda f: f.name)])
        return F.when(c.isNotNull(), inner)
    if isinstance(field, T.ArrayType):
        return F.transform(c, lambda x: _sorted(field.elementType, x))
    return c


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with the keys of every object in order, nulls included."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    df.select(*[_sorted(f.dataType, F.col(f.name)).alias(f.name) for f in fields]).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def cards(rows: DataFrame, key: str, title: str, fields: dict[str, str], items: str) -> DataFrame:
    """``key, card``: a Markdown card with a title, a line for each known field and a list of items."""
    lines = [F.concat(F.lit(f"- **{label}**: "), F.col(c).cast("string")) for label, c in fields.items()]
    bullets = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit("  - "), x))
    body = F.array_join(F.array_compact(F.concat(F.array(F.concat(F.lit("## "), F.col(title)), *lines), bullets)), "\n")
    return rows.select(key, body.alias("card"))
