"""Files whose fields drift: path-value maps, statistics by file, a change report, one table.

Every record becomes rows (path, raw type, raw text), nested values too where asked for; the statistics of a file are one
aggregation over them, so neither needs the fields to be known. Changes compare a file's
statistics with those of the cloud's previous file. The consistent table projects the known
fields to fixed types and names every value that could not be cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvaframe.schema import require

#: Fields of the consistent table and their types.
TARGET = {
    "x": "double",
    "y": "double",
    "z": "double",
    "instance_id": "bigint",
    "classification": "bigint",
    "semclassid": "bigint",
    "specificclassid": "bigint",
    "semclassidpredicted": "bigint",
    "specificclassidpredicted": "bigint",
    "intensity": "double",
}


def reduced(name: Column) -> Column:
    """Lower case without characters other than letters and digits."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}]", "")


def path_values(records: DataFrame, payload: str = "payload", depth: int = 1) -> DataFrame:
    """One row per path of each payload: ``path``, ``raw_type`` and ``raw_value``.

    raw_type: text, float (a number with a decimal point), integer, boolean, null or nested.
    A payload that is null, broken or no object gives a single row with a null path and
    raw_type 'broken'. Only the columns of ``records`` other than the payload are kept. With a
    ``depth`` above 1 what lies inside of nested values has rows of its own, down to that many
    levels: ``a.b`` for a key of an object, ``a[]`` for the items of an array.
    """
    require(records, payload)
    if depth < 1:
        raise ValueError("depth must be at least 1")
    clash = {"path", "raw_type", "raw_value"}
    keep = [c for c in records.columns if c != payload and c not in clash]
    v = F.try_parse_json(F.col(payload))
    rows = records.select(*keep, F.col(payload).alias("__payload"), v.alias("__doc"))
    tvf = rows.sparkSession.tvf
    rows = rows.lateralJoin(tvf.variant_explode_outer(F.col("__doc").outer()), how="left").withColumn("__path", F.col("key"))
    level = rows
    for _ in range(depth - 1):
        inner = level.where(F.schema_of_variant(F.col("value")).rlike("^(OBJECT|ARRAY)")).select(*keep, "__payload", F.col("value").alias("__doc"), F.col("__path").alias("__up"))
        path = F.when(F.col("key").isNull(), F.concat("__up", F.lit("[]"))).otherwise(F.concat_ws(".", "__up", "key"))
        level = inner.lateralJoin(tvf.variant_explode(F.col("__doc").outer())).withColumn("__path", path).drop("__up")
        rows = rows.unionByName(level)
    return _typed_paths(rows, keep)


def _typed_paths(rows: DataFrame, keep: list[str]) -> DataFrame:
    kind = F.schema_of_variant(F.col("value"))
    # a number that is no BIGINT: only the text says whether it has a decimal point
    quoted = F.replace(F.replace(F.to_json(F.struct(F.col("key").alias("k"))), F.lit('{"k":'), F.lit("")), F.lit("}"), F.lit(""))
    pointed = F.rlike(F.col("__payload"), F.concat(F.lit(r"\Q"), quoted, F.lit(r"\E\s*:\s*-?[0-9]+\.")))
    raw_type = (
        F.when(F.col("__path").isNull(), "broken")
        .when(F.col("value").isNull() | F.is_variant_null(F.col("value")) | (kind == "VOID"), "null")
        .when(kind == "STRING", "text")
        .when(kind == "BIGINT", "integer")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("DECIMAL") & ~kind.endswith(",0)"), "float")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.when(pointed, "float").otherwise("integer"))
        .otherwise("nested")
    )
    text = F.when(raw_type.isin("null", "broken"), F.lit(None)).otherwise(F.try_variant_get(F.col("value"), "$", "string"))
    return rows.select(*keep, F.col("__path").alias("path"), raw_type.alias("raw_type"), text.alias("raw_value"))


def name_fields(paths: DataFrame, alias: DataFrame) -> DataFrame:
    """Adds ``spelling`` (the reduced path) and ``field_name`` (by alias, else the spelling).

    The alias table doesn't grow with the data; repeated keys count once, the smallest
    field name then holding.
    """
    known = alias.where(F.col("alias_key").isNotNull() & F.col("field_name").isNotNull())
    known = known.groupBy(F.col("alias_key").alias("spelling")).agg(F.min("field_name").alias("__known"))
    out = paths.drop("spelling", "field_name").withColumn("spelling", reduced(F.col("path")))
    out = out.join(known, "spelling", "left")
    return out.withColumn("field_name", F.coalesce("__known", "spelling")).drop("__known")


def file_statistics(paths: DataFrame, file: tuple[str, ...] = ("cloud_id", "file_no")) -> DataFrame:
    """Per file and field: how its records spell it, its type and how often each raw type occurs.

    ``spellings`` are the keys as they stand in the records; reduced names only decide which
    field a key means.
    """
    count = lambda k: F.count_if(F.col("raw_type") == k)
    stats = paths.where(F.col("path").isNotNull()).groupBy(*file, "field_name").agg(
        F.array_sort(F.collect_set("path")).alias("spellings"),
        F.count(F.lit(1)).alias("n_values"),
        *[count(k).alias(f"n_{k}") for k in ("text", "float", "integer", "boolean", "nested", "null")],
    )
    kind = (
        F.when(F.col("n_text") > 0, "text")
        .when(F.col("n_nested") > 0, "nested")
        .when(F.col("n_float") > 0, "float")
        .when(F.col("n_integer") > 0, "integer")
        .when(F.col("n_boolean") > 0, "boolean")
    )
    return stats.withColumn("kind", kind)


def changes(paths: DataFrame) -> DataFrame:
    """Each change of a file against the cloud's previous existing file.

    change_kind: added, removed, renamed (the keys of the two files differ in any character) or
    retyped. A file all of whose records are broken still exists. Rows are distinct.
    """
    files = paths.where(F.col("cloud_id").isNotNull() & F.col("file_no").isNotNull()).select("cloud_id", "file_no").distinct()
    order = W.partitionBy("cloud_id").orderBy("file_no")
    files = files.select("cloud_id", "file_no", F.lag("file_no").over(order).alias("prev_no"), F.lead("file_no").over(order).alias("next_no"))
    stats = file_statistics(paths).select("cloud_id", "file_no", "field_name", "spellings", "kind")
    # every statistic is met twice: in its own file and as the past of the next one
    here = stats.join(files, ["cloud_id", "file_no"])
    own = here.where(F.col("prev_no").isNotNull()).select("cloud_id", "file_no", "field_name", F.lit(True).alias("is_own"), "spellings", "kind")
    past = here.where(F.col("next_no").isNotNull()).select("cloud_id", F.col("next_no").alias("file_no"), "field_name", F.lit(False).alias("is_own"), "spellings", "kind")
    side = lambda c, own_side: F.max(F.when(F.col("is_own") == own_side, F.col(c)))
    both = own.unionByName(past).groupBy("cloud_id", "file_no", "field_name").agg(
        side("spellings", True).alias("now"), side("spellings", False).alias("was"), side("kind", True).alias("kind_now"), side("kind", False).alias("kind_was")
    )
    kinds = F.array_compact(
        F.array(
            F.when(F.col("was").isNull(), "added"),
            F.when(F.col("now").isNull(), "removed"),
            F.when(F.col("now") != F.col("was"), "renamed"),
            F.when(F.col("kind_now") != F.col("kind_was"), "retyped"),
        )
    )
    return both.select("cloud_id", "file_no", "field_name", F.explode(kinds).alias("change_kind"))


def consistent_table(records: DataFrame, alias: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """One typed row per record and the names of the fields whose value could not be cast.

    ``extra`` holds the fields that the target doesn't name, as text. Of several keys of one
    record that mean the same field, the first by name that isn't null holds.
    """
    target = target or TARGET
    keep = [c for c in ("record_id", "cloud_id", "file_no", "received_ts") if c in records.columns]
    named = name_fields(path_values(records.select(*keep, "payload")), alias)
    known = lambda f: F.col("field_name") == f
    raw = {f: F.min_by("raw_value", F.when(known(f) & F.col("raw_value").isNotNull(), F.col("path"))) for f in target}
    strange = F.map_from_entries(
        F.array_sort(F.collect_set(F.when(F.col("path").isNotNull() & ~F.coalesce(F.col("field_name").isin(*target), F.lit(False)), F.struct("path", "raw_value"))))
    )
    out = named.groupBy(*keep).agg(*[raw[f].alias(f"__{f}") for f in target], strange.alias("extra"), F.bool_or(F.col("raw_type") == "broken").alias("is_broken"))

    def cast(f: str, kind: str) -> Column:
        c = F.col(f"__{f}")
        if kind != "bigint":
            return c.try_cast(kind)
        as_decimal = c.try_cast("decimal(38,10)")  # '3.0' is the integer 3; '3.5' fails
        return F.coalesce(c.try_cast("bigint"), F.when(as_decimal == F.floor(as_decimal), as_decimal.try_cast("bigint")))

    failed = F.array_compact(F.array(*[F.when(F.col(f"__{f}").isNotNull() & cast(f, k).isNull(), F.lit(f)) for f, k in target.items()]))
    return out.select(*keep, *[cast(f, k).alias(f) for f, k in target.items()], "extra", failed.alias("failed_casts"), "is_broken")
