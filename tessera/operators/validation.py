"""Record validation: JSON parsing, required fields, range rules, defaults.

All checks are column expressions evaluated where the rows are; a record
is never sent to the driver to be checked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

CORRUPT = "_corrupt_record"


def parse_json(df: DataFrame, col: str, schema: T.StructType, out: str = "doc") -> DataFrame:
    """Parse a JSON text column into struct ``out`` (PERMISSIVE mode) and flag
    malformed documents in ``{out}_malformed``. The raw text of a malformed
    document lands in ``{out}.{CORRUPT}``; a NULL document is not malformed
    (its fields are all missing)."""
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(col), with_corrupt,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return (df.withColumn(out, parsed)
              .withColumn(f"{out}_malformed", F.col(f"{out}.{CORRUPT}").isNotNull()))


def first_missing(fields: Sequence[str], prefix: str = "") -> Column:
    """Name of the first field (in list order) that is NULL, else NULL."""
    names = F.array(*[F.when(F.col(prefix + f).isNull(), F.lit(f)) for f in fields])
    return F.get(F.array_compact(names), 0)


def require_fields(df: DataFrame, fields: Sequence[str], prefix: str = "",
                   out: str = "missing_field") -> DataFrame:
    """Adds the name of the first missing required field (NULL when complete)."""
    return df.withColumn(out, first_missing(fields, prefix))


def check_ranges(df: DataFrame, rules: Mapping[str, Column], valid: str = "valid",
                 failed: str = "failed_rule") -> DataFrame:
    """Evaluate named predicates in order; a row is valid when every predicate
    is TRUE (a NULL comparison counts as a failure). ``failed`` names the first
    rule that did not hold."""
    first = None
    for name, pred in rules.items():
        cond = ~F.coalesce(pred, F.lit(False))
        first = F.when(cond, F.lit(name)) if first is None else first.when(cond, F.lit(name))
    if first is None:
        return df.withColumns({valid: F.lit(True), failed: F.lit(None).cast("string")})
    return df.withColumn(failed, first).withColumn(valid, F.col(failed).isNull())


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with the failed rule)."""
    checked = check_ranges(df, rules)
    return (checked.filter("valid").drop("valid", "failed_rule"),
            checked.filter(~F.col("valid")).drop("valid"))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Fill NULLs of optional columns with defaults; absent columns are added."""
    cols = {}
    for name, value in defaults.items():
        if name in df.columns:
            cols[name] = F.coalesce(F.col(name), F.lit(value))
        else:
            cols[name] = F.lit(value)
    return df.withColumns(cols)


# --- fixed values -----------------------------------------------------------
# Run-configuration record: required fields, range rules and defaults.
RUN_CONFIG_REQUIRED = ["name", "num_workers", "mem_per_worker", "cores_per_worker",
                       "dataset_scale", "log_dir"]
RUN_CONFIG_DEFAULTS = {"remark": "", "benchmark_name": ""}
RUN_CONFIG_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("num_workers", T.LongType()),
    T.StructField("mem_per_worker", T.LongType()),
    T.StructField("cores_per_worker", T.LongType()),
    T.StructField("dataset_scale", T.DoubleType()),
    T.StructField("log_dir", T.StringType()),
    T.StructField("remark", T.StringType()),
    T.StructField("benchmark_name", T.StringType()),
])
# ---------------------------------------------------------------------------


def run_config_rules(prefix: str = "") -> dict[str, Column]:
    """Range rules of a run request: three counts >= 1, 0 <= scale <= 1."""
    c = lambda n: F.col(prefix + n)
    return {
        "num_workers>=1": c("num_workers") >= 1,
        "mem_per_worker>=1": c("mem_per_worker") >= 1,
        "cores_per_worker>=1": c("cores_per_worker") >= 1,
        "0<=dataset_scale<=1": c("dataset_scale").between(0.0, 1.0),
    }


def validate_configs(df: DataFrame, col: str = "config") -> DataFrame:
    """Full check of JSON run requests: parse -> required fields -> ranges ->
    defaults. Adds ``reason`` (NULL when the request is accepted). A present
    field with JSON null counts as missing."""
    parsed = parse_json(df, col, RUN_CONFIG_SCHEMA, "cfg")
    parsed = require_fields(parsed, RUN_CONFIG_REQUIRED, prefix="cfg.")
    checked = check_ranges(parsed, run_config_rules("cfg."))
    # valid JSON that does not fit the record: a field of another type, or no object at all
    reason = (F.when(F.col("cfg_malformed") & F.try_parse_json(F.col(col)).isNotNull(), F.lit("wrong type"))
               .when(F.col("cfg_malformed"), F.lit("malformed JSON"))
               .when(F.col("missing_field").isNotNull(),
                     F.concat(F.lit("missing field: "), F.col("missing_field")))
               .when(~F.col("valid"), F.concat(F.lit("out of range: "), F.col("failed_rule"))))
    return checked.withColumn("reason", reason).withColumn(
        "cfg", F.col("cfg").withField("remark", F.coalesce(F.col("cfg.remark"), F.lit("")))
                           .withField("benchmark_name", F.coalesce(F.col("cfg.benchmark_name"), F.lit(""))))


def request_entries(df: DataFrame, col: str, entry: str = "entry", pos: str = "pos") -> DataFrame:
    """One row per entry of the JSON array in ``col``: its JSON text and 0-based position.

    A document that is no JSON array (NULL, malformed, a single object) keeps one row with NULL entry
    and position and ``reason``; an empty array has no entries and gives no rows.
    """
    text = F.ltrim(F.col(col))
    entries = F.from_json(F.col(col), T.ArrayType(T.StringType()))
    is_array = text.startswith("[") & entries.isNotNull()
    reason = (F.when(F.col(col).isNull(), F.lit("missing document"))
               .when(F.try_parse_json(F.col(col)).isNull(), F.lit("malformed JSON"))
               .when(~is_array, F.lit("not an array")))
    tagged = df.withColumn("reason", reason).withColumn("__entries", F.when(F.col("reason").isNull(), entries))
    rows = tagged.where(F.col("reason").isNotNull() | (F.size("__entries") > 0))
    return rows.select(*[c for c in rows.columns if c != "__entries"], F.posexplode_outer("__entries").alias(pos, entry))


def validate_requests(df: DataFrame, col: str = "request") -> DataFrame:
    """JSON arrays of run configurations: every entry is checked like a single request, with its
    position, and a document that is no array is rejected as a whole. ``reason`` is NULL when accepted."""
    rows = request_entries(df, col).withColumnRenamed("reason", "__doc_reason")
    checked = validate_configs(rows, "entry")
    return (checked.withColumn("reason", F.coalesce("__doc_reason", "reason")).drop("__doc_reason"))
