"""Cleaning of hand-coded events by rules, quality flags, and the audit of what changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Date formats in the order in which they are tried. Fixed values.
DATE_FORMATS = ("yyyy-M-d", "yyyy-M-d H:m:s", "M/d/yy", "M/d/yyyy", "d/M/yy", "d/M/yyyy")


def normalize_label(value: Column, table: Mapping[str, str], missing: str = "unknown") -> Column:
    """Null gives `missing`; else the table by the trimmed lower-case value, then by the value as it is, else the former."""
    folded = F.lower(F.trim(value))
    return F.when(value.isNull(), F.lit(missing)).otherwise(
        F.coalesce(F.try_element_at(_table(table), folded), F.try_element_at(_table(table), value), folded)
    )


def _table(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in (table or {"": ""}).items() for x in kv])


def normalize_by_substring(
    value: Column, patterns: Sequence[tuple[str, Sequence[str]]], default: str = "unknown"
) -> Column:
    """The first role, in the order given, of which any pattern stands in the lower-case value."""
    folded = F.lower(value)
    out = F.lit(default)
    for role, texts in reversed(patterns):
        hit = F.lit(False)
        for t in texts:
            hit = hit | folded.contains(t)
        out = F.when(hit, F.lit(role)).otherwise(out)
    return out


def flag_duration(value: Column, least: float, threshold: float, most: float) -> Column:
    """missing, below_min, above_max, above_threshold or null, in this order of precedence."""
    return F.when(value.isNull(), "missing").when(value < least, "below_min").when(value > most, "above_max").when(
        value > threshold, "above_threshold"
    )


def flag_id(value: Column, ranges: Sequence[tuple[int, int]], flag_outside: bool = True) -> Column:
    """missing, invalid_format, outside_range or null. Text must be a whole number; numbers are cut to one."""
    number = value.try_cast("long")
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | number.between(low, high)
    out = F.when(value.isNull(), "missing").when(number.isNull(), "invalid_format")
    return out.when(~inside, "outside_range") if flag_outside and ranges else out


def qa_flags(df: DataFrame, flags: Mapping[str, Column], key: str) -> DataFrame:
    """Rows with a flag: key and `flags`, joined by '|' in the order given, each with its name as a prefix if not empty."""
    said = F.array_compact(F.array(*[F.concat(F.lit(f"{n}_" if n else ""), c) for n, c in flags.items()]))
    return df.select(key, said.alias("_flags")).where(F.size("_flags") > 0).select(
        key, F.array_join("_flags", "|").alias("flags")
    )


def flag_counts(qa: DataFrame, top: int = 10) -> DataFrame:
    """flag, n of the `top` most frequent; ties by name."""
    return qa.select(
        F.explode(F.split("flags", r"\|")).alias("flag")
    ).groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag").limit(top)


def parse_date_multi(value: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """ISO date by the first format that fits; what fits none is kept, trimmed. Years of two digits are 1969 to 2068."""

    def day(form: str) -> Column:
        at = F.try_to_timestamp(F.trim(value), F.lit(form))
        if "yyyy" not in form:
            at = F.when(F.year(at) > 2068, F.add_months(at, -1200)).otherwise(at)
        return F.date_format(at, "yyyy-MM-dd")

    return F.coalesce(*[day(f) for f in formats], F.trim(value))


def normalize_time(value: Column) -> Column:
    """HH:MM gets ':00'; all else is kept, trimmed."""
    text = F.trim(value)
    return F.when(F.size(F.split(text, ":")) == 2, F.concat(text, F.lit(":00"))).otherwise(text)


def collapse_labels(value: Column, kept: Sequence[str], other: str = "other") -> Column:
    return F.when(value.isin(*kept), value).otherwise(F.lit(other))


def derive_primary_label(value: Column, table: Mapping[str, str], missing: str = "unknown") -> Column:
    return F.coalesce(F.try_element_at(_table(table), F.lower(F.trim(value))), F.lit(missing))


def filter_classes(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """Rows whose trimmed lower-case label is kept (and has become the label); an empty result is an error."""
    out = df.withColumn(column, F.lower(F.trim(F.col(column)))).where(F.col(column).isin(*keep))
    if out.isEmpty():
        raise ValueError(f"no rows of {list(keep)} in {column}")
    return out


def remap_paths(
    df: DataFrame, columns: Sequence[str], prefixes: Sequence[tuple[str, str]], out: str = "path"
) -> DataFrame:
    """The first of these columns that exists, prefixes replaced one after the other, backslashes as slashes."""
    found = next((c for c in columns if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {list(columns)}")
    value = F.col(found)
    for old, new in prefixes:
        value = F.replace(value, F.lit(old), F.lit(new))
    return df.withColumn(out, F.replace(value, F.lit("\\"), F.lit("/")))


def drop_resource_forks(df: DataFrame, column: str, strip: bool = False) -> DataFrame:
    """Without rows whose file name begins with '._'; or with that beginning taken off."""
    if strip:
        return df.withColumn(column, F.regexp_replace(column, r"^\._", ""))
    return df.where(~F.col(column).startswith("._") | F.col(column).isNull())


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)


def video_key(df: DataFrame, path: str, name: str | None = None, variant: str = "path") -> Column:
    """path: lower-case, slashes. base: file name. joined: path with the name added if it doesn't end with it."""
    text = F.lower(F.replace(F.trim(F.col(path)), F.lit("\\"), F.lit("/")))
    if variant == "base":
        return base_name(text)
    if variant == "joined" and name:
        own = F.lower(F.trim(F.col(name)))
        return F.when(text.endswith(own), text).otherwise(F.concat_ws("/", F.rtrim(text, F.lit("/")), own))
    return text


#: Words that say yes and no.
YES, NO = ("Y", "YES", "TRUE", "1"), ("N", "NO", "FALSE", "0")


def parse_external_sheet(
    df: DataFrame, video: str, ours: str, labels: Sequence[str], extensions: Sequence[str]
) -> DataFrame:
    """video, ours (true, false, null), labels: of rows that name a video file; one-hot columns as an array."""
    name = F.trim(F.col(f"`{video}`"))
    is_file = F.lit(False)
    for e in extensions:
        is_file = is_file | F.lower(name).endswith(e)
    said = F.upper(F.trim(F.col(f"`{ours}`")))
    found = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").try_cast("double") == 1, F.lit(c)) for c in labels]))
    return df.where(name.isNotNull() & (name != "") & ~name.rlike(r"^\d+$") & is_file).select(
        name.alias("video"), F.when(said.isin(*YES), True).when(said.isin(*NO), False).alias("ours"),
        found.alias("labels")
    )


#: What a column's name (in lower case, trimmed) has to be or to hold for a role. A column has the first role that
#: it fits.
SHEET_ROLES = (
    ("ours", ("our video",)), ("notes", ("note",)),
    *[(name, (name, "1-0")) for name in ("none", "ear", "tail", "teat", "other")]
)
SHEET_VIDEO = "video"


def detect_columns(columns: Sequence[str]) -> dict[str, str]:
    """role: column of an external sheet, by parts of the names: video, ours, notes and the classes. Of several columns that
    fit a role the last one has it. A sheet without a video column is an error."""
    found: dict[str, str] = {}
    for column in columns:
        name = column.strip().lower()
        role = "video" if name == SHEET_VIDEO else next(
            (r for r, parts in SHEET_ROLES if all(p in name for p in parts)), None
        )
        if role is not None:
            found[role] = column
    if "video" not in found:
        raise ValueError(f"no column for video in {list(columns)}")
    return found


def read_external_sheet(df: DataFrame, extensions: Sequence[str] = (".mp4", ".mov", ".avi")) -> DataFrame:
    """video, ours (true, false, null), notes, labels (the classes whose column says 1): rows of a sheet that name a video file,
    whatever its columns are called (detect_columns). Roles without a column are null, or no label."""
    at = detect_columns(df.columns)
    text = lambda role: F.trim(
        F.col(f"`{at[role]}`").cast("string")
    ) if role in at else F.lit(None).cast("string")
    name, said = text("video"), F.upper(text("ours"))
    is_file = F.lit(False)
    for e in extensions:
        is_file = is_file | F.lower(name).endswith(e)
    classes = [r for r, parts in SHEET_ROLES if "1-0" in parts and r in at]
    labels = F.array_compact(
        F.array(*[F.when(text(c).isin("1", "1.0"), F.lit(c)) for c in classes])
    ) if classes else F.array().cast("array<string>")
    ours = F.when(said.isin(*YES), True).when(said.isin(*NO), False)
    rows = df.where(name.isNotNull() & (name != "") & ~name.rlike(r"^\d+$") & is_file)
    return rows.select(name.alias("video"), ours.alias("ours"), text("notes").alias("notes"), labels.alias("labels"))


def sheet_statistics(df: DataFrame, extensions: Sequence[str] = (".mp4", ".mov", ".avi")) -> DataFrame:
    """One row: rows of the sheet, clips that were read, and how many of these say yes, no or neither in the column of `ours`."""
    clips = read_external_sheet(df, extensions)
    ours = F.col("ours")
    counts = clips.agg(
        F.count("*").alias("clips"), F.count_if(ours).alias("yes"), F.count_if(~ours).alias("no"),
        F.count_if(ours.isNull()).alias("unknown")
    )
    return df.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(counts))


def onehot_invalid_cells(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, column, value of cells that are not 0, 1 or blank."""
    text = df.select(key, *[F.col(c).cast("string").alias(c) for c in columns])
    cells = text.unpivot(key, list(columns), "column", "value").where(F.trim("value") != "")
    number = F.col("value").try_cast("double")
    return cells.where(number.isNull() | ~number.isin(0.0, 1.0))


def label_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, n, percent (of rows, 4 decimals): all columns in one pass."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in columns])
    counts = text.unpivot([], list(columns), "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("_all"))
    return counts.join(totals, "column").select(
        "column", "value", "n", F.round(100 * F.col("n") / F.col("_all"), 4).alias("percent")
    )


def cleaning_audit(df: DataFrame, pairs: Mapping[str, tuple[Column, Column]], flagged: DataFrame) -> DataFrame:
    """rows, flagged rows and changes per field: raw (lower-case, untrimmed, null as 'nan') against clean."""
    changed = [
        F.count_if(F.coalesce(F.lower(raw), F.lit("nan")) != clean).alias(f"{n}_changes")
        for n, (raw, clean) in pairs.items()
    ]
    return df.agg(F.count("*").alias("rows"), *changed).crossJoin(flagged.agg(F.count("*").alias("flagged")))


def cleaning_distributions(df: DataFrame, pairs: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """field, value, before, after: how many rows have a value before and after cleaning ('(null)' counts as one); all
    fields in one pass."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("(null)"))
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("field"), text(c).alias("value"), F.lit(i).alias("side"))
            for n, both in pairs.items() for i, c in enumerate(both)
        ]
    )
    rows = df.select(F.explode(cells).alias("c")).select("c.*")
    return rows.groupBy("field", "value").agg(
        F.count_if(F.col("side") == 0).alias("before"), F.count_if(F.col("side") == 1).alias("after")
    )


def null_profile(df: DataFrame) -> DataFrame:
    """column, nulls: one aggregate over the table."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "nulls")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n with margins: a null of a or b stands for all (values that are null count as '(null)')."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in (a, b)]
    return df.select(*keys).cube(a, b).agg(F.count("*").alias("n"))
