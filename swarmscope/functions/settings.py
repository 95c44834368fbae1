"""Parsing and labelling of operating settings, file names and placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmscope.functions.columns import col, number

SPHERE_LIKE = ("sphere", "sphere_fallback")
ZERO_CONCENTRATION = "000 xanthan"
#: Concentration labels in percent by weight. Fixed values.
WEIGHT_PERCENT = {"000 xanthan": "0.00", "0125 xanthan": "0.125", "025 xanthan": "0.25"}
#: Concentrations in evaluation file names. Fixed values.
_SETTING = r"^(.*?\brpm)\s+(.*?\blmin)\s*(.*)$"


def squeezed(x: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(x), r"\s+", " "))


def setting_part(setting: str | Column, part: int) -> Column:
    """Part 1: up to ``rpm``; 2: up to ``lmin``; 3: the rest. Null where the setting has no such form."""
    text = squeezed(setting)
    return F.when(text.rlike(_SETTING), F.regexp_extract(text, _SETTING, part))


def parse_setting(df: DataFrame, setting: str = "reactor_setting", strict: bool = False) -> DataFrame:
    """Adds rpm, aeration and xanthan texts; ``strict`` raises on a setting without rpm or lmin."""
    out = df.withColumns({n: setting_part(setting, i) for i, n in enumerate(("rpm", "aeration", "xanthan"), 1)})
    if strict:
        bad = F.col(setting).isNotNull() & F.col("rpm").isNull()
        out = out.withColumn("rpm", F.when(bad, F.raise_error(F.concat(F.lit("no rpm and lmin in setting: "), F.col(setting)))).otherwise(F.col("rpm")))
    return out


def with_setting_numbers(df: DataFrame, setting: str = "reactor_setting") -> DataFrame:
    """Adds rpm_val and aer_val as doubles and xanthan as text."""
    first = lambda c: number(F.split(c, " ")[0])
    return df.withColumns({"rpm_val": first(setting_part(setting, 1)), "aer_val": first(setting_part(setting, 2)), "xanthan": setting_part(setting, 3)})


def is_zero_concentration(setting: str | Column) -> Column:
    return F.lower(col(setting)).contains(ZERO_CONCENTRATION)


def file_metadata(df: DataFrame, name: str = "filename") -> DataFrame:
    """Adds placement (``place_<n>``), xanthan (a share in per cent), both ``unknown`` if absent, rpm and lmin (ints)."""
    # fixed values: the patterns that file names follow
    find = lambda p, i=1: F.nullif(F.regexp_extract(name, "(?i)" + p, i), F.lit(""))
    share = F.concat(find(r"(\d+)-(\d+)-xanthan"), F.lit("."), find(r"(\d+)-(\d+)-xanthan", 2)).cast("double")
    xanthan = F.when(share == 0, "0.00").when(share == 0.25, "0.25").otherwise(F.format_string("%.3f", share))
    place = F.concat(F.lit("place_"), find(r"place(?:ment)?[_-]?(\d+)"))
    unknown = F.lit("unknown")
    return df.withColumns({"placement": F.coalesce(place, unknown), "xanthan": F.when(share.isNull(), unknown).otherwise(xanthan), "rpm": find(r"(\d+)[_-]?rpm").cast("int"), "lmin": find(r"(\d+)[_-]?l[_-]?min").cast("int")})


def legacy_file_parts(df: DataFrame, name: str = "filename") -> DataFrame:
    """placement, setting and replicate of ``placement_<n>_<setting>_rep_<m>.csv``; null where the name has no such form."""
    form = r"^(placement_\d+)_(.+)_(rep_\d+)\.csv$"
    return df.withColumns({n: F.when(F.col(name).rlike(form), F.regexp_extract(name, form, i)) for i, n in enumerate(("placement", "setting", "replicate"), 1)})


def stem(path: str | Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(col(path), "/"), -1), r"(\.[^.]*)$", 1))


def is_image(path: str | Column) -> Column:
    return extension(path).isin(".jpg", ".jpeg", ".png")


def safe_name(x: str | Column) -> Column:
    return F.translate(col(x), " /", "__")


def placement_label(placement: str | Column) -> Column:
    return F.concat(F.lit("position "), F.regexp_extract(col(placement), r"(\d+)$", 1))


def weight_label(xanthan: str | Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in WEIGHT_PERCENT.items() for x in kv])
    return F.concat(F.coalesce(F.try_element_at(labels, col(xanthan)), col(xanthan)), F.lit(" wt%"))


def number_label(x: str | Column, decimals: int = 2) -> Column:
    """Fixed decimals, but whole numbers without any."""
    return F.when(col(x) == F.floor(col(x)), col(x).cast("long").cast("string")).otherwise(F.format_string(f"%.{decimals}f", col(x)))


def natural_key(name: str | Column) -> Column:
    """Sorts runs of digits by their value: an array of text runs and zero-padded digit runs."""
    return F.transform(F.regexp_extract_all(col(name), F.lit(r"(\d+|\D+)"), 1), lambda y: F.when(y.rlike(r"^\d+$"), F.lpad(y, 20, "0")).otherwise(F.lower(y)))


def trailing_number(x: str | Column) -> Column:
    """The number a text ends in; 0 if none."""
    return F.coalesce(F.nullif(F.regexp_extract(col(x), r"(\d+)$", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))


def preference(x: str | Column, order: list[str]) -> Column:
    """Sort key: the place in ``order``, the rest after it."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), col(x))
    return F.when(place > 0, place).otherwise(len(order) + 1)
