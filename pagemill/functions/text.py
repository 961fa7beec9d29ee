"""Text expressions: normalisation, label stripping, field names and types, case rules. All native but NFC."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word character as the extraction rules mean it: letters, numbers, underscore; combining marks are not.
W = r"[\p{L}\p{N}_]"
BOUNDARY = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
_UNSTABLE = r"[̀-़ͯ॑-॔क़-य़]|[^\u0000-ɏऀ-ॿ -⁯]"
_INVISIBLE = r"[‌‍﻿​‎‏]"

#: The label patterns that are taken out of card text, in order.
_TAIL = r"\s*[:\-.]?"
LABELS = [
    p + _TAIL
    for p in (
        r"निर्वाचक\s*(?:का)?\s*नाम", r"पिता\s*(?:का)?\s*नाम", r"पति\s*(?:का)?\s*नाम", r"माता\s*(?:का)?\s*नाम", r"अन्य\s*(?:का)?\s*नाम", r"संबंधी\s*(?:का)?\s*नाम",
        r"मकान\s*संख्या", r"गृह\s*संख्या", "उम्र", "आयु", "लिंग", r"पहचान\s*पत्र\s*(?:क्रमांक)?", r"अनुभाग\s*संख्या", r"विधान\s*सभा\s*(?:निर्वाचन)?\s*(?:क्षेत्र)?",
        r"भाग\s*संख्या", r"क्रम\s*संख्या", r"ग्राम\s*पंचायत", r"वार्ड\s*संख्या", r"मतदान\s*स्थल", r"फोटो\s*उपलब्ध", "हस्ताक्षर",
        r"Elector'?s?\s*Name", r"Father'?s?\s*Name", r"Husband'?s?\s*Name", r"House\s*No\.?", "Age", "Gender",
    )
]


@F.pandas_udf(StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: Not pushed below or repeated above a filter: each value goes to Python once.
_nfc = _compose.asNondeterministic()
#: In a column's metadata: all of its values are in composed form. Parquet keeps it.
COMPOSED = "pagemill.composed"


def unstable(c: Column) -> Column:
    """Whether composition can change the text."""
    return c.rlike(_UNSTABLE)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value bound to a variable: a lambda's body, and the columns named in it, is worked out for each element."""
    return F.transform(F.array(value), f)[0]


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1C-\x1F]+", " "))


def normalize(c: Column, nfc: bool = False) -> Column:
    """Stored form of a text: composed, without invisible characters and dandas, white space squeezed; null gives ''.

    Only texts with characters that composition can change are given to Python, and only if nfc is set.
    """
    c = F.coalesce(c.cast("string"), F.lit(""))
    if nfc:
        c = F.coalesce(_nfc(F.when(unstable(c), c)), c)
    return squeeze(F.regexp_replace(F.regexp_replace(c, _INVISIBLE, ""), "[।॥]", " "))


def is_composed(df: DataFrame, name: str) -> bool:
    return bool(df.schema[name].metadata.get(COMPOSED))


def composed(df: DataFrame, texts: tuple[str, ...] = (), maps: tuple[str, ...] = ()) -> DataFrame:
    """df with the text columns, and the values of the map columns, in composed form, and marked so; absent columns, and
    those that are marked already, are passed over. Only values with characters that composition can change are given to Python.
    """
    mark = {COMPOSED: True}
    for name in (n for n in (*texts, *maps) if n in df.columns and not is_composed(df, n)):
        if name in texts:
            c = F.col(name)
            df = df.withColumn(name, F.coalesce(_nfc(F.when(unstable(c), c)), c))
        else:
            # One string for all values, parted by control characters, which nothing composes with.
            joined = F.array_join(F.transform(F.map_values(name), lambda v: F.coalesce(v, F.lit("\x1e"))), "\x1f")
            df = df.withColumn("_composed", _nfc(F.when(unstable(joined), joined)))
            values = F.transform(F.split("_composed", "\x1f", -1), lambda v: F.nullif(v, F.lit("\x1e")))
            df = df.withColumn(name, F.when(F.size(values) == F.size(name), F.map_from_arrays(F.map_keys(name), values)).otherwise(F.col(name))).drop("_composed")
        df = df.withMetadata(name, mark)
    return df


def contains(raw: Column, term: str) -> Column:
    """Whether the normalised text holds a normalised term, in any case. Texts are normalised only where that can matter."""
    rough = _INVISIBLE if " " not in term else rf"(?U){_INVISIBLE}|[।॥]|\s\s|[\s&&[^ ]]"
    t = term.lower()
    return F.lower(raw).contains(t) | (raw.rlike(rough) & F.lower(normalize(raw)).contains(t))


def strip_labels(c: Column) -> Column:
    for p in LABELS:
        c = F.regexp_replace(c, f"(?iuU){p}", " ")
    return squeeze(c)


def field_name(c: Column) -> Column:
    """Key of a header or label: lower case, only word characters and Devanagari, underscores for spaces."""
    kept = F.regexp_replace(F.trim(F.lower(c)), r"[^\p{L}\p{N}_ऀ-ॿ\s]", "")
    return F.regexp_replace(kept, r"\s+", "_")


def field_type(c: Column) -> Column:
    bare = F.regexp_replace(c, r"[\s-]", "")
    return (
        F.when(c.rlike(r"^\d+$"), "number")
        .when(c.rlike(r"^[\w.-]+@[\w.-]+\.\w+$"), "email")
        .when(bare.rlike(r"^\+?\d{10,15}$"), "phone")
        .otherwise("text")
    )


def title(c: Column) -> Column:
    """Capital after every character that is not a letter, as in str.title."""

    def raised(chars: Column) -> Column:
        up = F.transform(chars, lambda x, i: F.when((i == 0) | ~F.element_at(chars, F.greatest(i, F.lit(1))).rlike(r"^\p{L}$"), F.upper(x)).otherwise(x))
        return F.array_join(up, "")

    return once(F.split(F.lower(c), r"(?!^)(?!\z)"), raised)


def is_title(c: Column) -> Column:
    return c.rlike(r"[\p{Lu}\p{Ll}]") & (c == title(c))


def is_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def label_of(key: Column) -> Column:
    return title(F.replace(key, F.lit("_"), F.lit(" ")))


def safe_filename(c: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_\s-]", "")), F.lit(" "), F.lit("_"))


def number_like(c: Column) -> Column:
    """Digits with at most one point: what a spreadsheet cell stores as a number."""
    return c.rlike(r"^(?=.*\d)\d*\.?\d*$")


def block_type(size: Column, bottom: Column, height: Column) -> Column:
    return F.when(size > 14, "heading").when(bottom > 0.9 * height, "footer").otherwise("text")


def text_share(c: Column) -> Column:
    n = F.length(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(n > 100, 0.8).when(n > 10, 0.3).otherwise(0.0)
