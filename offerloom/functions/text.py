"""Name keys and text helpers. The keys differ on purpose: each serves its own match."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    real = texts.dropna()
    return real.map(lambda x: unicodedata.normalize("NFKC", x)).reindex(texts.index) if len(real) else texts


def nfkc(text: Column | str) -> Column:
    """Unicode compatibility form. Only texts beyond ASCII are sent to Python; of all others a null goes there and back."""
    text = _c(text)
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


#: Apostrophes, grade words, and what search and addresses take letters for.
APOSTROPHES = "’‘`´'"
GRADE_WORDS, GRADES = ("kl", "klasse"), ("i", "ii", "iii", "1", "2", "3")
FOLDED, BASE = "äöüéèê", "aoueee"
#: A grade word, a full stop or none, and a grade, as words of their own.
GRADE = rf"(?U)\b({'|'.join(GRADE_WORDS)})\.?\s*({'|'.join(GRADES)})\b"


def name_key(name: Column | str, unicode_form: bool = True) -> Column:
    """Key for duplicates: apostrophes vanish, a grade such as `Kl. I` goes, other marks are spaces."""
    x = F.lower(nfkc(name) if unicode_form else _c(name))
    x = F.translate(x, APOSTROPHES, "")
    x = F.regexp_replace(x, GRADE, " ")
    x = F.regexp_replace(x, r"(?U)[^\w]+", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def norm_name(name: Column | str) -> Column:
    """Key across chains: letters a-z, German letters and digits; all else is space."""
    return F.trim(F.regexp_replace(F.lower(_c(name)), "[^a-z0-9äöüß]+", " "))


def fold(text: Column | str) -> Column:
    """For search: lower case, umlauts and e-accents to base letters, ß to ss; null is empty."""
    x = F.lower(F.coalesce(_c(text), F.lit("")))
    return F.replace(F.translate(x, FOLDED, BASE), F.lit("ß"), F.lit("ss"))


def slug(text: Column | str) -> Column:
    x = F.replace(F.translate(F.lower(_c(text)), FOLDED[:3], BASE[:3]), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def json_strings(text: Column | str) -> Column:
    """The string elements of a JSON array; null for anything but an array."""
    parsed = F.try_parse_json(_c(text))
    items = F.try_variant_get(parsed, "$", "array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(strings, lambda v: F.try_variant_get(v, "$", "string"))


#: Fractions that lead a quantity.
FRACTIONS = {"¼": 1 / 4, "½": 1 / 2, "¾": 3 / 4, "⅓": 1 / 3, "⅔": 2 / 3}


def scale_quantity(text: Column | str, times: Column) -> Column:
    """A quantity text with its leading number multiplied: `1/2 cup` times 3 is `1.5 cup`; a text without a number, and times 1, change nothing."""
    text = _c(text)
    form = r"^\s*(?:(\d+)\s*/\s*(\d+)|(\d+(?:[.,]\d+)?)|([¼½¾⅓⅔]))\s*(.*)$"
    part = lambda n: F.regexp_extract(text, form, n)
    top, bottom = part(1).try_cast("double"), part(2).try_cast("double")
    sign = F.try_element_at(F.create_map(*[F.lit(x) for pair in FRACTIONS.items() for x in pair]), part(4))
    number = F.coalesce(F.when(bottom > 0, top / bottom), F.replace(part(3), F.lit(","), F.lit(".")).try_cast("double"), sign)
    shown = F.regexp_replace(F.format_string("%.2f", F.round(number * times * 100) / 100), r"\.?0+$", "")
    return F.when(number.isNull() | (times == 1), text).otherwise(F.concat_ws(" ", shown, F.nullif(part(5), F.lit(""))))
