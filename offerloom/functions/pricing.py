"""Prices: discounts, unit prices, German money, app deals. Money is integer cents; doubles appear only at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_even(top: Column, bottom: Column) -> Column:
    """top / bottom rounded half to even, in integers (both positive)."""
    twice = 2 * (top % bottom)
    whole = ((top - top % bottom) / bottom).cast("long")
    return whole + F.when((twice > bottom) | ((twice == bottom) & (whole % 2 == 1)), 1).otherwise(0)


def discount_pct(price: Column, regular: Column) -> Column:
    """Per cent off, to one decimal (half even on the exact ratio); null unless regular > price and regular > 0.

    The prices stand in it as few times as can be, for a filter on it gets them copied in, and the JVM doesn't compile a long method. 16 places tell a half from any other ratio of prices below 5e15.
    """
    tenths = F.bround((1000 * (regular - price)).cast("decimal(20,0)") / regular.cast("decimal(19,0)"))
    return F.when((price < regular) & (regular > 0), tenths.cast("double") / F.lit(10.0))


#: How the feeds write units, quantities and numbers.
NUMBER = r"\d+(?:[.,]\d+)?"
_PER_ONE = rf"^1\s*(?:kg|l)\b.*?=\s*(-?{NUMBER})"
_PER_SLASH = rf"(-?{NUMBER})\s*€?\s*/\s*(?:kg|l)\b"
_LABEL = r"(?i)^(kg|100\s*-?\s*g)\s*-?\s*preis\s*(?:=\s*(.+))?$"
_BARE = r"(?i)^(?:1\s*)?(kg|liter|l)\s*=\s*(.+)$"
_INLINE = rf"(?i)\b1\s*(kg|l)\s*=\s*({NUMBER})"
_QUANTITY = rf"(?iuU)({NUMBER})\s*-?\s*(kg|g|ml|cl|liter|l|stück|stk|st)\b"
_UNSAFE = rf"(?iuU)\d\s*[x×]\s*\d|\bca\.?\b|\bcirca\b|{NUMBER}\s*[-–/]\s*\d"
#: Millionths of a kilogram or litre in one of each unit.
_MILLIONTHS = {"kg": 1_000_000, "g": 1_000, "l": 1_000_000, "liter": 1_000_000, "cl": 10_000, "ml": 1_000}


def _once(value: Column, form: Callable[[Column], Column]) -> Column:
    """form(value), with the value computed once: however often the form names it, the expression doesn't grow by it. An aggregate over no elements starts from the value and ends with the form."""
    return F.aggregate(F.array(), value, lambda v, _: v, form)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _number(text: Column, kind: str) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast(kind)


def unit_price_cents(text: Column | str) -> Column:
    """Cents for a kilogram or litre from `1 kg = 1.33` (of a range the first value) or `1.33 €/kg`, in any case; null if neither, or not above zero."""

    def stated(low: Column) -> Column:
        return _number(_once(F.regexp_extract(low, _PER_ONE, 1), lambda one: F.when(one != "", one).otherwise(F.regexp_extract(low, _PER_SLASH, 1))), "double")

    value = _once(F.lower(_stripped(_c(text))), stated)
    return _once(value, lambda v: F.when(v > 0, F.bround(v * 100).cast("long")))


def euros(cents: Column) -> Column:
    """1234 as 12.34."""
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def _unwrapped(text: Column) -> Column:
    """Without the parentheses around the whole text, however many: as many as stand both at its start and at its end."""
    run = lambda pattern, other: F.length(F.regexp_replace(F.regexp_extract(text, pattern, 0), other, ""))
    layers = F.when(F.contains(text, F.lit("\n")), 0).otherwise(F.least(run(r"^[(\s]*", r"[^(]"), run(r"[)\s]*$", r"[^)]")))
    inner = F.aggregate(F.sequence(F.lit(1), layers), text, lambda x, _: _stripped(F.substring(x, F.lit(2), F.length(x) - 2)))
    return F.when(F.startswith(text, F.lit("(")) & (layers > 0), inner).otherwise(text)


def normal_per_unit(text: Column | str, price: Column | str) -> Column:
    """The stated price per unit in one form, `1 kg = 1.33`; a second pass changes nothing.

    Labels without a value are rebuilt from the price (null without one), bare units get their 1, `-.90` is 0.90, `1:75` is 1.75, and
    what follows the number goes. Other texts pass as they are.
    """
    price = _c(price)

    def rebuilt(x: Column) -> Column:
        def by_label(label: Column) -> Column:
            value, kilo = _stripped(F.regexp_extract(x, _LABEL, 2)), label.startswith("kg")
            own = _once(value, lambda v: F.when(v != "", F.concat(F.when(kilo, "1 kg = ").otherwise("100 g = "), v)).when(price > 0, F.concat(F.lit("1 kg = "), euros(F.when(kilo, price).otherwise(price * 10)))))
            return F.when(label != "", own).otherwise(x)

        return _once(F.lower(F.regexp_extract(x, _LABEL, 1)), by_label)

    def with_one(x: Column) -> Column:
        unit = F.regexp_extract(x, _BARE, 1)
        rest = F.regexp_replace(_stripped(F.regexp_extract(x, _BARE, 2)), r"(?<=\d):(?=\d)", ".")
        one = lambda number: F.when(number != "", F.concat(F.lit("1 "), F.when(F.lower(unit) == "liter", "l").otherwise(unit), F.lit(" = "), number)).otherwise(x)
        return _once(F.regexp_extract(rest, rf"^-?{NUMBER}(?:[.,]-)?", 0), one)

    x = _once(_once(_stripped(_c(text)), _unwrapped), rebuilt)
    x = F.regexp_replace(x, r"(?<![\d)])-(?=[.,]\d)", "0")
    return F.nullif(_once(x, with_one), F.lit(""))


def derived_per_unit(unit: Column | str, price: Column | str) -> Column:
    """A price per kilogram or litre: the one that the unit text holds, else by exactly one quantity in it; null for packs, ranges, estimates and pieces."""
    price = _c(price)

    def counted(text: Column) -> Column:
        kind = F.lower(F.regexp_extract(text, _QUANTITY, 2))
        millionths = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for pair in _MILLIONTHS.items() for x in pair]), k)
        amount = lambda k: F.round(_number(F.regexp_extract(text, _QUANTITY, 1), "decimal(18,6)") * millionths(k)).try_cast("long")
        said = lambda k: _once(_once(amount(k), lambda a: F.when(a > 0, half_even(price * 1_000_000, a))), lambda cents: F.when(cents > 0, F.concat(F.lit("1 "), F.when(k.isin("kg", "g"), "kg").otherwise("l"), F.lit(" = "), euros(cents))))
        single = ~text.rlike(_UNSAFE) & (F.size(F.regexp_extract_all(text, F.lit(_QUANTITY), F.lit(0))) == 1)
        inline = F.concat(F.lit("1 "), F.lower(F.regexp_extract(text, _INLINE, 1)), F.lit(" = "), F.regexp_extract(text, _INLINE, 2))
        return F.when(text.rlike(_INLINE), inline).when(single, _once(kind, said))

    return F.when(price > 0, _once(_stripped(_c(unit)), counted))


def served_per_unit(text: Column | str, unit: Column | str, price: Column | str) -> Column:
    """What is shown: the stated price per unit, else a derived one."""
    return F.coalesce(normal_per_unit(text, price), derived_per_unit(unit, price))


def money_cents(text: Column | str) -> Column:
    """Cents from German money text: `1.234,56 €` is 123456; null without one."""
    text = _c(text)
    digits = F.regexp_extract(text, r"(\d{1,3}(?:\.\d{3})+|\d+),(\d{2})", 1)
    cents = F.regexp_extract(text, r"(\d{1,3}(?:\.\d{3})+|\d+),(\d{2})", 2)
    return F.concat(F.replace(digits, F.lit("."), F.lit("")), cents).try_cast("long")


def base_unit_price(text: Column | str) -> Column:
    """`0,5 l (1,98 € je 1 l)` as `1 l = 1.98`; prices of a gram or millilitre become those of a kilogram or litre, other units stay as written."""
    inside = r"(?iuU)\(\s*(\d{1,3}(?:\.\d{3})*|\d+),(\d{2})\s*€\s*je\s+1\s+(\w+)\s*\)"
    part = lambda n: F.regexp_extract(_c(text), inside, n)
    cents, unit = F.concat(F.replace(part(1), F.lit("."), F.lit("")), part(2)).try_cast("long"), F.lower(part(3))
    times, axis = F.when(unit.isin("g", "ml"), 1000).otherwise(1), F.when(unit == "g", "kg").when(unit == "ml", "l").otherwise(part(3))
    return F.concat(F.lit("1 "), axis, F.lit(" = "), euros(cents * times))


def app_deal(price: Column, regular: Column, app: Column, stated: Column) -> Column:
    """struct<has_deal, headline_cents, strike_cents, headline_pct>: the app price heads if it is lower than the price, and its discount is the one from the regular price, else from the price; without an app deal the stated discount holds."""
    has = F.coalesce(app < price, F.lit(False))
    head = F.when(has, app).otherwise(price)
    strike = F.when(has, F.coalesce(regular, price)).otherwise(regular)
    pct = F.when(has, F.when(strike > head, F.floor((strike - head) * 100 / strike + 0.5).cast("double"))).otherwise(stated)
    return F.struct(has.alias("has_deal"), head.alias("headline_cents"), strike.alias("strike_cents"), pct.alias("headline_pct"))
