"""Scalar functions: texts built from a grammar, whose parts say what must come out, and single values."""

import itertools
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from offerloom.functions import pricing as pr
from offerloom.functions import text as tx
from offerloom.functions.geo import haversine
from offerloom.functions.validity import day_limited, offer_window, valid_days, week_end


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return row.select(column.alias("r")).first()["r"]


def agree(spark, column, cases, schema):
    """column gives the last field of every case from the others."""
    wrong = spark.createDataFrame([(*c,) for c in cases], schema + ", want string").withColumn("got", column.cast("string")).where(~F.col("got").eqNullSafe(F.col("want"))).collect()
    assert not wrong, wrong[:5]


#: Numbers as written, and their value.
NUMBERS = [(f"{whole}{sep}{part}" if part else str(whole), Decimal(f"{whole}.{part or 0}")) for whole in (0, 4, 31, 720) for sep in ".," for part in ("", "6", "09")]
AXES = [(word, axis) for axis, words in {"kg": ("kg", "KG", "Kg"), "l": ("l", "L")}.items() for word in words]
GAPS = ["", " ", "  "]


def cents(value):
    return str(int((value * 100).quantize(Decimal(1)))) if value > 0 else None


def test_unit_price_of_every_statement(spark):
    cases = [(f"{a}1{a}{word}{a}={a}{text}{b}", cents(value)) for (text, value), (word, _), a, b in itertools.product(NUMBERS, AXES, GAPS, ("", "/9", " ?"))]
    cases += [(f"{text}{a}{sign}{a}/{a}{word}", cents(value)) for (text, value), (word, _), a, sign in itertools.product(NUMBERS, AXES, GAPS, ("", "€"))]
    cases += [(f"{n} {word} = {text}", None) for (text, _), n, word in itertools.product(NUMBERS, (1, 10), ("m", "Tab", "kgm"))] + [(f"1 {word} = -{text}", None) for (text, _), (word, _) in itertools.product(NUMBERS, AXES)] + [(None, None), ("", None)]
    agree(spark, pr.unit_price_cents("text"), cases, "text string")


def wrapped(text, layers, gap):
    for _ in range(layers):
        text = f"({gap}{text}{gap})"
    return gap + text


def test_stated_prices_take_one_form_and_keep_it(spark):
    """A statement is an optional 1, a unit, a number and what follows it; labels stand for the price itself."""
    cases = []
    for (text, _), (word, one_), layers, tail in itertools.product(NUMBERS, [("kg", ""), ("KG", "1"), ("l", "1 "), ("Liter", ""), ("liter", "1 ")], (0, 1, 3), ("", " netto", " / 2")):
        unit = "l" if word.lower() == "liter" else word
        cases.append((wrapped(f"{one_}{word} = {text}{tail}", layers, " " * (layers % 2)), 7, f"1 {unit} = {text}"))
    cases += [(wrapped(f"kg = {form}", layers, ""), 7, f"1 kg = {out}") for layers in (0, 2) for form, out in (("-.37", "0.37"), ("-,4", "0,4"), ("8:15", "8.15"), ("6.-", "6.-"), ("12,-", "12,-"))]
    for label, price, layers in itertools.product(("kg-Preis", "KG Preis", "kgpreis", "100-g-Preis", "100 g Preis"), (0, 9, 45, 1234), (0, 1)):
        value = price * (1 if label.lower().startswith("kg") else 10)
        cases.append((wrapped(label, layers, " "), price, f"1 kg = {value // 100}.{value % 100:02}" if price else None))
        cases.append((f"{label} = 3,1", price, f"{'1 kg' if label.lower().startswith('kg') else '100 g'} = 3,1"))
    cases += [(t, 5, out) for t, out in (("()", None), ("( )", None), ("", None), (None, None), ("((x)", "(x"), ("1 m = 2", "1 m = 2"), ("kg = teuer", "kg = teuer"))]
    agree(spark, pr.normal_per_unit("text", "price"), cases, "text string, price long")
    again = [(out, price, out) for _, price, out in cases if out]
    agree(spark, pr.normal_per_unit("text", "price"), again, "text string, price long")


#: Words for measures, and how many thousandths of a kilogram or litre they are.
MEASURES = {"g": (1, "kg"), "kg": (1000, "kg"), "ml": (1, "l"), "cl": (10, "l"), "l": (1000, "l"), "Liter": (1000, "l"), "KG": (1000, "kg")}


def test_prices_are_derived_from_one_quantity_only(spark):
    cases = []
    for (text, value), measure, (before, joint, behind), price in itertools.product(NUMBERS, MEASURES, (("", "", ""), ("Glas ", " ", ""), ("", "-", "-Eimer"), ("Sorte A ", " ", " im Karton")), (3, 499)):
        thousandths, axis = MEASURES[measure]
        out = None
        if value > 0:
            per = (Decimal(price) * 1000 / (value * thousandths)).quantize(Decimal(1), ROUND_HALF_EVEN)
            out = f"1 {axis} = {per // 100}.{per % 100:02}" if per > 0 else None
        cases.append((f"{before}{text}{joint}{measure}{behind}", price, out))
        for trap in ("2 x @", "6×@", "ca. @", "Circa @", "5-@", "5 – @", "1/@", "@ + @", "@, 9 Stück", "9 St @"):
            if joint != "-":
                cases.append((trap.replace("@", f"{text}{joint}{measure}"), price, None))
    cases += [(f"{k} {word}", 99, None) for k in (1, 8) for word in ("Stück", "Stk.", "St")] + [("lose", 99, None), ("", 99, None), (None, 99, None), ("2 kg", 0, None)]
    cases += [(f"{a} 1 {word}={text} 3 g", 99, f"1 {word.lower()} = {text}") for (text, _), (word, _), a in itertools.product(NUMBERS, AXES, ("", "reif,"))]
    agree(spark, pr.derived_per_unit("text", "price"), cases, "text string, price long")


def test_a_shown_price_is_a_short_formula(spark):
    """Parts that are named several times are computed once: written out, the formula has hundreds of patterns and isn't compiled."""
    shown = spark.createDataFrame([], "a string, b string, c long").select(pr.unit_price_cents(pr.served_per_unit("a", "b", "c")))
    assert shown._jdf.queryExecution().analyzed().toString().count("regexp_") < 100


def test_base_prices_and_money(spark):
    amounts = [(f"{n:,}".replace(",", ".") if dots else str(n), c, n * 100 + c) for n in (0, 7, 64, 3210) for dots in (True, False) for c in (0, 5, 60)]
    money = [(f"{a}{n},{c:02}{b}", str(v)) for (n, c, v), a, b in itertools.product(amounts, ("", "nur "), ("", " €"))] + [("gratis", None), ("5", None), ("5.10", None), (None, None)]
    agree(spark, pr.money_cents("text"), money, "text string")
    units = {"g": ("kg", 1000), "ml": ("l", 1000), "l": ("l", 1), "kg": ("kg", 1), "St": ("St", 1), "Wl": ("Wl", 1)}
    base = []
    for (n, c, v), unit, gap in itertools.product(amounts, units, GAPS):
        axis, times = units[unit]
        base.append((f"3 {unit} ({gap}{n},{c:02} € je 1 {unit}{gap})", f"1 {axis} = {v * times // 100}.{v * times % 100:02}"))
    agree(spark, pr.base_unit_price("text"), [*base, ("2,10 € je 1 l", None), ("(2,10 € je 2 l)", None), (None, None)], "text string")


def test_discount_is_half_even_on_the_exact_ratio(spark):
    cases = []
    for price, regular in itertools.product((0, 5, 98, 151, 999, 1999), (None, 0, 5, 147, 260, 1000, 2000, 1600)):
        out = None
        if regular and price < regular:
            out = (Decimal(1000) * (regular - price) / regular).quantize(Decimal(1), ROUND_HALF_EVEN) / 10
        cases.append((price, regular, None if out is None else str(float(out))))
    agree(spark, pr.discount_pct(F.col("price"), F.col("regular")), cases, "price long, regular long")


@pytest.mark.parametrize("text,out", [("MÖHRE", "mohre"), ("Weißbier", "weissbier"), ("Café Crème", "cafe creme"), (None, "")])
def test_fold(spark, text, out):
    assert one(spark, tx.fold(F.lit(text).cast("string"))) == out


def test_name_keys_differ_on_purpose(spark):
    assert one(spark, tx.norm_name(F.lit("Rod's Chips"))) == "rod s chips"
    assert one(spark, tx.name_key(F.lit("Rod's Chips"))) == "rods chips" == one(spark, tx.name_key(F.lit("Rod’s  CHIPS")))
    assert one(spark, tx.norm_name(F.lit("ROSÉ Mild"))) == "ros mild"
    assert one(spark, tx.name_key(F.lit("ROSÉ Mild"))) == "rosé mild"
    assert one(spark, tx.name_key(F.lit("Birne »Conf«, Kl. II"))) == "birne conf"


def test_json_strings_drops_what_is_not_text(spark):
    assert one(spark, tx.json_strings(F.lit('["a", 1, null, {"b": 2}, "c"]'))) == ["a", "c"]
    assert one(spark, tx.json_strings(F.lit("{broken"))) is None


def test_scale_quantity(spark):
    forms = {"¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "3/8": 0.375, "6": 6, "1,25": 1.25, "0.4": 0.4}
    shown = lambda v: f"{v + 1e-9:.2f}".rstrip("0").rstrip(".")
    cases = [(f"{a}{form}{gap}{rest}", times, f"{shown(value * times)} {rest}".strip()) for (form, value), times, a, gap, rest in itertools.product(forms.items(), (2, 5), ("", "  "), ("", " "), ("", "EL Mehl"))]
    cases += [(f"{form}  EL", 1, f"{form}  EL") for form in forms] + [("etwas", 4, "etwas"), (None, 4, None)]
    agree(spark, tx.scale_quantity("text", F.col("times")), cases, "text string, times int")


def test_validity(spark):
    d = lambda x: F.lit(x).cast("date")
    assert one(spark, valid_days(d("2026-06-25"), d("2026-06-27"))) == "Do–Sa"
    assert one(spark, valid_days(d("2026-06-26"), d("2026-06-26"))) == "Fr"
    assert one(spark, day_limited(d("2026-06-22"), d("2026-06-27"))) is False
    assert one(spark, day_limited(d("2026-06-27"), d("2026-06-22"))) is False
    assert one(spark, day_limited(d(None), d("2026-06-22"))) is False
    assert str(one(spark, week_end(d("2026-06-28")))) == "2026-06-28"
    assert str(one(spark, week_end(d("2026-06-22")))) == "2026-06-28"


def test_offer_window_crosses_midnight(spark):
    at = lambda x: F.to_timestamp(F.lit(x))
    w = F.array(F.struct(at("2026-06-24 22:00:00").alias("start"), at("2026-06-27 22:00:00").alias("end")))
    got = one(spark, offer_window(w, F.lit("2026-06-22").cast("date"), F.lit("2026-06-28").cast("date")))
    assert (str(got["valid_from"]), str(got["valid_to"])) == ("2026-06-25", "2026-06-27")


def test_haversine(spark):
    assert 100 < one(spark, haversine(*[F.lit(x) for x in (52.5, 13.4, 52.501, 13.4)])) < 125


def test_app_deal(spark):
    deal = lambda *v: tuple(one(spark, pr.app_deal(*[F.lit(x).cast("long") for x in v], F.lit(7.5))))
    assert deal(200, 250, 150) == (True, 150, 250, 40.0) and deal(200, None, 150) == (True, 150, 200, 25.0) and deal(200, 250, 200) == (False, 200, 250, 7.5) and deal(200, None, None) == (False, 200, None, 7.5)
    assert deal(200, 140, 150) == (True, 150, 140, None)


def test_instants(spark):
    from offerloom.functions.validity import instant

    micros = lambda t: one(spark, F.unix_micros(instant(F.lit(t).cast("string"))))
    true = micros("2026-03-01T10:00:00Z")
    assert true and {micros(t) for t in ("2026-03-01T10:00:00+0000", "2026-03-01T12:00:00+02:00", "2026-03-01T05:00:00-0500", "2026-03-01T10:00:00")} == {true}
    assert {micros(t) for t in ("soon", "", "2026-13-01T00:00:00Z", None)} == {None}
