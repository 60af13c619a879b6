"""Filters over offers. Each takes a DataFrame and returns one, for use with transform()."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.text import fold, norm_name
from offerloom.functions.validity import valid_on, week_end

#: Sections of the shop: its chains, and the categories it shows or leaves out.
VERTICALS = {
    "grocery": {"chains": ("north", "south", "east", "west", "harbor"), "without": ("drinks",)},
    "drinks": {"chains": ("north", "south", "east", "west", "harbor"), "only": ("drinks",)},
    "drugstore": {"chains": ("garden",)},
}


def equal_to(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal the given values; None doesn't filter."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def in_vertical(name: str) -> Column:
    """The predicate of a section; an unknown one is an error."""
    if name not in VERTICALS:
        raise ValueError(f"unknown vertical {name!r}; known: {sorted(VERTICALS)}")
    spec = VERTICALS[name]
    test = F.col("chain").isin(*spec["chains"])
    if "only" in spec:
        test = test & F.col("category").isin(*spec["only"])
    if "without" in spec:
        test = test & ~F.col("category").isin(*spec["without"])
    return test


def served(df: DataFrame, today: str, vertical: str = "grocery", min_discount: float | None = None, **wanted) -> DataFrame:
    """What a listing may show: equality filters, section, least discount, and the window of validity."""
    df = equal_to(df, **wanted).where(in_vertical(vertical)).where(valid_on(F.col("valid_to"), today))
    return df if min_discount is None else df.where(F.col("discount_pct") >= min_discount)


def hide_key() -> Column:
    return F.concat_ws(":", "chain", norm_name("name"))


def without_hidden(df: DataFrame, hidden: DataFrame, invert: bool = False) -> DataFrame:
    """Rows whose hide key is not (invert: is) among hidden.key."""
    keys = hidden.select(F.col("key").alias("_key")).distinct()
    return df.withColumn("_key", hide_key()).join(keys, "_key", "left_semi" if invert else "left_anti").drop("_key")


def live_hides(hidden: DataFrame, today: str) -> DataFrame:
    """Hides that still hold: until the Sunday of the week in which they were set (column since: date)."""
    return hidden.where(F.lit(today).cast("date") <= week_end(F.col("since")))


def chain_lens(df: DataFrame, chains: list[str]) -> DataFrame:
    """Keep the chosen chains that are present; if none is, or all present ones are chosen, nothing changes."""
    present = df.agg(F.collect_set("chain").alias("_present"))  # one row; chains are few
    out = df.crossJoin(F.broadcast(present))
    lens = F.array_intersect(F.array(*map(F.lit, chains)) if chains else F.expr("cast(array() as array<string>)"), F.col("_present"))
    return out.where((F.size(lens) == 0) | F.array_contains(lens, F.col("chain"))).drop("_present")


def flag_lens(df: DataFrame, flag: Column, everything: DataFrame, flag_there: Column) -> DataFrame:
    """Rows with the flag, unless no row of `everything` has it: then all."""
    any_ = everything.agg(F.coalesce(F.bool_or(flag_there), F.lit(False)).alias("_any"))
    return df.crossJoin(F.broadcast(any_)).where(~F.col("_any") | flag).drop("_any")


def search(text: str) -> Column:
    needle = fold(F.lit(text))
    return F.contains(fold("name"), needle) | F.contains(fold("brand"), needle)


def suppress_duplicates(df: DataFrame, first: str, second: str) -> DataFrame:
    """Drop the second chain's rows that the first chain offers under the same name at no higher price."""
    own = df.where(F.col("chain") == first).where(norm_name("name") != "").groupBy(norm_name("name").alias("_key")).agg(F.min("price_cents").alias("_least"))
    out = df.withColumn("_key", norm_name("name")).join(own, "_key", "left")
    return out.where((F.col("chain") != second) | F.col("_least").isNull() | (F.col("price_cents") < F.col("_least"))).drop("_key", "_least")


class Choice(NamedTuple):
    """What a shopper has set on the list."""

    show_non_food: bool = False
    show_hidden: bool = False  # only hidden offers
    hidden_stores: tuple[str, ...] = ()
    lens: tuple[str, ...] = ()  # only these chains, as far as they have anything left to show
    limited: bool = False  # only offers of some days of the week, if there are any
    organic: bool = False  # only organic ones, if there are any
    text: str | None = None  # a search text overrides the category
    category: str | None = None
    pair: tuple[str, str] = ("north", "south")  # the second chain's offers that repeat the first one's are left out


#: Steps that a row can fail, in their order.
STEPS = ("non_food", "hidden", "store", "repeated", "lens", "limited", "organic", "search")


def judged(df: DataFrame, today: str, hidden: DataFrame, choice: Choice, organic: Column) -> DataFrame:
    """df with what each step says of each row by itself: _non_food, _base and _base_shown (what is left before the lens, as chosen and with non-food shown), _limited, _organic, _found.

    What repeats an offer of the first chain depends on which of its offers are left, so the least price of a name is taken for both cases: one grouping of the first chain's rows.
    """
    first, second = choice.pair
    marked = live_hides(hidden, today).select(F.col("key").alias("_key")).distinct().withColumn("_hid", F.lit(True))
    rows = df.withColumns({"_key": hide_key(), "_name": norm_name("name"), "_non_food": F.col("category") == "household"}).join(marked, "_key", "left")
    out_of_sight = F.coalesce("_hid", F.lit(False)) == F.lit(not choice.show_hidden)
    shown = ~out_of_sight & (~F.col("chain").isin(*choice.hidden_stores) if choice.hidden_stores else F.lit(True))
    rows = rows.withColumn("_shown", shown)
    food = F.lit(choice.show_non_food) | ~F.col("_non_food")
    least = rows.where((F.col("chain") == first) & (F.col("_name") != "") & F.col("_shown")).groupBy("_name").agg(F.min(F.when(food, F.col("price_cents"))).alias("_least"), F.min("price_cents").alias("_least_shown"))
    rows = rows.join(least, "_name", "left")
    repeats = lambda price: F.coalesce((F.col("chain") == second) & (F.col("price_cents") >= F.col(price)), F.lit(False))
    found = search(choice.text.strip()) if choice.text and choice.text.strip() else F.col("category") == choice.category if choice.category else F.lit(True)
    from offerloom.functions.validity import day_limited

    return rows.withColumns({
        "_base": F.col("_shown") & food & ~repeats("_least"), "_base_shown": F.col("_shown") & ~repeats("_least_shown"),
        "_limited": day_limited(F.col("valid_from"), F.col("valid_to")), "_organic": F.coalesce(organic, F.lit(False)), "_found": F.coalesce(found, F.lit(False)),
    }).drop("_key", "_name", "_hid", "_shown", "_least", "_least_shown")


_JUDGED = ("_non_food", "_base", "_base_shown", "_limited", "_organic", "_found")


def _guards(rows: DataFrame, choice: Choice) -> DataFrame:
    """One row: the lens as far as it has something to show (as chosen, and with non-food shown), and whether any row of all is limited or organic."""
    lens = F.col("chain").isin(*choice.lens) if choice.lens else F.lit(False)
    seen = lambda base: F.collect_set(F.when(F.col(base) & lens, F.col("chain")))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.agg(seen("_base").alias("_lens"), seen("_base_shown").alias("_lens_shown"), some("_limited").alias("_any_limited"), some("_organic").alias("_any_organic"))


def _in_lens(lens: str) -> Column:
    return (F.size(lens) == 0) | F.array_contains(lens, F.col("chain"))


def filter_stack(df: DataFrame, today: str, hidden: DataFrame, choice: Choice, organic: Column) -> DataFrame:
    """All client filters in their fixed order: non-food, hidden offers, hidden stores, repeated offers, lens, limited, organic, search or category.

    Lens, limited and organic only hold if something bears them; one aggregate of one row tells.
    """
    rows = judged(df, today, hidden, choice, organic)
    guarded = rows.crossJoin(F.broadcast(_guards(rows, choice)))  # one row
    keep = F.col("_base") & _in_lens("_lens") & F.col("_found")
    keep = keep & (~F.col("_any_limited") | F.col("_limited")) if choice.limited else keep
    keep = keep & (~F.col("_any_organic") | F.col("_organic")) if choice.organic else keep
    return guarded.where(keep).select(*df.columns)


def facet_counts(df: DataFrame, today: str, hidden: DataFrame, choice: Choice, organic: Column) -> DataFrame:
    """(facet, value, rows): how many rows each option would show, its own filter set aside and all others in force.

    chain (value: the chain; chains with nothing to show have no row), limited, organic and non_food. Rows are counted once, by chain and what the steps say of them: a cube of
    at most 64 cells for each chain, from which guards and counts follow.
    """
    cube = judged(df, today, hidden, choice, organic).groupBy("chain", *_JUDGED).agg(F.count("*").alias("_n"))
    cells = cube.crossJoin(F.broadcast(_guards(cube, choice)))  # one row
    days = ~F.col("_any_limited") | F.col("_limited") if choice.limited else F.lit(True)
    green = ~F.col("_any_organic") | F.col("_organic") if choice.organic else F.lit(True)
    base, lens, found = F.col("_base"), _in_lens("_lens"), F.col("_found")
    tests = {
        "chain": base & days & green & found, "limited": base & lens & green & found & F.col("_limited"), "organic": base & lens & days & found & F.col("_organic"),
        "non_food": F.col("_base_shown") & _in_lens("_lens_shown") & days & green & found & F.col("_non_food"),
    }
    counted = F.filter(F.array(*[F.when(test, F.struct(F.lit(name).alias("facet"), (F.col("chain") if name == "chain" else F.lit(None).cast("string")).alias("value"))) for name, test in tests.items()]), lambda x: x.isNotNull())
    sums = cells.select(F.explode(counted).alias("_f"), "_n").groupBy("_f.facet", "_f.value").agg(F.sum("_n").alias("rows"))
    rest = df.sparkSession.createDataFrame([(n,) for n in tests if n != "chain"], "facet string")
    alone = rest.join(sums.where("facet <> 'chain'").select("facet", "rows"), "facet", "left").select("facet", F.lit(None).cast("string").alias("value"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))
    return sums.where("facet = 'chain'").select("facet", "value", "rows").unionByName(alone)
