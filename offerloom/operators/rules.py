"""An ordered, explainable rule set: the first layer that decides wins, and within it the first rule and token.

Rules are data (Book). Products are made distinct; one pass of an automaton over name, brand and caption and a lookup of the path's nodes tell the first hit
of every table (first_hits); the layers themselves are column expressions over these hits, so nothing is joined and nothing shuffled but the distinct products.
Every layer has a verdict: decided, no_match, or skipped with a reason. `classify` and `explain` share them, so they can't disagree.
"""

from __future__ import annotations

import functools
import re
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from offerloom.operators.multimatch import Automaton, matching_pairs, shared

FOOD_ROOT = "food"
#: Numbers and names of the layers, in their order of precedence, and of the redirect.
LAYERS = {"0": "vegan", "1": "nonfood", "2": "form", "2b": "caption", "3": "node", "4": "brand", "5": "flavour", "6": "keyword", "7": "fallback"}
REDIRECT = "R"
#: Beginnings of words that mark organic and plant-based products.
ORGANIC = ("bio", "öko", "oeko", "organic", "bioland", "demeter", "naturland", "alnatura", "dennree")
VEGAN = (
    "vegan", "pflanzlich", "vemondo", "vemodo", "like meat", "likemeat", "like döner", "next level", "garden gourmet", "beyond meat", "vivera", "endori", "veganz", "alpro", "taifun", "planted", "heura", "simply v", "oatly", "vly",
    "violife", "myvay", "berief",
)
#: What may stand before such a mark: for organic ones neither a letter nor a digit, for plant-based ones no letter.
NO_LETTER_OR_DIGIT, NO_LETTER = "0-9a-zäöüß", "a-zäöüß"
#: Tables of tokens by the text that they are looked up in: padded name and brand, padded caption, bare caption.
IN_NAME, IN_CAPTION = ("rescue", "rescue_veto", "aisle_veto", "aisle", "form", "flavour", "keyword"), ("caption",)
#: Tables whose entries are nodes of the path.
AT_NODE = ("aisle_node", "node")


class Book(NamedTuple):
    """A set of rules as data: table -> ordered rules (slug, tokens). Tables: rescue, aisle_node, aisle, form, caption, node, brand, flavour, keyword."""

    rules: dict[str, list[tuple[str, list[str]]]]
    vegan: tuple[str, ...] = VEGAN  # beginnings of words in name and brand
    rescue_veto: tuple[str, ...] = ()  # words that keep a product from being rescued as food; aisles don't mind them
    aisle_veto: tuple[str, ...] = ()  # words that keep a product out of the aisles
    preserved: tuple[str, ...] = ()  # caption words that make fruits and vegetables pantry goods
    fresh: tuple[str, ...] = ("fruits", "vegetables")
    pantry: str = "pantry"
    household: str = "household"
    other: str = "other"

    def tables(self) -> dict[str, list[tuple[str | None, list[str]]]]:
        """Every table with its rules, those without a slug too."""
        return {**self.rules, "rescue_veto": [(None, [v]) for v in self.rescue_veto], "aisle_veto": [(None, [v]) for v in self.aisle_veto], "preserved": [(self.pantry, list(self.preserved))]}

    def rows(self) -> list[tuple]:
        """(kind, rule, tok, token, slug) of every token."""
        return [(kind, r, t, token, slug) for kind, rules in self.tables().items() for r, (slug, tokens) in enumerate(rules) for t, token in enumerate(tokens)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "kind string, rule int, tok int, token string, slug string")


def begins_word(text: Column, marks: tuple[str, ...], not_after: str = NO_LETTER_OR_DIGIT) -> Column:
    """One of the marks stands in the lower-case text, not after one of these characters."""
    return text.rlike(f"(?:^|[^{not_after}])(?:" + "|".join(re.escape(m) for m in marks) + ")") if marks else F.lit(False)


def holds_any(text: Column, tokens: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in tokens), F.lit(False))


TABLES = (*IN_NAME, *IN_CAPTION, *AT_NODE, "brand", "preserved")
HITS = "struct<" + ",".join(f"{t}:struct<rule:int,slug:string,token:string,place:string>" for t in TABLES) + ">"
_HITS = pa.struct([(t, pa.struct([("rule", pa.int32()), ("slug", pa.string()), ("token", pa.string()), ("place", pa.string())])) for t in TABLES])


class _Hits:
    """The first hit of every table in a product's texts. What is in place is named after where it was found."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        of = lambda kinds: Automaton([(i, r[3]) for i, r in enumerate(rows) if r[0] in kinds])
        self.name, self.caption, self.bare, self.brand = of(IN_NAME + ("brand",)), of(IN_CAPTION), of(("preserved",)), of(("brand",))
        self.nodes = {kind: {r[3]: i for i, r in reversed(list(enumerate(rows))) if r[0] == kind} for kind in AT_NODE}

    def __call__(self, hay: str, brand: str, caption: str | None, path: list[str | None] | None) -> dict[str, dict]:
        first: dict[str, tuple[int, str, str]] = {}

        def see(found: list[int], place: str) -> None:  # rows stand in the order of their tables, so the smallest number is a table's first
            for i in found:
                kind = self.rows[i][0]
                if kind not in first or i < first[kind][0]:
                    first[kind] = (i, place, self.rows[i][3])

        see(self.brand.found(brand), "brand_field")
        see(self.name.found(hay), "name_text")
        if caption:
            see(self.caption.found(f" {caption} "), "caption")
            see(self.bare.found(caption), "caption")
        for kind, known in self.nodes.items():
            for node in reversed(path or []):
                if node is not None and (i := known.get(node.strip().lower())) is not None:
                    first[kind] = (i, "path", node)
                    break
        return {kind: {"rule": None if kind in AT_NODE else self.rows[i][1], "slug": self.rows[i][4], "token": token, "place": place} for kind, (i, place, token) in first.items()}


@functools.lru_cache(maxsize=4)
def _hits_of(rows) -> _Hits:
    """A worker's automata of a broadcast book, built once."""
    return _Hits(rows.value)


def first_hits(spark: SparkSession, book: Book) -> Column:
    """HITS: the first hit of each table, of columns _hay, _brand, _caption and path; null where a table has none."""
    rows = shared(spark, book.rows())

    @F.arrow_udf(_parse_datatype_string(HITS))
    def run(hay: pa.Array, brand: pa.Array, caption: pa.Array, path: pa.Array) -> pa.Array:
        find = _hits_of(rows)
        return pa.array([find(*own) for own in zip(hay.to_pylist(), brand.to_pylist(), caption.to_pylist(), path.to_pylist())], _HITS)

    return run("_hay", "_brand", "_caption", "path")


LAYER = "struct<layer:string,name:string,status:string,slug:string,table:string,rule:int,matched:string,place:string,reason:string,blocked_slug:string>"
_FIELDS = {"slug": "string", "table": "string", "rule": "int", "matched": "string", "place": "string", "reason": "string", "blocked_slug": "string"}


def _layer(number: str, status: str, **fields: Column | str) -> Column:
    """One verdict; fields that aren't given are null."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    rest = [as_column(fields.get(k)).cast(kind).alias(k) for k, kind in _FIELDS.items()]
    return F.struct(F.lit(number).alias("layer"), F.lit(LAYERS.get(number, "preserved")).alias("name"), F.lit(status).alias("status"), *rest)


def _hit(kind: str) -> Column:
    return F.col(f"_hits.{kind}")


def _by(number: str, kind: str, **more: Column | str) -> Column:
    h = _hit(kind)
    return _layer(number, "decided", **({"slug": h["slug"], "table": kind, "rule": h["rule"], "matched": h["token"], "place": h["place"]} | more))


def _tokens(number: str, place: str | None) -> Column:
    kind = LAYERS[number]
    return F.when(_hit(kind).isNotNull(), _by(number, kind)).otherwise(_layer(number, "no_match", place=place))


def _layers(book: Book, only: list[str] | None) -> Column:
    """All verdicts in order."""
    raw = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("brand", F.lit("")))
    mark = F.regexp_extract(raw, f"(?iu)(?<![{NO_LETTER}])(" + "|".join(map(re.escape, book.vegan)) + ")", 1) if book.vegan else F.lit("")
    no_path = F.coalesce(F.size("path"), F.lit(0)) <= 0
    food = F.coalesce(F.trim(F.lower(F.get("path", F.lit(0)))), F.lit("")) == FOOD_ROOT
    rescue, veto = _hit("rescue"), _hit("rescue_veto")
    no_aisle = _hit("aisle_veto").isNotNull()
    nonfood = (
        F.when(no_path, _layer("1", "skipped", reason="no_category_path")).when(food, _layer("1", "skipped", reason="path_is_food_root")).when(rescue.isNotNull() & veto.isNull(), _by("1", "rescue"))
        .when(~no_aisle & _hit("aisle_node").isNotNull(), _by("1", "aisle_node")).when(~no_aisle & _hit("aisle").isNotNull(), _by("1", "aisle"))
        .when(veto.isNotNull(), _by("1", "rescue_veto", slug=book.household, rule=None, reason="rescue_veto", blocked_slug=rescue["slug"])).otherwise(_layer("1", "decided", slug=book.household, reason="no_rescue_token"))
    )
    of = {
        "0": F.when(mark != "", _layer("0", "decided", slug="vegan", matched=mark, place="name_brand_raw")).otherwise(_layer("0", "no_match", place="name_brand_raw")), "1": nonfood, "2": _tokens("2", "name_text"),
        "2b": F.when(F.coalesce("_caption", F.lit("")) == "", _layer("2b", "skipped", reason="no_unit")).otherwise(_tokens("2b", "caption")), "3": F.when(no_path, _layer("3", "skipped", reason="no_category_path")).otherwise(_tokens("3", "path")),
        "4": _tokens("4", None), "5": _tokens("5", "name_text"), "6": _tokens("6", "name_text"), "7": _layer("7", "decided", slug=book.other, reason="fallback"),
    }
    return F.array(*[v if only is None or LAYERS[n] in (*only, "fallback") else _layer(n, "no_match") for n, v in of.items()]).cast(f"array<{LAYER}>")


_KEY = ["name", "brand", "path", "caption"]


def winner(layers: Column) -> Column:
    """The first layer that decided."""
    return F.get(F.filter(layers, lambda x: x["status"] == "decided"), F.lit(0))


def later(layers: Column) -> Column:
    """Layers that decided after the winner: what would be said without it."""
    decided = F.filter(layers, lambda x: x["status"] == "decided")
    return F.slice(decided, F.lit(2), F.greatest(F.size(decided), F.lit(1)))


def address(layer: Column) -> Column:
    """Where the rule of a layer stands: `form[3]`, `node`; null without a table."""
    return F.when(layer["table"].isNotNull(), F.concat(layer["table"], F.when(layer["rule"].isNotNull(), F.concat(F.lit("["), layer["rule"].cast("string"), F.lit("]"))).otherwise("")))


def explain(products: DataFrame, book: Book, kinds: list[str] | None = None) -> DataFrame:
    """(name, brand, path, caption, slug, layers, redirect) of each distinct product: every layer's verdict in order, and the redirect if one holds.

    slug is that of the first layer that decided, or the redirect's: fruits and vegetables whose caption names a preserved form go to the pantry. Layers
    not among `kinds`, if given, match nothing.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    rows = products.select(*_KEY).distinct().withColumns({"_hay": F.concat(F.lit(" "), low("name"), F.lit(" "), low("brand"), F.lit(" ")), "_brand": low("brand"), "_caption": F.lower("caption")})
    rows = rows.withColumn("_hits", first_hits(products.sparkSession, book)).withColumn("layers", _layers(book, kinds))
    won = winner(F.col("layers"))["slug"]
    rows = rows.withColumn("redirect", F.when(won.isin(*book.fresh) & _hit("preserved").isNotNull(), _by(REDIRECT, "preserved", slug=book.pantry, rule=None, blocked_slug=won)).cast(LAYER))
    return rows.select(*_KEY, F.coalesce(F.col("redirect.slug"), won).alias("slug"), "layers", "redirect")


def classify(products: DataFrame, book: Book, kinds: list[str] | None = None) -> DataFrame:
    """(name, brand, path, caption, slug, layer, token) of each distinct product: explain()'s answer, the name of the layer that won and what it matched."""
    won = winner(F.col("layers"))
    return explain(products, book, kinds).select(*_KEY, "slug", won["name"].alias("layer"), won["matched"].alias("token"))


def stale(products: DataFrame, book: Book, stored: str) -> DataFrame:
    """(was, now, n): how many rows' stored category differs from what the rules say."""
    now = classify(products, book).select(*[F.col(c).alias(f"_{c}") for c in _KEY], "slug")
    same = [products[c].eqNullSafe(now[f"_{c}"]) for c in _KEY]
    rows = products.join(now, same)
    return rows.where(F.col(stored) != F.col("slug")).groupBy(F.col(stored).alias("was"), F.col("slug").alias("now")).agg(F.count("*").alias("n"))


def sub_group(name: Column, category: Column, groups: dict[str, list[tuple[str, str, list[str]]]]) -> Column:
    """struct<slug, label>: the first sub-group of the category, in its order, of which a keyword stands in the lower-case name; null if none."""
    kind = "struct<slug:string,label:string>"
    out = F.lit(None).cast(kind)
    for c, own in reversed(groups.items()):
        inner = F.lit(None).cast(kind)
        for slug, label, tokens in reversed(own):
            inner = F.when(holds_any(F.lower(name), tuple(tokens)), F.struct(F.lit(slug).alias("slug"), F.lit(label).alias("label"))).otherwise(inner)
        out = F.when(category == c, inner).otherwise(out)
    return out


def organic(name: Column, brand: Column, marks: tuple[str, ...] = ORGANIC) -> Column:
    """Whether a word of name or brand begins like an organic mark."""
    return F.coalesce(begins_word(F.lower(F.concat_ws(" ", name, brand)), marks), F.lit(False))


def plant_based(name: Column, brand: Column, marks: tuple[str, ...] = VEGAN) -> Column:
    """Whether a plant-based mark stands in name or brand, not after a letter."""
    return F.coalesce(begins_word(F.lower(F.concat_ws(" ", name, brand)), marks, NO_LETTER), F.lit(False))


def shadowed(rules: DataFrame) -> DataFrame:
    """(kind, token, slug, earlier_token, earlier_slug): tokens that never decide, as an earlier rule of another slug of their table holds a part of them.

    rules: kind, rule, tok, token, slug. Tokens are looked up in each other by one automaton.
    """
    later = rules.where("slug is not null and token <> ''").select("kind", "rule", "token", "slug").distinct()
    wanted = later.select(F.col("kind").alias("_kind"), F.col("rule").alias("_rule"), F.col("token").alias("earlier_token"), F.col("slug").alias("earlier_slug"), F.array("token").alias("_want"), F.expr("cast(array() as array<string>)").alias("_not"))
    found = matching_pairs(later, "token", wanted, ["_kind", "_rule", "earlier_token", "earlier_slug"])
    return found.where("kind = _kind and _rule < rule and slug <> earlier_slug").select("kind", "token", "slug", "earlier_token", "earlier_slug")


def compact(explained: DataFrame) -> DataFrame:
    """explain() with `trace`, a JSON text of it: nulls go, layers lose their name and those that didn't decide their place, an empty path goes; a redirect is told too."""
    brief = lambda x: F.struct(*[(F.when(x["status"] == "decided", x["place"]) if c == "place" else x[c]).alias(c) for c in ("layer", "status", *_FIELDS)])
    inputs = F.struct(F.when(F.size("path") > 0, F.col("path")).alias("category_path"))
    redirect = F.when(F.col("redirect").isNotNull(), brief(F.col("redirect")))
    return explained.withColumn("trace", F.to_json(F.struct(F.col("slug").alias("category"), inputs.alias("inputs"), F.transform("layers", brief).alias("layers"), redirect.alias("redirect"))))
