"""Classification queries over parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import rules as ru
from offerloom.plans.registry import query
from offerloom.sources.tables import table


#: A small set of rules that meets every layer and every branch of the non-food one.
BOOK = ru.Book(
    {
        "rescue": [("fruits", ["widget", "gizmo"]), ("pantry", ["rod"])], "aisle_node": [("tools", ["tools"]), ("paper", ["paper"])], "aisle": [("care", ["plate"]), ("cleaning", ["anvil", "old"])],
        "form": [("frozen", [" cold "]), ("dried", ["anvil"])], "caption": [("preserves", [" dose ", "zzz"])], "node": [("hardware", ["metal"]), ("deals", ["promo"]), ("bulk", ["large"])],
        "brand": [("premium", ["brand#12"]), ("budget", ["brand#7"]), ("named", ["red g", "brand#3"])], "flavour": [("spicy", ["hot"])], "keyword": [("vegetables", ["ring"]), ("fruits", ["gizmo", "gear"]), ("bakery", ["bolt"]), ("fruits", ["blue ring"])],
    },
    vegan=("new r", "ew b"), rescue_veto=("old", "red"), aisle_veto=("small",), preserved=("glas",),
)
GROUPS = {"fruits": [("gears", "Gears", ["gear"]), ("gizmos", "Gizmos and widgets", ["gizmo", "widget"])], "bakery": [("bolts", "Bolts", ["bolt"])]}


def products(spark, sf_dir):
    """Parts with a category path and a caption made from their size, so that every layer is met."""
    size = F.col("p_size")
    path = F.when(size % 4 == 1, F.array(F.lit("food"), F.lower("p_type"))).when(size % 4 == 2, F.array(F.lit("garden"), F.lit("Tools "))).when(size % 4 == 3, F.array(F.lit("house"), F.lit("metal")))
    caption = F.when(size % 5 == 0, "in Dose").when(size % 5 == 1, "im Glas").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), path.alias("path"), caption.alias("caption"), F.lower("p_type").alias("stored"))


_ROWS = ", ".join(f"({n}, '{kind}', {rule}, {tok}, '{token}', {repr(slug) if slug else 'NULL'})" for n, (kind, rule, tok, token, slug) in enumerate(BOOK.rows()))
_ONE = {kind: f"max({{0}}) FILTER (WHERE kind = '{kind}')" for kind in ("rescue", "rescue_veto", "aisle_veto", "aisle_node", "aisle", "form", "caption", "node", "brand", "flavour", "keyword", "preserved")}
#: Fields of a verdict as the SQL writes them.
_FIELDS = ("status", "slug", "tab", "rule", "matched", "place", "reason", "blocked")


def _verdict(kind: str, place: str, slug: str = "", rule: bool = True) -> dict[str, str]:
    return {"status": "'decided'", "slug": slug or f"{kind}_slug", "tab": f"'{kind}'", "rule": f"{kind}_rule" if rule else "NULL", "matched": f"{kind}_token", "place": place, "reason": "NULL", "blocked": "NULL"}


def _choice(*branches: tuple[str, dict[str, str]], last: dict[str, str]) -> dict[str, str]:
    return {f: "CASE " + " ".join(f"WHEN {test} THEN {own.get(f, 'NULL')}" for test, own in branches) + f" ELSE {last.get(f, 'NULL')} END" for f in _FIELDS}


def _looked_up(kind: str, place: str, **how) -> dict[str, str]:
    return _choice((f"{kind}_slug IS NOT NULL", _verdict(kind, place, **how)), last={"status": "'no_match'", "place": place if kind != "brand" else "NULL"})


_NO_PATH = {"status": "'skipped'", "reason": "'no_category_path'"}
_VERDICTS = {
    "0": _choice(("mark <> ''", {"status": "'decided'", "slug": "'vegan'", "matched": "mark", "place": "'name_brand_raw'"}), last={"status": "'no_match'", "place": "'name_brand_raw'"}),
    "1": _choice(
        ("len(path) = 0", _NO_PATH), ("trim(lower(path[1])) = 'food'", {"status": "'skipped'", "reason": "'path_is_food_root'"}), ("rescue_slug IS NOT NULL AND rescue_veto_token IS NULL", _verdict("rescue", "'name_text'")),
        ("aisle_veto_token IS NULL AND aisle_node_slug IS NOT NULL", _verdict("aisle_node", "'path'", rule=False)), ("aisle_veto_token IS NULL AND aisle_slug IS NOT NULL", _verdict("aisle", "'name_text'")),
        ("rescue_veto_token IS NOT NULL", {"status": "'decided'", "slug": "'household'", "tab": "'rescue_veto'", "matched": "rescue_veto_token", "place": "'name_text'", "reason": "'rescue_veto'", "blocked": "rescue_slug"}),
        last={"status": "'decided'", "slug": "'household'", "reason": "'no_rescue_token'"},
    ),
    "2": _looked_up("form", "'name_text'"), "2b": _choice(("caption = ''", {"status": "'skipped'", "reason": "'no_unit'"}), last=_looked_up("caption", "'caption'")),
    "3": _choice(("len(path) = 0", _NO_PATH), last=_looked_up("node", "'path'", rule=False)), "4": _looked_up("brand", "CASE WHEN contains(brand, brand_token) THEN 'brand_field' ELSE 'name_text' END"),
    "5": _looked_up("flavour", "'name_text'"), "6": _looked_up("keyword", "'name_text'"), "7": {"status": "'decided'", "slug": "'other'", "tab": "NULL", "rule": "NULL", "matched": "NULL", "place": "NULL", "reason": "'fallback'", "blocked": "NULL"},
}
_HITS = f"""p AS (SELECT p_partkey, lower(p_type) AS stored, p_name AS name, ' ' || lower(p_name) || ' ' || lower(p_brand) || ' ' AS hay, lower(p_brand) AS brand,
  CASE p_size % 4 WHEN 1 THEN ['food', lower(p_type)] WHEN 2 THEN ['garden', 'Tools '] WHEN 3 THEN ['house', 'metal'] ELSE [] END AS path,
  CASE p_size % 5 WHEN 0 THEN 'in dose' WHEN 1 THEN 'im glas' ELSE '' END AS caption, regexp_extract(p_name || ' ' || p_brand, '(?i)(?:^|[^a-zäöüß])(new r|ew b)', 1) AS mark FROM part),
r AS (SELECT * FROM (VALUES {_ROWS}) v(n, kind, rule, tok, token, slug)),
g AS (SELECT p.*, r.*, CASE WHEN kind IN ('node', 'aisle_node') THEN len(path) - list_position(list_transform(path, lambda x: trim(lower(x))), token) ELSE 0 END AS depth FROM p JOIN r ON CASE
  WHEN kind = 'caption' THEN caption <> '' AND contains(' ' || caption || ' ', token) WHEN kind = 'preserved' THEN caption <> '' AND contains(caption, token)
  WHEN kind IN ('node', 'aisle_node') THEN list_contains(list_transform(path, lambda x: trim(lower(x))), token) WHEN kind = 'brand' THEN contains(brand, token) OR contains(hay, token) ELSE contains(hay, token) END),
u AS (SELECT p_partkey, kind, rule, slug, CASE WHEN kind IN ('node', 'aisle_node') THEN path[list_position(list_transform(path, lambda x: trim(lower(x))), token)] ELSE token END AS token FROM g QUALIFY row_number() OVER (PARTITION BY p_partkey, kind ORDER BY depth, n) = 1),
i AS (SELECT p_partkey, {", ".join(f"{one.format(c)} AS {kind}_{c}" for kind, one in _ONE.items() for c in ("slug", "rule", "token"))} FROM u GROUP BY p_partkey),
l AS (SELECT p.*, preserved_token, {", ".join(f"{v[f]} AS l{n}_{f}" for n, v in _VERDICTS.items() for f in _FIELDS)} FROM p LEFT JOIN i USING (p_partkey)),
x AS (SELECT *, coalesce({", ".join(f"l{n}_slug" for n in _VERDICTS)}) AS won, CASE {" ".join(f"WHEN l{n}_slug IS NOT NULL THEN '{n}'" for n in _VERDICTS)} END AS n_won FROM l),
w AS (SELECT *, won IN ('fruits', 'vegetables') AND preserved_token IS NOT NULL AS redirected, CASE WHEN won IN ('fruits', 'vegetables') AND preserved_token IS NOT NULL THEN 'pantry' ELSE won END AS final,
  CASE n_won {" ".join(f"WHEN '{n}' THEN '{name}'" for n, name in ru.LAYERS.items())} END AS kind, CASE n_won {" ".join(f"WHEN '{n}' THEN l{n}_matched" for n in _VERDICTS)} END AS token FROM x)"""


def _joined(rows, found, columns):
    keys = ["name", "brand", "path", "caption"]
    found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *columns)
    return rows.join(found, [rows[k].eqNullSafe(found[f"_{k}"]) for k in keys])


@query("c09_classify", f"WITH {_HITS} SELECT p_partkey, final AS slug, kind AS layer, token FROM w", views=False)
def classified(spark, sf_dir):
    rows = products(spark, sf_dir)
    return _joined(rows, ru.classify(rows, BOOK), ["slug", "layer", "token"]).select("p_partkey", "slug", "layer", "token")


@query("c10_explain", f"""WITH {_HITS} SELECT p_partkey, final AS slug, redirected, {" || ' ' || ".join(f"'{n}:' || l{n}_status || coalesce('=' || l{n}_slug, '') || coalesce(' (' || l{n}_reason || ')', '') || coalesce(' instead of ' || l{n}_blocked, '')" for n in _VERDICTS)} AS trace FROM w""", views=False)
def explained(spark, sf_dir):
    rows = products(spark, sf_dir)
    out = _joined(rows, ru.explain(rows, BOOK), ["slug", "layers", "redirect"])
    said = F.transform("layers", lambda x: F.concat(x["layer"], F.lit(":"), x["status"], F.coalesce(F.concat(F.lit("="), x["slug"]), F.lit("")), F.coalesce(F.concat(F.lit(" ("), x["reason"], F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" instead of "), x["blocked_slug"]), F.lit(""))))
    return out.select("p_partkey", "slug", F.col("redirect").isNotNull().alias("redirected"), F.array_join(said, " ").alias("trace"))


_ADDRESS = lambda n: f"l{n}_tab || coalesce('[' || l{n}_rule || ']', '')"


@query("c12_readers", f"""WITH {_HITS}, d AS (SELECT p_partkey, n_won, unnest([{", ".join(f"{{'n': '{n}', 'slug': l{n}_slug, 'at': {_ADDRESS(n)}}}" for n in _VERDICTS)}]) AS v FROM w)
SELECT p_partkey, any_value(n_won) AS winner, max(v.at) FILTER (WHERE v.n = n_won) AS address, coalesce(string_agg(v.n || '=' || v.slug, ' ' ORDER BY v.n) FILTER (WHERE v.slug IS NOT NULL AND v.n > n_won), '') AS later FROM d GROUP BY p_partkey""", views=False)
def readers(spark, sf_dir):
    """The layer that won, where its rule stands, and what later layers would have said."""
    rows = products(spark, sf_dir)
    out = _joined(rows, ru.explain(rows, BOOK), ["layers"])
    won = ru.winner(F.col("layers"))
    return out.select("p_partkey", won["layer"].alias("winner"), ru.address(won).alias("address"), F.array_join(F.transform(ru.later(F.col("layers")), lambda x: F.concat_ws("=", x["layer"], x["slug"])), " ").alias("later"))


@query("c11_stale", f"WITH {_HITS} SELECT stored AS was, final AS now, count(*) AS n FROM w WHERE stored <> final GROUP BY ALL", views=False)
def stale_rows(spark, sf_dir):
    return ru.stale(products(spark, sf_dir), BOOK, "stored")


@query("k04_recategorise", f"WITH {_HITS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE stored <> final) AS n_changed FROM w", views=False)
def recategorised(spark, sf_dir):
    rows = products(spark, sf_dir)
    return _joined(rows, ru.classify(rows, BOOK), ["slug"]).agg(F.count("*").alias("n_rows"), F.count_if(F.col("stored") != F.col("slug")).alias("n_changed"))


@query("g07_transition_diff", f"""WITH {_HITS}, o AS (SELECT p_partkey AS id, stored AS slug FROM w WHERE p_partkey % 10 <> 3), n AS (SELECT p_partkey AS id, final AS slug FROM w WHERE p_partkey % 10 <> 4)
SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.slug <> n.slug THEN 'moved' ELSE 'same' END AS change, count(*) AS n FROM o FULL JOIN n USING (id) GROUP BY 1""", views=False)
def transitions(spark, sf_dir):
    from offerloom.operators.gates import transition_diff

    rows = products(spark, sf_dir)
    now = _joined(rows, ru.classify(rows, BOOK), ["slug"])
    old = rows.where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("id"), F.col("stored").alias("slug"))
    return transition_diff(old, now.where("p_partkey % 10 <> 4").select(F.col("p_partkey").alias("id"), "slug"))


@query("c13_subgroup", """SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN CASE WHEN contains(p_name, 'gear') THEN 'gears' WHEN contains(p_name, 'gizmo') OR contains(p_name, 'widget') THEN 'gizmos' END
  WHEN 'SMALL' THEN CASE WHEN contains(p_name, 'bolt') THEN 'bolts' END END AS sub_group, CASE sub_group WHEN 'gears' THEN 'Gears' WHEN 'gizmos' THEN 'Gizmos and widgets' WHEN 'bolts' THEN 'Bolts' END AS label FROM part""", views=False)
def sub_groups(spark, sf_dir):
    category = F.when(F.col("p_type") == "STANDARD", "fruits").when(F.col("p_type") == "SMALL", "bakery")
    return table(spark, sf_dir, "part").select("p_partkey", ru.sub_group(F.col("p_name"), category, GROUPS).alias("_g")).select("p_partkey", F.col("_g.slug").alias("sub_group"), "_g.label")


#: Names around the organic and plant-based marks; a part's key picks one.
MARKED = ("{p}", "Bio {p}", "{p} Demeter", "Symbiose {p}", "Ökomilch", "OEKO-{p}", "Antibiotikafrei", "Red Grapes", "Alnatura {p}", "Vegane {p}", "Oatly {p}", "unvegan", "Pflanzliche {p}", "Like Meat {p}", "3vegan {p}", "3Bio {p}")
_MARKED = f"m AS (SELECT p_partkey, replace(({list(MARKED)!r})[p_partkey % {len(MARKED)} + 1], '{{p}}', p_name) AS name, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS brand FROM part)"


def _marked(spark, sf_dir):
    name = F.replace(F.element_at(F.array(*map(F.lit, MARKED)), (F.col("p_partkey") % len(MARKED) + 1).cast("int")), F.lit("{p}"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).alias("brand"))


@query("c14_organic", f"WITH {_MARKED} SELECT p_partkey, regexp_matches(lower(name || ' ' || coalesce(brand, '')), '(^|[^0-9a-zäöüß])({'|'.join(ru.ORGANIC)})') AS organic FROM m", views=False)
def organic_parts(spark, sf_dir):
    return _marked(spark, sf_dir).select("p_partkey", ru.organic(F.col("name"), F.col("brand")).alias("organic"))


@query("c00_vegan", f"WITH {_MARKED} SELECT p_partkey, regexp_matches(lower(name || ' ' || coalesce(brand, '')), '(^|[^a-zäöüß])({'|'.join(ru.VEGAN)})') AS vegan FROM m", views=False)
def vegan_parts(spark, sf_dir):
    return _marked(spark, sf_dir).select("p_partkey", ru.plant_based(F.col("name"), F.col("brand")).alias("vegan"))


@query("g06_shadowing", """WITH t AS (SELECT 'names' AS kind, CAST(p_partkey AS INTEGER) AS rule, p_name AS token, p_type AS slug FROM part UNION ALL SELECT 'nouns', CAST(p_partkey AS INTEGER), CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE p_name END, p_type FROM part),
f AS (SELECT kind, token, slug, min(rule) AS rule FROM t GROUP BY ALL)
SELECT b.kind, b.token, b.slug, a.token AS earlier_token, a.slug AS earlier_slug FROM f b JOIN f a ON a.kind = b.kind AND a.rule < b.rule AND a.slug <> b.slug AND contains(b.token, a.token)""", views=False)
def shadowing(spark, sf_dir):
    """Of two tables of rules made from the parts, the tokens that an earlier rule of another type takes."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("rule"), "p_name", F.col("p_type").alias("slug"), "p_size")
    names = rows.select(F.lit("names").alias("kind"), "rule", F.col("p_name").alias("token"), "slug")
    nouns = rows.select(F.lit("nouns").alias("kind"), "rule", F.when(F.col("p_size") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.col("p_name")).alias("token"), "slug")
    return ru.shadowed(names.unionByName(nouns).groupBy("kind", "token", "slug").agg(F.min("rule").alias("rule")))
