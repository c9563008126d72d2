"""Matching of cells with controlled vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import col, first_where, form, let, pick
from ..functions.extract import first_word, word
from ..functions.ranges import spread
from ..resources import values as V
from ..sources import vocab as vocabularies

#: Entries that may be written into an expression, and characters of a run in the index of substring_pairs.
SMALL, GRAM = 5000, 3


def _kind(vocab: DataFrame, kind: str) -> DataFrame:
    return vocab.where(F.col("vocab") == kind)


def match_vocab_exact(df: DataFrame, column: str, vocab: DataFrame, kind: str) -> DataFrame:
    """df with canonical, confidence and match_type of equal comparison forms: 1.0 exact for an entry's name, 0.95
    alias for another form, 0.0 none otherwise (canonical ''). Of entries that share a form the last loaded counts."""
    known = vocabularies.latest_forms(_kind(vocab, kind)).select(F.col("form").alias("_form"), F.col("canonical").alias("_name"), F.col("canon_form").alias("_canon"))
    joined = df.withColumn("_form", form(column)).join(known, "_form", "left")
    hit = F.col("_name").isNotNull() & (F.col("_form") != "")
    exact = F.col("_form") == F.col("_canon")
    return joined.select(
        *df.columns, F.when(hit, F.col("_name")).otherwise("").alias("canonical"), F.when(hit & exact, 1.0).when(hit, 0.95).otherwise(0.0).alias("confidence"),
        F.when(hit & exact, "exact").when(hit, "alias").otherwise("none").alias("match_type"),
    )


def _grams(c: Column, size: int) -> Column:
    """The distinct runs of so many characters; none of a shorter text."""
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda k: F.substring(c, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def substring_pairs(texts: DataFrame, patterns: DataFrame, q: int = GRAM) -> DataFrame:
    """pattern, text of all pairs where a text contains a pattern. Both tables hold distinct values without blanks or nulls.

    Texts post their runs of 1 to q characters in an inverted index. A pattern looks only under the rarest of its runs of
    q characters (a shorter one under itself), and not at all if any of them is in no text; what it meets there is
    verified. No product of the tables is formed, and either may be of any size.
    """
    every = lambda c: F.flatten(F.array(*(_grams(c, k) for k in range(1, q + 1))))
    index = texts.select("text", F.explode(every(F.col("text"))).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.when(F.length("pattern") < q, F.array("pattern")).otherwise(_grams(F.col("pattern"), q))
    asked = patterns.select("pattern", F.size(own).alias("grams"), F.explode(own).alias("gram")).join(counts, "gram")
    rarest = asked.groupBy("pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("known"), F.any_value("grams").alias("grams"))
    return rarest.where("known = grams").select("pattern", "gram").join(index, "gram").where(F.contains("text", "pattern")).select("pattern", "text")


def match_vocab_contains(df: DataFrame, column: str, vocab: DataFrame, kind: str) -> DataFrame:
    """df with canonical, confidence and match_type; what has no equal form takes the first entry in load order whose
    name contains the cell's form or lies in it (0.80 normalized). Forms without ASCII letters or digits match nothing.

    Only the distinct forms left over meet the vocabulary, by substring_pairs in both directions; then their results
    are joined back."""
    exact = match_vocab_exact(df, column, vocab, kind).withColumn("_form", form(column))
    left = exact.where((F.col("match_type") == "none") & (F.col("_form") != "")).select("_form").distinct()
    entries = _kind(vocab, kind).select("ord", F.col("canonical").alias("_name"), form("canonical").alias("_canon")).where("_canon <> ''")
    entries = entries.groupBy("_canon").agg(F.min("ord").alias("ord"), F.min_by("_name", "ord").alias("_name"))
    within = substring_pairs(left.withColumnRenamed("_form", "text"), entries.select(F.col("_canon").alias("pattern"))).toDF("_canon", "_form")
    around = substring_pairs(entries.select(F.col("_canon").alias("text")), left.withColumnRenamed("_form", "pattern")).toDF("_form", "_canon")
    found = within.unionByName(around).join(entries, "_canon").groupBy("_form").agg(F.min_by("_name", "ord").alias("_near"))
    out = exact.join(found, "_form", "left")
    use = (F.col("match_type") == "none") & F.col("_near").isNotNull()
    return out.select(
        *df.columns, F.when(use, F.col("_near")).otherwise(F.col("canonical")).alias("canonical"),
        F.when(use, 0.8).otherwise(F.col("confidence")).alias("confidence"), F.when(use, "normalized").otherwise(F.col("match_type")).alias("match_type"),
    )


# The same matches as expressions, for vocabularies small enough to stand in a plan: no join, no shuffle.


def vocab_expression(c: Column | str, entries: list[tuple]) -> Column:
    """canonical, confidence and match_type of a cell. entries: (canonical, aliases) in load order, at most SMALL."""
    if len(entries) > SMALL:
        raise ValueError("use match_vocab_contains for a vocabulary of this size")
    names: dict[str, tuple[str, float, str]] = {}
    for name, aliases in entries:
        own = plain_form(name)
        for x in (name, *aliases):
            if plain_form(x):
                names[plain_form(x)] = (name, 1.0, "exact") if plain_form(x) == own else (name, 0.95, "alias")
    result = lambda n, c, t: F.struct(n.alias("canonical"), c.alias("confidence"), t.alias("match_type"))
    none = result(F.lit(""), F.lit(0.0), F.lit("none"))

    def near(key: Column) -> Column:
        row = first_where([(plain_form(n), n) for n, _ in entries], lambda e: F.contains(key, e["v0"]) | F.contains(e["v0"], key))
        return let(row["v1"], lambda n: F.when(n.isNotNull(), result(n, F.lit(0.8), F.lit("normalized"))).otherwise(none))

    found = lambda key, hit: F.when(F.coalesce(key, F.lit("")) == "", none).when(hit.isNotNull(), result(hit["v0"], hit["v1"], hit["v2"])).otherwise(near(key))
    return let(form(c), lambda key: let(pick([(k, *v) for k, v in names.items()], key), lambda hit: found(key, hit)))


def plain_form(x: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", " ", x.strip().lower()).strip()


def match_brand(df: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """The brand's match if it is equal to a form; else the manufacturer's if equal; else the brand's."""
    both = match_vocab_contains(df, column, vocab, "brand").withColumn("_b", F.struct("canonical", "confidence", "match_type")).drop("canonical", "confidence", "match_type")
    both = match_vocab_exact(both, column, vocab, "manufacturer").withColumn("_m", F.struct("canonical", "confidence", "match_type"))
    best = F.when((F.col("_b.confidence") < 0.95) & (F.col("_m.confidence") >= 0.95), F.col("_m")).otherwise(F.col("_b"))
    return both.select(*df.columns, best.alias("_r")).select(*df.columns, "_r.*")


def match_distributor(df: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """The distributor's match, equal or by part of the name."""
    return match_vocab_contains(df, column, vocab, "distributor")


def match_category(df: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """The category's match, equal or by part of the name."""
    return match_vocab_contains(df, column, vocab, "category")


def unit_expression(c: Column | str) -> Column:
    """canonical, dimension and confidence of a unit: written forms 1.0; without a final full stop and s 0.9; else
    the cell itself with 0.0."""
    known = [(f.lower().strip(), unit, dimension) for unit, dimension, forms in V.UNITS for f in forms]
    known = [(k, *v) for k, v in {k: (u, d) for k, u, d in known}.items()]
    result = lambda n, d, c: F.struct(n.alias("canonical"), d.alias("dimension"), F.lit(c).alias("confidence"))
    bare = lambda key: F.regexp_replace(F.regexp_replace(key, r"\.+$", ""), "s+$", "")
    left = lambda cut: F.when(cut.isNotNull(), result(cut["v0"], cut["v1"], 0.9)).otherwise(result(F.coalesce(F.trim(col(c)), F.lit("")), F.lit("none"), 0.0))
    found = lambda key, whole: F.when(whole.isNotNull(), result(whole["v0"], whole["v1"], 1.0)).otherwise(let(pick(known, bare(key)), left))
    return let(F.lower(F.regexp_replace(F.trim(col(c)), r"\s+", " ")), lambda key: let(pick(known, key), lambda whole: found(key, whole)))


def material_expression(c: Column | str) -> Column:
    """canonical and confidence of a material: written form 1.0; without punctuation 0.9; the first form in table
    order that contains it or lies in it 0.8; else the cell itself with 0.0."""
    known = list(V.MATERIALS.items())
    result = lambda n, c: F.struct(n.alias("canonical"), F.lit(c).alias("confidence"))
    near = lambda x: F.when(x != "", first_where(known, lambda r: F.contains(x, r["v0"]) | F.contains(r["v0"], x))["v1"])
    last = lambda n: F.when(n.isNotNull(), result(n, 0.8)).otherwise(result(F.coalesce(F.trim(col(c)), F.lit("")), 0.0))
    cut = lambda simple: let(pick(known, simple), lambda bare: F.when(bare.isNotNull(), result(bare, 0.9)).otherwise(let(near(simple), last)))
    simple = lambda key: F.trim(F.regexp_replace(F.regexp_replace(key, "[^a-z0-9 ]+", " "), " +", " "))
    found = lambda key, whole: F.when(whole.isNotNull(), result(whole, 1.0)).otherwise(let(simple(key), cut))
    return let(F.lower(F.regexp_replace(F.trim(col(c)), r"\s+", " ")), lambda key: let(pick(known, key), lambda whole: found(key, whole)))


def normalise_uom(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_u", unit_expression(column)).select(*df.columns, "_u.*")


def normalise_material(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_m", material_expression(column)).select(*df.columns, "_m.*")


def prefix_manufacturer(part: Column | str) -> Column:
    """The manufacturer of a part number's first three characters, or null."""
    return pick(list(V.PART_PREFIXES.items()), F.upper(F.substring(F.trim(col(part)), 1, 3)))


def infer_mfr_from_part(df: DataFrame, part_col: str) -> DataFrame:
    return df.withColumn("inferred", prefix_manufacturer(part_col)).withColumn("confidence", F.when(F.col("inferred").isNotNull(), 0.85).otherwise(0.0))


def text_vocab_expression(text: Column | str, entries: list[tuple]) -> Column:
    """The first entry in load order of which a form (aliases of 3 or more characters) is a whole word of a text."""
    pattern = lambda name, aliases: "|".join(word(x)[4:] for x in (name, *(a for a in aliases if len(a) >= 3)))
    return first_word(text, [(pattern(e[0], e[1]), e[0]) for e in entries])


def infer_from_text_vocab(df: DataFrame, text_col: str, entries: list[tuple] = V.MANUFACTURERS) -> DataFrame:
    return spread(df).withColumn("inferred", text_vocab_expression(text_col, entries))
