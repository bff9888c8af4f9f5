"""Entity resolution: surface forms to entities by blocking, compatibility and connected components."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docloom.functions import fixed
from docloom.functions.profile import strip_all
from docloom.operators.components import connected_components
from docloom.operators.numbering import numbered
from docloom.operators.similarity_join import indel_ratio, similar_pairs
from docloom.sources.workspace import cut_lineage

_TITLE = re.compile(fixed.TITLE, re.I)


def fold_surface(surface: str) -> str:
    """A surface form without compatibility variants, title, possessive, punctuation and case."""
    text = _TITLE.sub("", unicodedata.normalize("NFKC", surface).strip())
    text = re.sub(r"[^\w\s]", " ", re.sub(r"['’]s$", "", text))
    return re.sub(r"\s+", " ", text).strip().lower()


@pandas_udf(T.StringType())
def normalise_surface(surface: pd.Series) -> pd.Series:
    return surface.map(lambda s: None if s is None else fold_surface(s))


def surface_counts(mentions: DataFrame) -> DataFrame:
    """forms(norm, type, n) of mentions(norm, type, ..)."""
    return mentions.filter(F.coalesce("norm", F.lit("")) != "").groupBy("norm", "type").agg(F.count("*").alias("n"))


def org_key(norm: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(norm, "(?i)" + fixed.ORG_SUFFIX, " "), r"(?i)\bthe\b", " ")
    plain = strip_all(F.regexp_replace(plain, r"\s+", " "))
    return F.when(plain == "", norm).otherwise(plain)


def _near(a: Column, b: Column, strict_initials: bool) -> Column:
    """Equal, or one the initial of the other."""
    initial = ((F.length(a) == 1) & b.startswith(a)) | ((F.length(b) == 1) & a.startswith(b))
    return (a == b) | (initial & F.lit(not strict_initials))


def _given_pairs(named: DataFrame, strict_initials: bool) -> DataFrame:
    """(last, x, y): the different first given names of a surname that may stand for each other.

    Given names are compared word by word, so the first words of two compatible forms are equal, an initial and a name,
    or similar; no others meet.
    """
    first = named.select("last", F.get("given", F.lit(0)).alias("s")).distinct()
    similar = similar_pairs(first, threshold=fixed.PERSON_FUZZ, block=["last"]).select("last", F.col("a").alias("x"), F.col("b").alias("y"))
    if strict_initials:
        return similar
    short = first.filter(F.length("s") == 1).select("last", F.col("s").alias("x"), F.col("s").alias("i"))
    long = first.filter(F.length("s") > 1).select("last", F.col("s").alias("y"), F.substring("s", 1, 1).alias("i"))
    return similar.unionByName(short.join(long, ["last", "i"]).select("last", "x", "y")).distinct()


def cluster_people(forms: DataFrame, strict_initials: bool = False) -> DataFrame:
    """forms(norm) of persons to (norm, root, kind): forms of several words with one last word.

    Forms of a surname meet only if their first given names may stand for each other, or if their words are the same;
    most pairs are then settled natively, those with further given names that differ go to Python.
    """
    tokens = F.split("norm", " ")
    named = forms.select("norm", tokens.alias("t")).filter(F.size("t") >= 2).distinct()
    named = named.select("norm", F.element_at("t", -1).alias("last"), F.slice("t", 1, F.size("t") - 1).alias("given"), F.array_join(F.array_sort("t"), " ").alias("bag"))
    side = lambda k: named.select("last", "bag", F.get("given", F.lit(0)).alias("x" if k == "a" else "y"), F.col("norm").alias(f"{k}_norm"), F.col("given").alias(f"{k}_given"))
    a, b = side("a").drop("bag"), side("b").drop("bag")
    given = _given_pairs(named, strict_initials)
    equal = a.join(b.withColumnRenamed("y", "x"), ["last", "x"]).filter("a_norm < b_norm").drop("x")
    met = equal.unionByName(a.join(given, ["last", "x"]).join(b, ["last", "y"]).drop("x", "y")).drop("last")
    reordered = side("a").drop("x").join(side("b").drop("y"), ["last", "bag"]).filter("a_norm < b_norm").select("a_norm", "b_norm", F.lit(False).alias("native"))

    @pandas_udf(T.BooleanType())
    def compatible(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            near = lambda p, q: p == q or (not strict_initials and (len(p) == 1 and q.startswith(p) or len(q) == 1 and p.startswith(q))) or indel_ratio(p, q) >= fixed.PERSON_FUZZ
            return all(near(p, q) for p, q in zip(x, y))

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    n = F.least(F.size("a_given"), F.size("b_given"))
    plain = F.forall(F.arrays_zip(F.slice("a_given", 1, n).alias("x"), F.slice("b_given", 1, n).alias("y")), lambda z: _near(z["x"], z["y"], strict_initials))
    settled = met.withColumn("plain", plain)
    fuzzy = settled.filter("NOT plain").filter(compatible("a_given", "b_given"))
    links = settled.filter("plain").unionByName(fuzzy).select("a_norm", "b_norm", F.lit(True).alias("native")).unionByName(reordered)
    roots = connected_components(named.select(F.col("norm").alias("node")), links.select(F.col("a_norm").alias("a"), F.col("b_norm").alias("b")))
    kinds = links.join(roots, F.col("a_norm") == F.col("node")).groupBy("root").agg(F.max("native").alias("v")).select("root", F.when(F.col("v"), "name_variant").otherwise("token_reorder").alias("kind"))
    return roots.join(kinds, "root", "left").select(F.col("node").alias("norm"), "root", F.coalesce("kind", F.lit("singleton")).alias("kind"))


def cluster_conservative(forms: DataFrame, threshold: float = fixed.ORG_FUZZ) -> DataFrame:
    """forms(norm) of organisations or places to (norm, root, kind): near-identical keys that begin with the same four characters.

    Forms of one key are linked to the least of them, and keys to similar keys by those least forms.
    """
    keyed = forms.select("norm", F.regexp_replace(org_key(F.col("norm")), " ", "").alias("s")).distinct()
    first = keyed.groupBy("s").agg(F.min("norm").alias("a"))
    alike = keyed.join(first, "s").filter("norm <> a").select(F.col("norm").alias("b"), "a")
    near = similar_pairs(first.select("s", F.substring("s", 1, 4).alias("block")), threshold=threshold, block=["block"]).select(F.col("a").alias("s"), F.col("b").alias("t"))
    links = near.join(first, "s").join(first.select(F.col("s").alias("t"), F.col("a").alias("b")), "t").select("a", "b").unionByName(alike.select("a", "b"))
    roots = connected_components(keyed.select(F.col("norm").alias("node")), links)
    size = roots.groupBy("root").agg(F.count("*").alias("n"))
    return roots.join(size, "root").select(F.col("node").alias("norm"), "root", F.when(F.col("n") > 1, "near_duplicate").otherwise("singleton").alias("kind"))


def attach_bare_names(forms: DataFrame, clusters: DataFrame, mentions: DataFrame) -> DataFrame:
    """(norm, root) for single names, by votes of documents that hold exactly one candidate; surnames fall back to the
    cluster of most mentions.

    A document votes only if its full names give one root for the key, so no document makes more than one row a form.
    """
    tokens = F.split("norm", " ")
    bare = forms.select("norm", tokens.alias("t")).select(
        "norm",
        F.when(F.size("t") == 1, "surname").when((F.size("t") == 2) & (F.length(F.get("t", F.lit(1))) == 1), "given").alias("by"),
        F.get("t", F.lit(0)).alias("key"),
    ).filter((F.col("by") == "given") | ((F.col("by") == "surname") & (F.length("key") > 1)))
    seen = mentions.select("doc_id", "norm").distinct()
    full = seen.join(clusters.select("norm", "root"), "norm").withColumn("t", tokens).filter((F.size("t") >= 2) & (F.length(F.element_at("t", -1)) > 1))
    keys = full.select("doc_id", "root", F.explode(F.array(F.struct(F.lit("surname").alias("by"), F.element_at("t", -1).alias("key")), F.struct(F.lit("given").alias("by"), F.get("t", F.lit(0)).alias("key")))).alias("k")).select("doc_id", "root", "k.by", "k.key")
    single = keys.groupBy("doc_id", "by", "key").agg(F.min("root").alias("root"), F.max("root").alias("_o")).filter("root = _o").select("doc_id", "by", "key", "root")
    votes = bare.join(seen, "norm").join(single, ["doc_id", "by", "key"]).groupBy("norm", "root").agg(F.count("*").alias("v"))
    winner = votes.groupBy("norm").agg(F.min(F.struct((-F.col("v")).alias("v"), "root")).alias("w")).select("norm", F.col("w.root").alias("voted"))
    weight = clusters.join(forms.select("norm", "n"), "norm").groupBy("root").agg(F.sum("n").alias("n"))
    surname = clusters.select("root", F.element_at(tokens, -1).alias("key")).distinct().join(weight, "root")
    dominant = surname.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "root")).alias("d")).select("key", F.col("d.root").alias("fallback"))
    out = bare.join(winner, "norm", "left").join(dominant, "key", "left")
    root = F.coalesce("voted", F.when(F.col("by") == "surname", F.col("fallback")))
    return out.select("norm", root.alias("root")).filter("root IS NOT NULL")


def assemble(forms: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """forms(norm, type, n), clusters(norm, type, root, kind) to (entities, aliases).

    The canonical form is the best by (no salutation, several words, mentions, length, then the least). Ids are the
    type's prefix and the rank of (root, type).
    """
    rows = forms.join(clusters, ["norm", "type"], "left").withColumn("root", F.coalesce("root", "norm")).withColumn("kind", F.coalesce("kind", F.lit("singleton")))
    order = F.struct(F.col("norm").rlike("(?i)" + fixed.SALUTATION).alias("s"), (~F.col("norm").contains(" ")).alias("o"), (-F.col("n")).alias("n"), (-F.length("norm")).alias("l"), "norm")
    groups = rows.groupBy("root", "type").agg(F.min_by("norm", order).alias("canonical"), F.count("*").alias("n_aliases"), F.sum("n").alias("n_mentions"))
    prefix = F.substring("type", 1, 3)
    ranked = numbered(groups, [F.col("root"), F.col("type")], "_rank")
    entities = ranked.withColumn("entity_id", F.format_string("%s_%06d", F.when(F.col("type") == "PERSON", "PER").otherwise(prefix), "_rank"))
    aliases = rows.join(entities.select("root", "type", "entity_id"), ["root", "type"]).select("entity_id", "type", "norm", F.col("n").alias("n_mentions"), F.col("kind").alias("resolution"))
    return entities.select("entity_id", "type", "canonical", "n_aliases", "n_mentions"), aliases


def resolve(mentions: DataFrame, strict_initials: bool = False) -> tuple[DataFrame, DataFrame]:
    """mentions(doc_id, norm, type) to (entities, aliases)."""
    forms = surface_counts(mentions)
    people = forms.filter("type = 'PERSON'")
    named = cluster_people(people, strict_initials)
    bare = attach_bare_names(people, named, mentions.filter("type = 'PERSON'")).withColumn("kind", F.lit("bare_surname"))
    parts = named.unionByName(bare.join(named.select("norm"), "norm", "left_anti")).withColumn("type", F.lit("PERSON"))
    for kind in ("ORG", "GPE"):
        parts = parts.unionByName(cluster_conservative(forms.filter(F.col("type") == kind)).withColumn("type", F.lit(kind)))
    return assemble(forms, parts)


def canonical_addresses(observations: DataFrame, threshold: float = fixed.ADDRESS_FUZZ) -> DataFrame:
    """observations(address) to (address, best): similar local ends pooled, the commonest then shortest of a pool best."""
    counts = observations.filter(F.coalesce("address", F.lit("")) != "").groupBy(F.col("address").alias("norm")).agg(F.count("*").alias("n"))
    local = F.substring_index("norm", "@", 1)
    blocked = counts.select(F.col("norm").alias("s"), F.substring(local, -5, 5).alias("block"))
    pairs = similar_pairs(blocked, threshold=threshold, block=["block"])
    roots = connected_components(counts.select(F.col("norm").alias("node")), pairs.select("a", "b"))
    rows = counts.join(roots, F.col("norm") == F.col("node"))
    best = rows.groupBy("root").agg(F.min_by("norm", F.struct((-F.col("n")).alias("n"), F.length("norm").alias("l"), "norm")).alias("best"))
    return rows.join(best, "root").select(F.col("norm").alias("address"), "best")


def contested(claims: DataFrame) -> DataFrame:
    """claims(address, entity_id, n_mentions) to (address, owner, n_claimants): the largest claimant owns it."""
    return claims.groupBy("address").agg(F.max_by("entity_id", F.struct("n_mentions", "entity_id")).alias("owner"), F.countDistinct("entity_id").alias("n_claimants"))


def attach_addresses(pairs: DataFrame, min_seen: int = 2) -> DataFrame:
    """pairs(entity_id, norm, address) to (entity_id, addresses): those seen with one name at least twice."""
    seen = pairs.filter(F.col("address").isNotNull()).groupBy("entity_id", "norm", "address").agg(F.count("*").alias("n")).filter(F.col("n") >= min_seen)
    return seen.groupBy("entity_id").agg(F.array_sort(F.collect_set("address")).alias("addresses"))


def known_people(actors: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actors with `exact` and `reordered`: the entity of the same form, and of the same words in another order; the forms' entities)."""
    wanted = actors.select("norm").filter("norm IS NOT NULL").distinct()
    names = aliases.filter("norm IS NOT NULL").groupBy("norm").agg(F.min("entity_id").alias("entity_id"))
    exact = wanted.join(names, "norm", "left").withColumnRenamed("entity_id", "exact")
    bags = names.groupBy(name_key(F.col("norm")).alias("bag")).agg(F.min("entity_id").alias("reordered"))
    return exact.withColumn("bag", F.when(F.col("exact").isNull(), name_key(F.col("norm")))).join(bags, "bag", "left").drop("bag"), names


def match_people(actors: DataFrame, aliases: DataFrame, threshold: float = fixed.PERSON_FUZZ) -> DataFrame:
    """actors(norm), aliases(norm, entity_id) of persons to (norm, entity_id, how), a row for each different actor.

    In order: the same form, the same words in another order, the most similar form with the same last word (then the
    least form), else unmatched with a null id. Of several entities of a form the least counts.
    """
    step, names = known_people(actors, aliases)
    step, names = cut_lineage(step), cut_lineage(names)
    last = F.substring_index("norm", " ", -1).alias("last")
    left = step.filter("exact IS NULL AND reordered IS NULL").select(F.col("norm").alias("s"), last)
    pairs = similar_pairs(left, names.select(F.col("norm").alias("s"), last), threshold, ["last"], best=True)
    best = pairs.groupBy(F.col("a").alias("norm")).agg(F.min_by("b", F.struct((-F.col("ratio")).alias("r"), "b")).alias("b"))
    fuzzy = best.join(names.select(F.col("norm").alias("b"), F.col("entity_id").alias("fuzzy")), "b").select("norm", "fuzzy")
    step = step.join(fuzzy, "norm", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("reordered").isNotNull(), "reordered").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("unmatched")
    return step.select("norm", F.coalesce("exact", "reordered", "fuzzy").alias("entity_id"), how.alias("how"))


def link_addresses(actors: DataFrame, aliases: DataFrame, min_seen: int = 2) -> DataFrame:
    """actors(norm, address), a row an observation, to (entity_id, addresses): the canonical addresses of a person.

    A pair of name and address counts if it is seen at least `min_seen` times and the name is found exactly or reordered;
    a similar name and a pair seen once are too little to give somebody an address.
    """
    mails = actors.filter(F.col("address").contains("@") & F.col("norm").isNotNull())
    firm = mails.groupBy("norm", "address").agg(F.count("*").alias("n")).filter(F.col("n") >= min_seen)
    known = known_people(firm, aliases)[0].select("norm", F.coalesce("exact", "reordered").alias("entity_id")).filter("entity_id IS NOT NULL")
    found = firm.join(known, "norm").join(canonical_addresses(mails.select("address")), "address")
    return found.groupBy("entity_id").agg(F.array_sort(F.collect_set("best")).alias("addresses"))


def name_key(norm: Column) -> Column:
    return F.array_join(F.array_sort(F.split(norm, " ")), " ")


def resolve_actors(actors: DataFrame, addresses: DataFrame, names: DataFrame) -> DataFrame:
    """actors(key, names array) to (key, entity_id, method) by ranked lookups: address, exact name, reordered name,
    one of the three commonest display names, else a minted id.

    addresses(address, entity_id), names(norm, entity_id); ties go to the least entity id.
    """
    exact = names.groupBy("norm").agg(F.min("entity_id").alias("entity_id"))
    bags = names.filter(F.col("norm").contains(" ")).groupBy(name_key(F.col("norm")).alias("bag")).agg(F.min("entity_id").alias("entity_id"))
    base = actors.withColumn("bag", F.when(F.col("key").contains(" "), name_key(F.col("key"))))
    step = base.join(addresses.select(F.col("address").alias("key"), F.col("entity_id").alias("by_address")), "key", "left")
    step = step.join(exact.select(F.col("norm").alias("key"), F.col("entity_id").alias("by_name")), "key", "left")
    step = step.join(bags.select("bag", F.col("entity_id").alias("by_bag")), "bag", "left")
    shown = actors.select("key", F.posexplode(F.slice("names", 1, 3)).alias("i", "shown")).join(exact.select(F.col("norm").alias("shown"), "entity_id"), "shown").groupBy("key").agg(F.min_by("entity_id", "i").alias("by_shown"))
    step = step.join(shown, "key", "left")
    found = F.coalesce("by_address", "by_name", "by_bag", "by_shown")
    method = F.when(F.col("by_address").isNotNull(), "address").when(F.col("by_name").isNotNull(), "exact").when(F.col("by_bag").isNotNull(), "reordered").when(F.col("by_shown").isNotNull(), "display").otherwise("minted")
    ranked = numbered(step.select("key", method.alias("method"), found.alias("found")), [F.when(F.col("method") == "minted", 0).otherwise(1), F.col("key")], "_rank")  # minted ones first
    return ranked.select("key", F.coalesce("found", F.format_string("EML_%06d", "_rank")).alias("entity_id"), "method")


def top_names(rows: DataFrame, k: int = 3) -> DataFrame:
    """rows(key, name) to (key, names): the k commonest names of a key, the least first among equals."""
    counts = rows.filter("name IS NOT NULL").groupBy("key", "name").agg(F.count("*").alias("n"))
    first = counts.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy(F.col("n").desc(), "name"))).filter(F.col("i") <= k)
    return first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("r")).select("key", F.transform("r", lambda r: r["name"]).alias("names"))
