"""Resolution as joins: catalogs, inclusions, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.axes import below
from thicket.operators.edit import renumber
from thicket.operators.selection import attr
from thicket.schema import VALUE
from thicket.storage import bucketed, dealt, written

#: Kinds of catalog entries, by how they match; the order is their tier.
TIERS = {"system": ("system", "rewriteSystem", "systemSuffix", "delegateSystem"), "public": ("public", None, None, "delegatePublic"), "uri": ("uri", "rewriteURI", "uriSuffix", "delegateURI")}


def catalog_entries(nodes: DataFrame) -> DataFrame:
    """(ord, kind, match, target) of parsed catalogs; unknown elements are passed over."""
    match = F.coalesce(attr("systemId"), attr("publicId"), attr("systemIdStartString"), attr("publicIdStartString"), attr("uriStartString"), attr("systemIdSuffix"), attr("uriSuffix"), attr("name"))
    target = F.coalesce(attr("catalog"), attr("rewritePrefix"), attr("uri"))
    kinds = sorted({k for t in TIERS.values() for k in t if k} | {"nextCatalog"})
    rows = nodes.filter(F.col("kind") == "element").filter(F.col("name").isin(kinds))
    # A number by document, then node, without ordering all entries in one task.
    order = F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pre")
    return rows.select(order.cast("decimal(38,0)").alias("ord"), F.col("name").alias("kind"), match.alias("match"), target.alias("target"))


def chained(catalogs: DataFrame, start: str, max_depth: int = 50) -> DataFrame:
    """(turn, ord, kind, match, target): the entries of the catalog ``start`` and of those that its nextCatalog entries lead to.

    ``catalogs`` are catalog entries with the ``uri`` of their catalog.  ``turn`` is the way
    to an entry's catalog, an array that sorts as catalogs are consulted: one's own entries
    first, then each next catalog with all that follows from it.  A catalog counts once, at
    its first turn; one that isn't there has no entries; chains over ``max_depth`` long are a
    ValueError.
    """
    number = catalogs.schema["ord"].dataType.simpleString()
    turns = catalogs.sparkSession.createDataFrame([([], start)], f"turn array<{number}>, uri string")
    fresh = turns
    for _ in range(max_depth):
        step = fresh.join(catalogs.filter("kind = 'nextCatalog'").select("uri", "ord", F.col("target").alias("next")), "uri")
        step = step.select(F.array_append("turn", F.col("ord")).alias("turn"), F.col("next").alias("uri")).groupBy("uri").agg(F.min("turn").alias("turn")).select("turn", "uri")
        fresh = written(step.join(turns.select("uri"), "uri", "left_anti").select("turn", "uri"))
        if fresh.isEmpty():
            first = turns.groupBy("uri").agg(F.min("turn").alias("turn"))
            return catalogs.filter("kind <> 'nextCatalog'").join(first, "uri").select("turn", "ord", "kind", "match", "target")
        turns = turns.union(fresh)
    raise ValueError(f"nextCatalog entries lead over {max_depth} catalogs deep")


def _normal_public(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def resolve(requests: DataFrame, entries: DataFrame, what: str, column: str) -> DataFrame:
    """requests with ``resolved``: by exact match, else longest rewritten prefix, else longest
    suffix, else the catalog of the longest delegated prefix; null if none.

    Entries with a ``turn`` (see ``chained``) are consulted catalog by catalog.

    Each distinct identifier is resolved once.  Exact entries meet identifiers in an
    equi-join; for prefixes and suffixes an identifier is exploded into its heads or tails of
    the lengths that occur among the entries (a few numbers, fetched first), which are
    equi-joined too, so neither a large catalog nor many identifiers make a nested loop.
    """
    exact, prefix, suffix, delegate = TIERS[what]
    norm = _normal_public if what == "public" else (lambda x: x)
    ids = requests.select(norm(F.col(column)).alias("id_")).filter("id_ is not null").distinct()
    turn = F.col("turn") if "turn" in entries.columns else F.array().cast("array<int>")
    e = entries.select("ord", "kind", norm(F.col("match")).alias("m_"), "target", turn.alias("turn_"))
    hits = []
    for tier, kind in enumerate((exact, prefix, suffix, delegate)):
        if not kind:
            continue
        mine = e.filter((F.col("kind") == kind) & F.col("m_").isNotNull())
        if kind == exact:
            keyed = ids.withColumn("part_", F.col("id_"))
        else:
            lengths = sorted(r[0] for r in mine.select(F.length("m_")).distinct().collect())
            if not lengths:
                continue
            cut = ids.withColumn("n_", F.explode(F.array(*map(F.lit, lengths)))).filter(F.col("n_") <= F.length("id_"))
            keyed = cut.withColumn("part_", F.expr("right(id_, n_)" if kind == suffix else "left(id_, n_)"))
        value = F.concat("target", F.substring(F.col("id_"), F.length("m_") + 1, F.length("id_"))) if kind == prefix else F.col("target")
        hits.append(keyed.join(mine, F.col("part_") == F.col("m_")).select("id_", value.alias("value_"), F.struct("turn_", F.lit(tier).alias("t"), (-F.length("m_")).alias("l"), F.col("ord")).alias("rank_")))
    every = hits[0]
    for h in hits[1:]:
        every = every.union(h)
    found = every.groupBy("id_").agg(F.min_by("value_", "rank_").alias("resolved"))
    return requests.withColumn("key_", norm(F.col(column))).join(found.withColumnRenamed("id_", "key_"), "key_", "left").drop("key_")


def resolve_external(requests: DataFrame, entries: DataFrame, system: str = "system_id", public: str = "public_id") -> DataFrame:
    """requests with ``resolved``: by system identifier first, then by public identifier."""
    by_system = resolve(requests, entries, "system", system).withColumnRenamed("resolved", "by_system_")
    by_public = resolve(by_system, entries, "public", public).withColumnRenamed("resolved", "by_public_")
    return by_public.withColumn("resolved", F.coalesce("by_system_", "by_public_")).drop("by_system_", "by_public_")


XI = "http://www.w3.org/2001/XInclude"


def include(nodes: DataFrame, resources: DataFrame, resource_texts: DataFrame | None = None, max_depth: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, errors): xi:include elements replaced by what they name, until none is left.

    ``resources`` (href, and the columns of the node table but doc_id) are parsed documents;
    ``resource_texts`` (href, text) serve parse="text".  Each round is a join of hrefs with
    the resources; a row carries the hrefs it came through, so a circle is an error and ends.
    An href that isn't there is replaced by its fallback's content, or is an error.  What is
    still left after ``max_depth`` rounds stays as it is, and each such element is an error.
    """
    path = "via_"
    nodes, resources = nodes.drop(VALUE), resources.drop(VALUE)
    # Documents without inclusions take no part in the rounds; an included one can't add any to them.
    of_include = (F.col("kind") == "element") & (F.col("name") == "include") & (F.col("namespace") == XI)
    calling = nodes.filter(of_include).select("doc_id").distinct()
    quiet = nodes.join(calling, "doc_id", "left_anti")
    buckets = dealt(nodes.sparkSession, calling.count())
    current = nodes.join(calling, "doc_id", "left_semi").withColumn(path, F.array().cast("array<string>"))
    errors = None
    for _ in range(max_depth):
        includes = current.filter((F.col("kind") == "element") & (F.col("name") == "include") & (F.col("namespace") == XI))
        if includes.isEmpty():
            break
        calls = includes.select("doc_id", F.col("pre").alias("i_pre"), F.col("post").alias("i_post"), F.col("depth").alias("i_depth"), F.regexp_replace(F.coalesce(attr("href"), F.lit("")), "#.*$", "").alias("href"), F.coalesce(attr("parse"), F.lit("xml")).alias("parse"), F.col(path).alias("i_via"))
        circle = F.array_contains("i_via", F.col("href"))
        live = calls.filter(~circle)
        body = resources.filter("kind not in ('document', 'doctype')")
        size = resources.groupBy("href").agg((F.max("pre") + 1).alias("size"))
        xml = live.filter("parse = 'xml'").join(body, "href").join(size, "href")
        cols = [c for c in nodes.columns if c not in ("doc_id", "pre", "depth")]
        put = F.col("i_pre") + F.col("pre") / (F.col("size") + 1)
        new = xml.select("doc_id", put.alias("pre"), (F.col("depth") - 1 + F.col("i_depth")).cast("int").alias("depth"), *cols, F.array_append("i_via", F.col("href")).alias(path))
        done = xml.select("doc_id", "i_pre").distinct()
        if resource_texts is not None:
            texts = live.filter("parse = 'text'").join(resource_texts, "href")
            new = new.unionByName(texts.select("doc_id", (F.col("i_pre") + 0.5).alias("pre"), F.col("i_depth").alias("depth"), F.lit("text").alias("kind"), F.col("text").alias("content"), F.col("i_via").alias(path)), allowMissingColumns=True)
            done = done.unionByName(texts.select("doc_id", "i_pre"))
        failed = calls.join(done, ["doc_id", "i_pre"], "left_anti")
        # A fallback's content moves up two levels in place of the include element.
        inside = below(current, failed.select("doc_id", F.col("i_pre").alias("pre"), F.col("i_post").alias("post"), "i_pre"), "i_pre").filter(F.col("pre") > F.col("i_pre")).drop("c_pre", "c_post")
        fallback = inside.filter((F.col("name") == "fallback") & (F.col("namespace") == XI)).select(F.col("doc_id").alias("b_doc"), F.col("i_pre").alias("b_inc"), F.col("pre").alias("b_pre"), F.col("post").alias("b_post"))
        rescued = inside.join(fallback, (F.col("doc_id") == F.col("b_doc")) & (F.col("i_pre") == F.col("b_inc")) & (F.col("pre") > F.col("b_pre")) & (F.col("pre") <= F.col("b_post")))
        rescued = rescued.withColumn("depth", F.col("depth") - 2).withColumn("pre", F.col("pre").cast("double")).select(*current.columns)
        bad = failed.join(fallback.select(F.col("b_doc").alias("doc_id"), F.col("b_inc").alias("i_pre")), ["doc_id", "i_pre"], "left_anti")
        bad = bad.select("doc_id", "href", F.when(F.array_contains("i_via", F.col("href")), "circular inclusion").otherwise("resource not found").alias("message"))
        errors = bad if errors is None else errors.unionByName(bad)
        gone = below(current.select("doc_id", "pre", "post"), calls.select("doc_id", F.col("i_pre").alias("pre"), F.col("i_post").alias("post"))).select(F.col("doc_id").alias("g_doc"), F.col("pre").alias("g_pre"))
        rest = current.join(gone, (F.col("doc_id") == F.col("g_doc")) & (F.col("pre") == F.col("g_pre")), "left_anti")
        merged = rest.withColumn("pre", F.col("pre").cast("double")).unionByName(new, allowMissingColumns=True).unionByName(rescued)
        current = bucketed(renumber(merged.repartition(buckets, "doc_id")), "doc_id", buckets)
        errors = written(errors)
    else:
        left = current.filter((F.col("kind") == "element") & (F.col("name") == "include") & (F.col("namespace") == XI))
        deep = left.select("doc_id", F.coalesce(attr("href"), F.lit("")).alias("href"), F.lit(f"inclusions nested over {max_depth} deep").alias("message"))
        errors = deep if errors is None else errors.unionByName(deep)
    empty = nodes.select("doc_id", F.lit("").alias("href"), F.lit("").alias("message")).limit(0)
    return quiet.unionByName(current.drop(path)), errors if errors is not None else empty
