"""Node tables to text: every node gives its opening and closing parts, which are joined document by document."""

from __future__ import annotations

from html.entities import codepoint2name

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.ordered import in_order, starts, whole
from thicket.sources.html import VOID




def _escape(s: Column, pairs) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_text(s: Column) -> Column:
    return _escape(s, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#xD;")))


def escape_attribute(s: Column) -> Column:
    return _escape(s, (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")))


def _escape_attribute_xml(s: Column) -> Column:
    return _escape(s, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")))


def _qname(prefix: Column, name: Column) -> Column:
    return F.when(F.length(prefix) > 0, F.concat(prefix, F.lit(":"), name)).otherwise(name)


def _attrs(attrs: Column, escape) -> Column:
    one = F.transform(F.coalesce(attrs, F.array().cast("array<struct<name:string,value:string,prefix:string,namespace:string>>")), lambda a: F.concat(F.lit(" "), _qname(a["prefix"], a["name"]), F.lit('="'), escape(a["value"]), F.lit('"')))
    return F.array_join(one, "")


def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, pre, post, depth, opening, closing) -> keys, text.

    An opening stands at its node's number; closings after node post come in order of falling depth.
    """
    opening, closing = (F.coalesce(c, F.lit("")) for c in ("opening", "closing"))
    # One string a node, and the bytes of it that are the opening: few columns are sent.
    parts = rows.select(*keys, "pre", "post", F.concat(opening, closing).alias("both"), F.octet_length(opening).alias("cut")).filter("both <> ''")
    kinds = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys)
    return in_order(parts, *keys).mapInArrow(lambda it: _texts(it, tuple(keys)), f"{kinds}, text string")


def _texts(batches, keys: tuple[str, ...]):
    """The parts of whole documents, put in order and written one behind another."""
    for table in whole(batches, *keys):
        first = starts(table, keys)
        doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        both = table.column("both").combine_chunks().cast(pa.string())
        pre, post, cut = (table.column(c).to_numpy().astype(np.int64) for c in ("pre", "post", "cut"))
        _, borders, data = both.buffers()
        at = np.frombuffer(borders, np.int32)[both.offset : both.offset + len(both) + 1]
        ends = np.flatnonzero(np.diff(at) > cut)
        ends = ends[np.lexsort((-pre[ends], post[ends], doc[ends]))]  # of nodes that end together, the deepest comes last
        # Within a document, a closing stands behind all openings up to its node's last number.
        far = int(post.max()) + 2
        place = np.searchsorted(doc * far + pre, doc[ends] * far + post[ends], "right") + np.arange(len(ends))
        order = np.empty(len(both) + len(ends), np.int64)
        is_end = np.zeros(len(order), bool)
        is_end[place] = True
        order[place], order[~is_end] = 2 * ends + 1, 2 * np.arange(len(both))
        halves = np.append(np.column_stack([at[:-1], at[:-1] + cut]).ravel(), at[-1]).astype(np.int32)
        parts = pa.StringArray.from_buffers(2 * len(both), pa.py_buffer(halves), data).take(pa.array(order))
        _, borders, data = parts.buffers()
        borders = np.frombuffer(borders, np.int32)[parts.offset : parts.offset + len(parts) + 1]
        upto = np.flatnonzero(~is_end)[first]
        text = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(borders[upto], borders[-1]).astype(np.int32)), data)
        taken = pa.array(first)
        yield from pa.Table.from_arrays([*[table.column(k).combine_chunks().take(taken) for k in keys], text], names=[*keys, "text"]).to_batches()


def _has_content(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("full_", F.col("post") > F.col("pre"))


def _comment_like(kind: Column) -> Column:
    return F.when(kind == "comment", F.concat(F.lit("<!--"), F.coalesce("content", F.lit("")), F.lit("-->"))).when(kind == "pi", F.concat(F.lit("<?"), F.col("name"), F.when(F.length("content") > 0, F.concat(F.lit(" "), F.col("content"))).otherwise(""), F.lit("?>")))


def to_xml(nodes: DataFrame, declaration: bool = True, indent: str | None = None) -> DataFrame:
    """(doc_id, text): documents as XML.  With indent, element-only content is put on lines of its own."""
    n = _has_content(nodes)
    kind, qname = F.col("kind"), _qname(F.col("prefix"), F.col("name"))
    head = '<?xml version="1.0"?>\n' if declaration else ""
    opening = (
        F.when(kind == "document", head)
        .when(kind == "element", F.concat(F.lit("<"), qname, _attrs(F.col("attrs"), _escape_attribute_xml), F.when(F.col("full_"), ">").otherwise("/>")))
        .when(kind == "text", escape_text(F.col("content")))
        .when(kind == "cdata", F.concat(F.lit("<![CDATA["), F.col("content"), F.lit("]]>")))
        .when(kind == "doctype", F.concat(F.lit("<!DOCTYPE "), F.col("name"), F.when(F.length("content") > 0, F.concat(F.lit(" "), F.col("content"))).otherwise(""), F.lit(">\n")))
        .otherwise(_comment_like(kind))
    )
    closing = F.when((kind == "element") & F.col("full_"), F.concat(F.lit("</"), qname, F.lit(">"))).when(kind == "document", "\n").otherwise("")
    rows = n.withColumn("opening", opening).withColumn("closing", closing)
    if indent is not None:
        mixed = nodes.filter("kind in ('text', 'cdata')").select("doc_id", F.col("parent").alias("m")).distinct().withColumn("mixed_", F.lit(True))
        rows = rows.join(mixed.withColumnRenamed("m", "parent"), ["doc_id", "parent"], "left")
        own = mixed.select("doc_id", F.col("m").alias("pre"), F.lit(True).alias("has_text_"))
        rows = rows.join(own, ["doc_id", "pre"], "left")
        lead = F.concat(F.lit("\n"), F.expr("repeat(%r, depth - 1)" % indent))
        loose = F.col("mixed_").isNull() & (F.col("depth") > 1)
        rows = rows.withColumn("opening", F.when(loose, F.concat(lead, "opening")).otherwise(F.col("opening")))
        rows = rows.withColumn("closing", F.when((kind == "element") & F.col("full_") & F.col("has_text_").isNull(), F.concat(lead, "closing")).otherwise(F.col("closing")))
    return _folded(rows, ["doc_id"])


_RAW = ("script", "style", "xmp", "iframe", "noembed", "noframes", "plaintext")
#: Attributes of HTML 4 that hold URIs (fixed values).
_URI_ATTRIBUTES = ("href", "src", "action", "background", "cite", "classid", "codebase", "data", "longdesc", "profile", "usemap")


def _html(nodes: DataFrame, attrs: Column, text: Column) -> DataFrame:
    kind = F.col("kind")
    opening = (
        F.when(kind == "element", F.concat(F.lit("<"), F.col("name"), attrs, F.lit(">")))
        .when(kind == "text", F.when(F.col("raw_"), F.col("content")).otherwise(text))
        .when(kind == "doctype", F.concat(F.lit("<!DOCTYPE "), F.coalesce("name", F.lit("")), F.when(F.length("content") > 0, F.concat(F.lit(" "), F.col("content"))).otherwise(""), F.lit(">")))
        .when(kind == "comment", F.concat(F.lit("<!--"), F.coalesce("content", F.lit("")), F.lit("-->")))
        .otherwise("")
    )
    closing = F.when((kind == "element") & ~F.col("name").isin(list(VOID)), F.concat(F.lit("</"), F.col("name"), F.lit(">"))).otherwise("")
    return _folded(nodes.withColumn("opening", opening).withColumn("closing", closing), ["doc_id"])


def _with_raw(nodes: DataFrame) -> DataFrame:
    raw = nodes.filter((F.col("kind") == "element") & F.col("name").isin(*_RAW)).select("doc_id", F.col("pre").alias("parent"), F.lit(True).alias("raw_"))
    return nodes.join(raw, ["doc_id", "parent"], "left")


def to_html(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): documents as HTML: void elements without end tags, script and style raw."""
    value = lambda v: _escape(v, (("&", "&amp;"), ("\xa0", "&nbsp;"), ('"', "&quot;")))
    text = _escape(F.col("content"), (("&", "&amp;"), ("\xa0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;")))
    return _html(_with_raw(nodes), _attrs(F.col("attrs"), value), text)


def _named_entities(s: Column) -> Column:
    """Characters beyond ASCII as the entities that HTML 4 names; those without a name stay."""
    names = F.create_map(*[F.lit(x) for code, name in sorted(codepoint2name.items()) if code > 127 for x in (chr(code), f"&{name};")])
    return F.when(s.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(names, c), c)), "")).otherwise(s)


def to_html4(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): documents by the habits of HTML 4.

    An attribute whose value is its own name is written as the name alone; a value with
    double quotes but no single ones stands in single quotes; blanks of URI attributes become
    %20; in documents that don't declare UTF-8 in a meta element, characters that have a named
    entity are written as it.  No line breaks are added.
    """
    content = lambda name: F.lower(F.coalesce(F.try_element_at(F.filter("attrs", lambda a: F.lower(a["name"]) == name), F.lit(1))["value"], F.lit("")))
    meta = nodes.filter((F.col("kind") == "element") & (F.lower("name") == "meta"))
    says = meta.filter((F.trim(content("charset")) == "utf-8") | ((content("http-equiv") == "content-type") & content("content").rlike(r"charset\s*=\s*[\"']?utf-8")))
    n = _with_raw(nodes).join(says.select("doc_id", F.lit(True).alias("utf8_")).distinct(), "doc_id", "left")
    coded = lambda s: F.when(F.col("utf8_"), s).otherwise(_named_entities(s))
    plain = lambda s: _escape(s, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))
    doubled = lambda s: F.replace(plain(s), F.lit('"'), F.lit("&quot;"))

    def one(a: Column) -> Column:
        v, name = a["value"], a["name"]
        single = v.contains('"') & ~v.contains("'")
        uri = F.lower(name).isin(*_URI_ATTRIBUTES)
        # The characters of every value are coded in one place, so that the map of names occurs once.
        inner = coded(F.when(single, plain(v)).when(uri, F.replace(doubled(v), F.lit(" "), F.lit("%20"))).otherwise(doubled(v)))
        quote = F.when(single, "'").otherwise('"')
        return F.concat(F.lit(" "), _qname(a["prefix"], name), F.when(v == name, "").otherwise(F.concat(F.lit("="), quote, inner, quote)))

    attrs = F.array_join(F.transform(F.coalesce("attrs", F.array().cast(nodes.schema["attrs"].dataType)), one), "")
    return _html(n, attrs, coded(plain(F.col("content"))))


def canonical(nodes: DataFrame, comments: bool = False, exclusive: bool = False, inclusive_prefixes: tuple[str, ...] = (), roots: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): Canonical XML, inclusive or exclusive, of whole documents or of a subtree of each.

    ``roots`` holds one element a document (the first counts); namespaces in force at it come
    from the whole document, and, if inclusive, so do xml: attributes that it doesn't have.

    Namespace declarations come first, by prefix, and only where they change what is in force
    (inclusive) or where a name uses them and no output ancestor has them so (exclusive);
    attributes follow, by namespace and local name.  What is in force comes from a join of
    each element with the declarations at or above it.
    """
    keep = F.col("kind") != "doctype"
    if not comments:
        keep = keep & (F.col("kind") != "comment")
    n = nodes.filter(keep)
    if roots is not None:
        n = _below(n, nodes, roots, exclusive)
    elements = n.filter("kind = 'element'")
    outside = (F.col("depth") == 1) & (F.col("kind") != "element")
    # Without a declaration nothing is in force anywhere: no joins. Without a node beside a root, none has a line of its own.
    declares = F.array_contains("attrs.prefix", "xmlns") | F.array_contains("attrs.name", "xmlns")
    declared, beside = nodes.agg(F.bool_or(F.coalesce(declares, F.array_contains("attrs.name", "xmlns"))), F.bool_or(outside)).first()
    rows = n.join(_namespaces(elements, nodes, exclusive, inclusive_prefixes), ["doc_id", "pre"], "left") if declared else n.withColumn("ns_", F.lit(""))
    plain = F.filter("attrs", lambda a: (F.coalesce(a["prefix"], F.lit("")) != "xmlns") & ~((a["name"] == "xmlns") & a["prefix"].isNull()))
    ordered = F.transform(F.sort_array(F.transform(plain, lambda a: F.struct(F.coalesce(a["namespace"], F.lit("")).alias("namespace"), a["name"].alias("name"), a["prefix"].alias("prefix"), a["value"].alias("value")))), lambda a: F.concat(F.lit(" "), _qname(a["prefix"], a["name"]), F.lit('="'), escape_attribute(a["value"]), F.lit('"')))
    kind, qname = F.col("kind"), _qname(F.col("prefix"), F.col("name"))
    text = _escape(F.col("content"), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#xD;")))
    body = F.when(kind == "element", F.concat(F.lit("<"), qname, F.coalesce("ns_", F.lit("")), F.when(F.size("attrs") > 0, F.array_join(ordered, "")).otherwise(""), F.lit(">"))).when(kind.isin("text", "cdata"), text).when(kind == "document", "").otherwise(_comment_like(kind))
    closing = F.when(kind == "element", F.concat(F.lit("</"), qname, F.lit(">"))).otherwise("")
    rows = rows.select("doc_id", "pre", "post", "depth", body.alias("opening"), closing.alias("closing"), outside.alias("outside_"), ((kind == "element") & (F.col("depth") == 1)).alias("root_"))
    if beside:
        # By the order in which the texts are put together, so that nothing is sorted twice.
        behind = F.bool_or("root_").over(Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("behind_", behind)
        lines = F.when(F.col("outside_") & F.col("behind_"), F.concat(F.lit("\n"), "opening")).when(F.col("outside_"), F.concat("opening", F.lit("\n"))).otherwise(F.col("opening"))
        rows = rows.withColumn("opening", lines)
    return _folded(rows, ["doc_id"])


def _namespaces(elements: DataFrame, nodes: DataFrame, exclusive: bool, inclusive_prefixes: tuple[str, ...]) -> DataFrame:
    """(doc_id, pre, ns_): the declarations that elements show, as text."""
    from thicket.operators.axes import in_scope_namespaces

    scope = in_scope_namespaces(elements, nodes)
    if exclusive:
        used = elements.select("doc_id", "pre", F.explode(F.array_union(F.array(F.coalesce("prefix", F.lit(""))), F.array_compact(F.transform("attrs", lambda a: F.when(a["prefix"] != "xmlns", a["prefix"]))))).alias("prefix"))
        used = used.union(elements.select("doc_id", "pre", F.explode(F.array(*[F.lit(p) for p in inclusive_prefixes]).cast("array<string>")).alias("prefix"))).distinct()
        shown = scope.join(used, ["doc_id", "pre", "prefix"], "left_semi")
    else:
        shown = scope
    # Output where the nearest output ancestor that shows the prefix has another value.
    post = elements.select("doc_id", "pre", "post")
    above = shown.join(post, ["doc_id", "pre"]).select(F.col("doc_id").alias("a_doc"), F.col("pre").alias("a_pre"), F.col("post").alias("a_post"), F.col("prefix").alias("a_prefix"), F.col("namespace").alias("a_ns"))
    pairs = shown.join(above, (F.col("doc_id") == F.col("a_doc")) & (F.col("prefix") == F.col("a_prefix")) & (F.col("a_pre") < F.col("pre")) & (F.col("a_post") >= F.col("pre")), "left")
    nearest = pairs.groupBy("doc_id", "pre", "prefix", "namespace").agg(F.max_by("a_ns", "a_pre").alias("before"))
    declared = nearest.filter("before is null or before <> namespace").select("doc_id", "pre", F.struct("prefix", "namespace").alias("d"))
    # An element out of every default namespace under one inside cancels it.
    default = scope.filter("prefix = ''").select("doc_id", F.col("pre").alias("parent"))
    bare = elements.filter("namespace is null").join(scope.filter("prefix = ''").select("doc_id", "pre"), ["doc_id", "pre"], "left_anti").join(default, ["doc_id", "parent"], "left_semi")
    declared = declared.unionByName(bare.select("doc_id", "pre", F.struct(F.lit("").alias("prefix"), F.lit("").alias("namespace")).alias("d")))
    return declared.groupBy("doc_id", "pre").agg(F.array_join(F.transform(F.sort_array(F.collect_list("d")), lambda x: F.concat(F.when(x["prefix"] == "", " xmlns").otherwise(F.concat(F.lit(" xmlns:"), x["prefix"])), F.lit('="'), escape_attribute(x["namespace"]), F.lit('"'))), "").alias("ns_"))


def _below(n: DataFrame, nodes: DataFrame, roots: DataFrame, exclusive: bool) -> DataFrame:
    """The rows at and below the first root of each document, which takes over xml: attributes from above."""
    apex = roots.groupBy(F.col("doc_id").alias("r_doc")).agg(F.min("pre").alias("r_pre"), F.min_by("post", "pre").alias("r_post"))
    n = n.join(apex, (F.col("doc_id") == F.col("r_doc")) & (F.col("pre") >= F.col("r_pre")) & (F.col("pre") <= F.col("r_post"))).drop("r_doc", "r_post")
    if exclusive:
        return n.drop("r_pre")
    above = nodes.filter("kind = 'element'").join(apex, (F.col("doc_id") == F.col("r_doc")) & (F.col("pre") < F.col("r_pre")) & (F.col("post") >= F.col("r_pre")))
    given = above.select("doc_id", "pre", F.explode(F.filter("attrs", lambda a: a["prefix"] == "xml")).alias("a")).groupBy("doc_id", "a.name").agg(F.max_by("a", "pre").alias("a"))
    taken = given.groupBy("doc_id").agg(F.collect_list("a").alias("given_"))
    n = n.join(taken, "doc_id", "left")
    own = F.transform(F.filter("attrs", lambda a: a["prefix"] == "xml"), lambda a: a["name"])
    more = F.filter(F.coalesce("given_", F.array().cast(n.schema["attrs"].dataType)), lambda a: ~F.array_contains(own, a["name"]))
    return n.withColumn("attrs", F.when(F.col("pre") == F.col("r_pre"), F.concat("attrs", more)).otherwise(F.col("attrs"))).drop("given_", "r_pre")


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Each root's subtree as a document of its own: doc_id stays, ``root`` names the root's ``pre``."""
    from thicket.operators.axes import below

    return below(nodes, roots).withColumnRenamed("c_pre", "root").drop("c_post")


def subtree_xml(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, root, text) of each root's subtree."""
    n = _has_content(subtree(nodes, roots))
    kind, qname = F.col("kind"), _qname(F.col("prefix"), F.col("name"))
    opening = F.when(kind == "element", F.concat(F.lit("<"), qname, _attrs(F.col("attrs"), _escape_attribute_xml), F.when(F.col("full_"), ">").otherwise("/>"))).when(kind.isin("text", "cdata"), escape_text(F.col("content"))).otherwise(_comment_like(kind))
    closing = F.when((kind == "element") & F.col("full_"), F.concat(F.lit("</"), qname, F.lit(">"))).otherwise("")
    return _folded(n.withColumn("opening", opening).withColumn("closing", closing), ["doc_id", "root"])


def debug_tree(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): one indented line per node."""
    label = F.concat_ws(" ", "kind", _qname(F.col("prefix"), F.col("name")), F.col("content"))
    lines = nodes.select("doc_id", "pre", F.concat(F.expr("repeat('  ', depth)"), label).alias("line"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "line"))), lambda x: x["line"]), "\n").alias("text"))


def set_encoding(text: Column, encoding: str) -> Column:
    """The XML declaration names the encoding; nothing is transcoded."""
    named = F.regexp_replace(text, r"^(<\?xml[^>]*?encoding=)([\"'])[^\"']*\2", f"$1$2{encoding}$2")
    added = F.regexp_replace(text, r"^(<\?xml\s+version=[\"'][^\"']*[\"'])", f'$1 encoding="{encoding}"')
    return F.when(text.rlike(r"^<\?xml[^>]*encoding="), named).otherwise(added)



