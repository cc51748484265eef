"""XML documents to the node table: plain ones by the batch (``plain``), others by expat; no shuffle."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.schema import ARROW, NODES, VALUE
from thicket.sources.plain import plain_nodes, slices
from thicket.sources.tree import CDATA, COMMENT, DOCTYPE, PI, TEXT, Nodes, record_batch

_SEP = "\x1f"


@dataclass(frozen=True)
class ParseOptions:
    """Limits and switches of the XML parser; a document beyond a limit has an error."""

    recover: bool = False
    no_blanks: bool = False
    max_depth: int = 256
    max_attributes: int = 256
    max_attribute_length: int = 10_000_000
    max_text_length: int = 10_000_000
    max_name_length: int = 50_000
    max_entity_expansions: int = 10_000
    #: Texts of external entities by system id; others stay out, and nothing is ever fetched.
    entities: dict[str, str] = field(default_factory=dict)
    #: Of HTML: only references that end with a semicolon are resolved, as XML has it; others are text.
    ended_references: bool = False


class LimitError(ValueError):
    pass


_REFERENCE = re.compile(r"&([^#;&\s][^;&\s]*);")


def expansions(body: str, entities: dict[str, str], most: int) -> int:
    """How many internal entities the references of a document's body expand to, those within entities included.

    Counted from the declarations, before anything is expanded; what expat doesn't let through
    (an entity within itself) counts as over ``most``.
    """
    weight: dict[str, int] = {}

    def of(name: str, above: tuple[str, ...] = ()) -> int:
        if name in above or len(above) > 200:
            return most + 1
        if name not in weight:
            weight[name] = 1 + sum(of(x, (*above, name)) for x in _REFERENCE.findall(entities[name]) if x in entities)
        return weight[name]

    body = re.sub(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>", "", body, flags=re.S)
    return sum(of(x) for x in _REFERENCE.findall(body) if x in entities)


def _quoted(x: str) -> str:
    return f"'{x}'" if '"' in x else f'"{x}"'


def _between(raw: bytes, start: int, end: int | None) -> str:
    """Bytes of a document as text; the places are expat's."""
    coding = "utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else (m[1].decode() if (m := re.match(rb"<\?xml[^>]*?encoding\s*=\s*[\"']([\w.-]+)", raw)) else "utf-8")
    try:
        if coding == "utf-16":
            return raw[start:end].decode("utf-16-be" if raw[:2] == b"\xfe\xff" else "utf-16-le", "replace")
        return raw[start:end].decode(coding, "replace")
    except LookupError:
        return raw[start:end].decode("utf-8", "replace")


def xml_reader(nodes: Nodes, o: ParseOptions):
    """A function that appends the nodes of a document, by its id and text, to ``nodes``."""
    code, spot, content, owner, attributes = nodes.code, nodes.spot, nodes.content, nodes.owner, nodes.attributes
    add_code, add_spot, add_content = code.append, spot.append, content.append
    below, spot_below = nodes.below, nodes.spot_below
    known: dict[str, tuple] = {}  # names, taken apart
    numbers: dict[str, int] = {}  # those of elements, as numbers of nodes.names
    max_depth, max_value, max_attrs, max_text = o.max_depth, o.max_attribute_length, 2 * o.max_attributes, o.max_text_length
    # What follows is the document's that is being read.
    opened: list[int] = []  # spots of what is open, the document first
    declared: list[tuple[str, str]] = []  # namespaces, of the element that comes
    internal: dict[str, str] = {}
    text, parser, kind, expanded, subset, body = "", None, TEXT, 0, None, 0
    running, length, pieces = -1, 0, None  # the kind of the text node that came last, its length, its pieces if several

    def cut():
        """What follows is no part of the text node that came last."""
        nonlocal running, pieces
        if pieces is not None:
            content[-1] = "".join(pieces)
            pieces = None
        running = -1

    def split(name):
        parts = name.split(_SEP)
        if len(name) > o.max_name_length:
            raise LimitError("name too long")
        known[name] = out = (parts[1], parts[2] if len(parts) > 2 else None, parts[0]) if len(parts) > 1 else (name, None, None)
        return out

    def raw() -> bytes:
        return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text

    def expand(n: int):
        nonlocal expanded
        expanded += n
        if expanded > o.max_entity_expansions:
            raise LimitError("too many entity expansions")

    def start(name, flat):
        nonlocal running, pieces
        if pieces is not None:
            cut()
        running = -1
        if internal:
            of_body = expansions(_between(raw(), body, None), internal, o.max_entity_expansions)
            internal.clear()
            expand(of_body)
        depth = len(opened)
        if depth > max_depth:
            raise LimitError("elements nested too deep")
        number = numbers.get(name)
        if number is None:
            number = numbers[name] = nodes.name_of(*(known.get(name) or split(name)))
        above = opened[-1]
        place = below.get((above, number))
        if place is None:
            place = spot_below(above, number)
        if flat or declared:
            if len(flat) > max_attrs:
                raise LimitError("too many attributes")
            at = len(code)
            for k, v in declared:
                owner.append(at)
                attributes.append((k or "xmlns", v, "xmlns" if k else None, "http://www.w3.org/2000/xmlns/"))
            declared.clear()
            for k in range(0, len(flat), 2):
                value = flat[k + 1]
                if len(value) > max_value:
                    raise LimitError("attribute value too long")
                n, prefix, ns = known.get(flat[k]) or split(flat[k])
                owner.append(at)
                attributes.append((n, value, prefix, ns))
        add_code(8 * depth + 1)
        add_spot(place)
        add_content(None)
        opened.append(place)

    def end(name):
        nonlocal running, pieces
        if pieces is not None:
            cut()
        running = -1
        opened.pop()

    def chars(data):
        nonlocal running, length, pieces
        if running == kind:
            if pieces is None:
                pieces = [content[-1]]
            pieces.append(data)
            length += len(data)
        else:
            if pieces is not None:
                cut()
            depth = len(opened)
            if depth == 1:
                return
            add_code(8 * depth + kind)
            add_spot(1)
            add_content(data)
            running, length = kind, len(data)
        if length > max_text:
            raise LimitError("text too long")

    def leaf(of_kind, name, data):
        cut()
        nodes.add(of_kind, len(opened), nodes.spot_of(nodes.name_of(name)), data)

    def outside() -> bool:
        return subset is None or body > 0  # not within the doctype, whose subset is kept as it is written

    def external(context, base, system_id, public_id):
        expand(1)
        if system_id in o.entities:
            parser.ExternalEntityParserCreate(context).Parse(o.entities[system_id], True)
        return 1

    def doctype(name, system_id, public_id, has_subset):
        nonlocal subset
        ids = f"PUBLIC {_quoted(public_id)} {_quoted(system_id)}" if public_id and system_id else f"SYSTEM {_quoted(system_id)}" if system_id else None
        subset = (parser.CurrentByteIndex if has_subset else None, len(code), ids)  # where the subset begins
        leaf(DOCTYPE, name, ids)

    def end_doctype():
        nonlocal body
        begin, row, ids = subset
        body = parser.CurrentByteIndex
        if begin is not None:
            content[row] = " ".join(x for x in (ids, _between(raw(), begin, body).rstrip()) if x)

    def section(of_kind):
        nonlocal kind
        cut()
        kind = of_kind

    handlers = {
        "StartElementHandler": start, "EndElementHandler": end, "CharacterDataHandler": chars, "StartNamespaceDeclHandler": lambda prefix, uri: declared.append((prefix, uri or "")),
        "StartCdataSectionHandler": lambda: section(CDATA), "EndCdataSectionHandler": lambda: section(TEXT), "CommentHandler": lambda data: leaf(COMMENT, None, data) if outside() else None,
        "ProcessingInstructionHandler": lambda target, data: leaf(PI, target, data) if outside() else None, "StartDoctypeDeclHandler": doctype, "EndDoctypeDeclHandler": end_doctype,
        "EntityDeclHandler": lambda name, parameter, value, *_: internal.setdefault(name, value) if value is not None and not parameter else None, "ExternalEntityRefHandler": external,
    }
    interned: dict[str, str] = {}

    def parse(doc_id, document) -> None:
        nonlocal text, parser, kind, expanded, subset, body, running, pieces
        text = document.lstrip("\ufeff") if isinstance(document, str) else bytes(document)
        kind, expanded, subset, body, running, pieces = TEXT, 0, None, 0, -1, None
        opened[:] = [0]
        declared.clear()
        internal.clear()
        parser = expat.ParserCreate(None, _SEP, interned)
        parser.namespace_prefixes = parser.ordered_attributes = parser.buffer_text = True
        for name, f in handlers.items():
            setattr(parser, name, f)
        mark, error = nodes.begin(doc_id), None
        try:
            parser.Parse(text, True)
        except (expat.ExpatError, LimitError, ValueError) as e:
            error = str(e)
        if error and not o.recover:
            pieces = None
            nodes.drop(mark)
        cut()
        # An element that a limit stopped may have left attributes without it.
        while owner and owner[-1] >= len(code):
            owner.pop()
            attributes.pop()
        nodes.end(mark, error)

    return parse


#: Nodes after which a batch is given out.
BATCH = 20_000


def _each(ids: list, texts, o: ParseOptions, reader, columns: list[str], paths: frozenset[str] | None):
    """Batches of nodes of documents that are read one by one."""
    nodes = Nodes()
    parse = reader(nodes, o)
    for doc_id, text in zip(ids, texts, strict=True):
        parse(doc_id, text.as_py() or "")
        if len(nodes) > BATCH:
            yield record_batch(nodes, columns, paths)
            nodes = Nodes()
            parse = reader(nodes, o)
    yield record_batch(nodes, columns, paths)


def _rows(batches, o: ParseOptions, reader, columns: list[str], paths: frozenset[str] | None, plain: bool = False):
    """Batches of nodes; with ``plain``, plain documents are read many at once, and the reader gets the others."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1)
        if not (plain and pa.types.is_string(texts.type)):
            yield from _each(ids, texts, o, reader, columns, paths)
            continue
        for begin, end in slices(texts):
            some, few = ids[begin:end], texts.slice(begin, end - begin)
            nodes, left = plain_nodes(some, few, o)
            if nodes is not None:
                yield record_batch(nodes, columns, paths)
            if len(left):
                yield from _each([some[i] for i in left], few.take(pa.array(left)), o, reader, columns, paths)


def wanted_columns(columns: list[str] | None) -> tuple[list[str], str]:
    """The node table's columns that are asked for, in its order, and their schema; string-values are not in it without."""
    every = dict(zip([*ARROW.names, VALUE], re.split(r",\s*(?=[a-z_]+ )", f"{NODES}, {VALUE} string"), strict=True))
    unknown = set(columns or ()) - set(every)
    if unknown:
        raise ValueError(f"no such columns of the node table: {sorted(unknown)}")
    names = [c for c in every if c in (ARROW.names if columns is None else columns)]
    return names, ", ".join(every[c] for c in names)


def parse_xml(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: ParseOptions | None = None, columns: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """The node table of a column of XML texts (string or bytes with a byte order mark or declaration).

    Every document has at least its document node; the document node's ``error`` says why a
    document isn't well-formed or what limit it exceeds, and the job goes on.  With
    ``recover``, the nodes before the error stay and open elements are closed.

    What a query doesn't need is best left out here, for the optimizer can't see into the
    parser: of ``columns``, only these are made and sent; of ``paths`` (element paths such as
    /order/item), only document nodes, the elements there and their texts.  Numbers are
    those of the whole document either way.
    """
    o = options or ParseOptions()
    names, schema = wanted_columns(columns)
    only = None if paths is None else frozenset(paths)
    nodes = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lambda it: _rows(it, o, xml_reader, names, only, plain=True), schema)
    if o.no_blanks:
        nodes = drop_blanks(nodes)
    return nodes


def drop_blanks(nodes: DataFrame) -> DataFrame:
    """Without text nodes of white space alone (numbers keep their gaps; see operators.edit.renumber)."""
    return nodes.drop(VALUE).filter((F.col("kind") != "text") | F.col("content").rlike(r"[^ \t\r\n]"))


def read_xml(spark: SparkSession, path: str, options: ParseOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs, nodes) of XML files: bytes are read whole, decoded as they declare, and parsed."""
    files = spark.read.format("binaryFile").load(path)
    docs = files.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("uri"), "content")
    return docs.drop("content"), parse_xml(docs, text_col="content", options=options)
