"""A pull reader: the first events of documents, without parsing the rest of them."""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from thicket.schema import ARROW, ATTR
from thicket.sources.xml import _SEP, LimitError, ParseOptions

EVENT = f"seq int, event string, depth int, name string, prefix string, namespace string, attrs array<{ATTR}>, value string"
#: Characters that are given to the parser at a time.
SLICE = 1 << 14
#: Events after which a batch is given out.
BATCH = 20_000


class _Enough(Exception):
    """There are as many events as are asked for: the parser stops within its slice."""


def pull(text: str | bytes | None, most: int, o: ParseOptions):
    """At most ``most`` tuples (seq, event, depth, name, prefix, namespace, attrs, value) of a document's beginning.

    The events and their order are those of ``sources.events``; a document that isn't
    well-formed, or exceeds a limit, before the last of them ends in an ``error`` with the
    message as value.  Slices of the text are parsed until there are enough, the last of them
    only as far as its events go.
    """
    out: list[tuple] = [(0, "start_document", 0, None, None, None, None, None)]
    depth, kind, inside = 1, "text", False
    pieces: list[str] = []
    length = 0
    declared: list[tuple] = []

    def add(event, at, name=None, prefix=None, namespace=None, attrs=None, value=None):
        out.append((len(out), event, at, name, prefix, namespace, attrs, value))
        if len(out) >= most:
            raise _Enough

    def flush():
        nonlocal length
        if pieces:
            value = "".join(pieces)
            pieces.clear()
            length = 0
            add("cdata" if kind == "cdata" else "characters" if value.strip(" \t\r\n") else "whitespace", depth, value=value)

    def names(raw: str) -> tuple:
        if len(raw) > o.max_name_length:
            raise LimitError("name too long")
        parts = raw.split(_SEP)
        return (parts[1], parts[2] if len(parts) > 2 else None, parts[0]) if len(parts) > 1 else (raw, None, None)

    def start(raw, flat):
        nonlocal depth
        flush()
        if depth > o.max_depth:
            raise LimitError("elements nested too deep")
        if len(flat) > 2 * o.max_attributes:
            raise LimitError("too many attributes")
        attrs = list(declared)
        declared.clear()
        for k in range(0, len(flat), 2):
            if len(flat[k + 1]) > o.max_attribute_length:
                raise LimitError("attribute value too long")
            name, prefix, namespace = names(flat[k])
            attrs.append((name, flat[k + 1], prefix, namespace))
        add("start_element", depth, *names(raw), attrs)
        depth += 1

    def end(raw):
        nonlocal depth
        flush()
        depth -= 1
        add("end_element", depth, *names(raw))

    def chars(data):
        nonlocal length
        if depth > 1:
            pieces.append(data)
            length += len(data)
            if length > o.max_text_length:
                raise LimitError("text too long")

    def section(of_kind):
        nonlocal kind
        flush()
        kind = of_kind

    def leaf(event, name, value):
        flush()
        if not inside:
            add(event, depth, name, value=value)

    def doctype(name, system_id, public_id, has_subset):
        nonlocal inside
        leaf("doctype", name, None)
        inside = True

    def end_doctype():
        nonlocal inside
        inside = False

    parser = expat.ParserCreate(None, _SEP)
    parser.namespace_prefixes = parser.ordered_attributes = parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    parser.StartNamespaceDeclHandler = lambda prefix, uri: declared.append((prefix or "xmlns", uri or "", "xmlns" if prefix else None, "http://www.w3.org/2000/xmlns/"))
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = lambda: section("cdata"), lambda: section("text")
    parser.CommentHandler = lambda data: leaf("comment", None, data)
    parser.ProcessingInstructionHandler = lambda target, data: leaf("processing_instruction", target, data)
    parser.StartDoctypeDeclHandler, parser.EndDoctypeDeclHandler = doctype, end_doctype

    def external(context, base, system_id, public_id):
        if system_id in o.entities:  # nothing is ever fetched
            parser.ExternalEntityParserCreate(context).Parse(o.entities[system_id], True)
        return 1

    parser.ExternalEntityRefHandler = external
    text = text or ""
    text = text.lstrip("\ufeff") if isinstance(text, str) else bytes(text)
    try:
        try:
            for k in range(0, len(text) if most > 1 else 0, SLICE):
                parser.Parse(text[k : k + SLICE], False)
            if most > 1:
                parser.Parse(text[:0], True)
                add("end_document", 0)
        except (expat.ExpatError, LimitError, ValueError) as e:
            flush()
            add("error", depth, value=str(e))
    except _Enough:
        pass
    return out


def _rows(batches, most: int, o: ParseOptions):
    schema = pa.schema([("doc_id", pa.int64()), ("seq", pa.int32()), ("event", pa.string()), ("depth", pa.int32()), *[(c, pa.string()) for c in ("name", "prefix", "namespace")], ("attrs", ARROW.field("attrs").type), ("value", pa.string())])
    rows: list[tuple] = []

    def batch():
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        attrs = [None if x is None else [dict(zip(("name", "value", "prefix", "namespace"), a, strict=True)) for a in x] for x in columns[7]]
        arrays = [pa.array(attrs if k == 7 else x, f.type) for k, (x, f) in enumerate(zip(columns, schema, strict=True))]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows += [(doc_id, *e) for e in pull(text.as_py(), most, o)]
            if len(rows) > BATCH:
                yield batch()
        yield batch()


def first_events(docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text", options: ParseOptions | None = None) -> DataFrame:
    """(doc_id, seq, event, depth, name, prefix, namespace, attrs, value): the first ``most`` events of each document.

    Of a text only as much is parsed as these events take.  A null or empty text is a document
    that isn't well-formed.  A narrow transformation.
    """
    if most < 1:
        raise ValueError("at least one event")
    o = options or ParseOptions()
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lambda it: _rows(it, most, o), f"doc_id bigint, {EVENT}")


def register_reader(spark: SparkSession, name: str = "xml_events", options: ParseOptions | None = None) -> None:
    """A table function for SQL: SELECT ... FROM docs, LATERAL xml_events(text, 10)."""
    o = options or ParseOptions()

    class Reader:
        def eval(self, text: str, most: int):
            yield from pull(text, most, o)

    spark.udtf.register(name, udtf(Reader, returnType=EVENT))
