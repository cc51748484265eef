"""The node table: a parsed corpus as a DataFrame, one row per node.

``pre`` numbers a document's nodes in document order from 0 (the document node); ``post`` is
the last ``pre`` of the subtree, so d is below a if a.pre < d.pre <= a.post.  ``ord`` counts
siblings from 1, ``elem_ord`` and ``elem_ord_last`` element siblings from either end.
``path`` is the element path from the root, which turns absolute child paths into a filter; it
is null where it would be longer than ``MOST_PATH``, so that deep documents stay linear.

A doctype's ``content`` is what follows its name: public and system identifier, in quotes, and
the internal subset as it is written.

``string_value`` is a further column, made where it is asked for: the text below a document or an
element, null where it has over ``MOST_VALUE`` characters, so that the table stays linear.
"""

from __future__ import annotations

import pyarrow as pa

KINDS = ("document", "element", "text", "cdata", "comment", "pi", "doctype")

ATTR = "struct<name:string,value:string,prefix:string,namespace:string>"
NODES = f"""doc_id bigint, pre int, post int, parent int, depth int, ord int, elem_ord int, elem_ord_last int,
kind string, name string, prefix string, namespace string, attrs array<{ATTR}>, content string, path string, error string"""

_ATTR = pa.struct([("name", pa.string()), ("value", pa.string()), ("prefix", pa.string()), ("namespace", pa.string())])
ARROW = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int32()) for c in ("pre", "post", "parent", "depth", "ord", "elem_ord", "elem_ord_last")]
    + [(c, pa.string()) for c in ("kind", "name", "prefix", "namespace")]
    + [("attrs", pa.list_(_ATTR)), ("content", pa.string()), ("path", pa.string()), ("error", pa.string())]
)
KEY = ["doc_id", "pre"]
#: Characters of a path, and of a string-value that is kept, at most.
MOST_PATH, MOST_VALUE = 2048, 4096
VALUE = "string_value"
VALUE_FIELD = pa.field(VALUE, pa.string())
