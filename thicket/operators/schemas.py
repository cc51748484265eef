"""Schemas from their own documents: XML Schema and RelaxNG as tree grammars, Schematron as expressions.

A schema is a small document, read once on the driver; what it says becomes a ``Grammar`` or
the columns of rules, and documents are validated as DataFrames.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field, replace
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.types import BUILTIN, facets_ok, list_of
from thicket.operators.content import EMPTY, Model, el, interleave, one_of, seq, times
from thicket.operators.expressions import Compiler, Contexts, Reader
from thicket.operators.grammar import Attribute, Grammar, Test, Type

XS, RNG, SCH = "http://www.w3.org/2001/XMLSchema", "http://relaxng.org/ns/structure/1.0", "http://purl.oclc.org/dsdl/schematron"
#: Ways in which an element's attributes and text may be combined with choices.
MOST_WAYS = 256


class SchemaError(ValueError):
    """A schema that can't be read, or that says what isn't supported."""


def _read(text: str | bytes) -> tuple[ElementTree.Element, dict[str, str]]:
    """The root of a schema document, and its prefixes."""
    prefixes: dict[str, str] = {}
    root = None
    try:
        for event, x in ElementTree.iterparse(io.BytesIO(text.encode() if isinstance(text, str) else text), ("start-ns", "start")):
            if event == "start-ns":
                prefixes.setdefault(x[0], x[1])
            elif root is None:
                root = x
    except ElementTree.ParseError as e:
        raise SchemaError(f"the schema isn't well-formed: {e}") from e
    return root, prefixes


def _local(x: ElementTree.Element) -> str:
    return x.tag.rpartition("}")[2] if isinstance(x.tag, str) else ""


def _all_of(tests: list[Test]) -> Test:
    def ok(v: Column) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & F.coalesce(t(v), F.lit(False))
        return out

    return ok


def _any_of(tests: list[Test]) -> Test:
    def ok(v: Column) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | F.coalesce(t(v), F.lit(False))
        return out

    return ok


# XML Schema


class _Xsd:
    def __init__(self, resources: dict[str, str]):
        self.resources, self.types, self.seen = resources, {}, set()
        self.named: dict[tuple[str, str, str], tuple[ElementTree.Element, _Schema]] = {}  # kind, namespace, name
        self.starts: list[str] = []

    def load(self, text: str, as_namespace: str | None = None) -> _Schema:
        root, prefixes = _read(text)
        if root is None or root.tag != f"{{{XS}}}schema":
            raise SchemaError("no schema element of XML Schema")
        target = root.get("targetNamespace") or as_namespace or ""
        schema = _Schema(target, prefixes, root.get("elementFormDefault") == "qualified", root.get("attributeFormDefault") == "qualified")
        for x in root:
            kind = _local(x)
            if kind in ("include", "import", "redefine"):
                place = x.get("schemaLocation")
                if place is None:
                    continue
                if place not in self.resources:
                    raise SchemaError(f"{kind} of {place!r}, which isn't among the resources")
                key = (place, target if kind == "include" else None)
                if key not in self.seen:  # schemas may include each other in circles
                    self.seen.add(key)
                    self.load(self.resources[place], target if kind == "include" else None)
            elif x.get("name"):
                self.named.setdefault((kind, target, x.get("name")), (x, schema))
        return schema

    def find(self, kind: str, qname: str, schema: _Schema):
        prefix, _, name = qname.rpartition(":")
        namespace = schema.prefixes.get(prefix, schema.target if not prefix else None)
        if namespace is None:
            raise SchemaError(f"no namespace for the prefix of {qname!r}")
        return namespace, name, self.named.get((kind, namespace, name)) or (self.named.get((kind, schema.target, name)) if not prefix else None)

    def element(self, x: ElementTree.Element, schema: _Schema, at_top: bool = False) -> str:
        """The type, by key, of an element's declaration or reference."""
        if ref := x.get("ref"):
            _, _, found = self.find("element", ref, schema)
            if not found:
                raise SchemaError(f"no element {ref!r}")
            return self.element(*found, at_top=True)
        key = f"{x.get('name')}#{id(x)}"
        if key in self.types:
            return key
        namespace = schema.target if at_top or (x.get("form") == "qualified" if x.get("form") else schema.qualified) else ""
        t = self.types[key] = Type(x.get("name"), namespace=namespace)
        inner = next((c for c in x if _local(c) in ("complexType", "simpleType")), None)
        if inner is not None:
            self.fill(t, inner, schema)
        elif kind := x.get("type"):
            self.fill_named(t, kind, schema)
        else:
            t.content, t.text, t.attributes = None, "mixed", None
        if (fixed := x.get("fixed")) is not None:
            own = t.text if callable(t.text) else BUILTIN["string"]
            t.text = _all_of([own, lambda v: v == fixed])
        if x.get("nillable") == "true":
            nil = Type(t.name, EMPTY, None, [Attribute("nil", lambda v: v.isin("true", "1"), True, "http://www.w3.org/2001/XMLSchema-instance"), *(t.attributes or [])], namespace)
            self.types[key + "-nil"] = nil
        return key

    def fill_named(self, t: Type, kind: str, schema: _Schema) -> None:
        namespace, name, found = self.find("complexType", kind, schema)
        if found:
            self.fill(t, *found)
        elif namespace == XS and name == "anyType":
            t.content, t.text, t.attributes = None, "mixed", None
        else:
            t.text = self.simple_named(kind, schema)

    def simple_named(self, kind: str, schema: _Schema) -> Test:
        namespace, name, found = self.find("simpleType", kind, schema)
        if found:
            return self.simple(*found)[0]
        if namespace == XS and name in BUILTIN:
            return BUILTIN[name]
        if namespace == XS and name in ("IDREFS", "NMTOKENS", "ENTITIES"):
            return list_of("NMTOKEN")
        if namespace == XS and name in ("NCName", "Name", "QName", "language", "ENTITY", "anySimpleType"):
            return BUILTIN["token" if name != "anySimpleType" else "string"]
        raise SchemaError(f"no type {kind!r}")

    def base_of(self, kind: str, schema: _Schema) -> str:
        """The built-in type that a simple type comes from: by it, facets compare."""
        namespace, name, found = self.find("simpleType", kind, schema)
        if found:
            return self.simple(*found)[1]
        return name if name in BUILTIN else "string"

    def simple(self, x: ElementTree.Element, schema: _Schema) -> tuple[Test, str]:
        """The test of a simple type, and the built-in type beneath it."""
        for c in x:
            kind = _local(c)
            inner = next((y for y in c if _local(y) == "simpleType"), None)
            if kind == "restriction":
                return self.restricted(c, schema)
            if kind == "list":
                item = self.simple(inner, schema)[0] if inner is not None else self.simple_named(c.get("itemType"), schema)
                return (lambda v, item=item: F.forall(F.filter(F.split(F.trim(v), r"\s+"), lambda y: y != ""), lambda y: F.coalesce(item(y), F.lit(False)))), "string"
            if kind == "union":
                members = [self.simple_named(m, schema) for m in (c.get("memberTypes") or "").split()]
                return _any_of(members + [self.simple(y, schema)[0] for y in c if _local(y) == "simpleType"]), "string"
        raise SchemaError("a simple type without restriction, list or union")

    def restricted(self, c: ElementTree.Element, schema: _Schema) -> tuple[Test, str]:
        inner = next((y for y in c if _local(y) == "simpleType"), None)
        if inner is not None:
            own, base = self.simple(inner, schema)
        else:
            own, base = self.simple_named(c.get("base"), schema), self.base_of(c.get("base"), schema)
        facets: dict[str, object] = {}
        for y in c:
            name, value = _local(y), y.get("value")
            if name == "enumeration":
                facets.setdefault("enumeration", []).append(value)
            elif name == "pattern":
                facets["pattern"] = f"{facets['pattern']}|{value}" if "pattern" in facets else value
            elif name in ("length", "minLength", "maxLength", "totalDigits", "fractionDigits"):
                facets[name] = int(value)
            elif name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "whiteSpace"):
                facets[name] = value
        return _all_of([own, lambda v: facets_ok(v, base, facets)]), base

    def fill(self, t: Type, x: ElementTree.Element, schema: _Schema) -> None:
        """What a complex or simple type says goes into a type of elements."""
        if _local(x) == "simpleType":
            t.text = self.simple(x, schema)[0]
            return
        if x.get("mixed") == "true":
            t.text = "mixed"
        for c in x:
            if _local(c) in ("simpleContent", "complexContent"):
                if c.get("mixed") == "true":
                    t.text = "mixed"
                for d in c:
                    self.derived(t, d, schema, _local(c) == "simpleContent")
                return
        t.content, t.attributes = self.content(x, schema), self.attributes(x, schema)

    def derived(self, t: Type, d: ElementTree.Element, schema: _Schema, simple: bool) -> None:
        base = Type(t.name, namespace=t.namespace)
        if (d.get("base") or "").rpartition(":")[2] != "anyType":
            self.fill_named(base, d.get("base"), schema)
        own = self.attributes(d, schema)
        if _local(d) == "extension":
            t.text = base.text if base.text is not None else t.text
            t.attributes = [*(base.attributes or []), *own]
            t.content = base.content if simple else seq(base.content or EMPTY, self.content(d, schema))
            return
        kept = {(a.namespace, a.name) for a in own}
        t.attributes = [*own, *(a for a in base.attributes or [] if (a.namespace, a.name) not in kept)]
        if simple:
            facets = [y for y in d if _local(y) not in ("attribute", "attributeGroup", "anyAttribute")]
            inner = ElementTree.Element(f"{{{XS}}}restriction", {"base": "string"})
            inner.extend(facets)
            own_test = self.restricted_text(inner, base)
            t.text = own_test
        else:
            t.text, t.content = base.text if t.text is None else t.text, self.content(d, schema)

    def restricted_text(self, inner: ElementTree.Element, base: Type) -> Test:
        facets = _Schema("", {"": XS}, False, False)
        return _all_of([*([base.text] if callable(base.text) else []), self.restricted(inner, facets)[0]])

    def content(self, x: ElementTree.Element, schema: _Schema) -> Model | None:
        parts = [self.particle(c, schema) for c in x if _local(c) in ("sequence", "choice", "all", "group")]
        if any(p is None for p in parts):
            return None
        return parts[0] if parts else EMPTY

    def particle(self, c: ElementTree.Element, schema: _Schema) -> Model | None:
        """A part of a content model; None where anything may stand there."""
        kind = _local(c)
        low = int(c.get("minOccurs", 1))
        high = None if c.get("maxOccurs") == "unbounded" else int(c.get("maxOccurs", 1))
        if kind == "any":
            return None
        if kind == "element":
            key = self.element(c, schema)
            m = one_of(el(key), el(key + "-nil")) if key + "-nil" in self.types else el(key)
        elif kind == "group":
            if c.get("ref"):
                _, _, found = self.find("group", c.get("ref"), schema)
                if not found:
                    raise SchemaError(f"no group {c.get('ref')!r}")
                m = self.content(*found)
            else:
                m = self.content(c, schema)
        elif kind == "all":
            counts = []
            for y in c:
                if _local(y) == "element":
                    key, least = self.element(y, schema), int(y.get("minOccurs", 1))
                    most = None if y.get("maxOccurs") == "unbounded" else int(y.get("maxOccurs", 1))
                    counts.append((key, 0 if low == 0 else least, most))
            return interleave(*counts)
        else:
            parts = [self.particle(y, schema) for y in c if _local(y) in ("element", "sequence", "choice", "group", "any")]
            if any(p is None for p in parts):
                return None
            m = seq(*parts) if kind == "sequence" else one_of(*parts)
        if m is None or (low, high) == (1, 1):
            return m
        return times(m, low, high)

    def attributes(self, x: ElementTree.Element, schema: _Schema) -> list[Attribute] | None:
        out: list[Attribute] = []
        for c in x:
            kind = _local(c)
            if kind == "anyAttribute":
                return None
            if kind == "attributeGroup" and c.get("ref"):
                _, _, found = self.find("attributeGroup", c.get("ref"), schema)
                if not found:
                    raise SchemaError(f"no attribute group {c.get('ref')!r}")
                out += self.attributes(*found) or []
            if kind == "attribute" and c.get("use") != "prohibited":
                out.append(self.attribute(c, schema))
        return out

    def attribute(self, c: ElementTree.Element, schema: _Schema, at_top: bool = False) -> Attribute:
        required = c.get("use") == "required"
        if ref := c.get("ref"):
            _, _, found = self.find("attribute", ref, schema)
            if not found:
                raise SchemaError(f"no attribute {ref!r}")
            a = self.attribute(*found, at_top=True)
            return Attribute(a.name, a.test, required, a.namespace)
        inner = next((y for y in c if _local(y) == "simpleType"), None)
        test = self.simple(inner, schema)[0] if inner is not None else self.simple_named(c.get("type"), schema) if c.get("type") else None
        if (fixed := c.get("fixed")) is not None:
            test = _all_of([*([test] if test else []), lambda v: v == fixed])
        qualified = at_top or (c.get("form") == "qualified" if c.get("form") else schema.qualified_attributes)
        return Attribute(c.get("name"), test, required, schema.target if qualified else "")


@dataclass
class _Schema:
    target: str
    prefixes: dict[str, str]
    qualified: bool
    qualified_attributes: bool


def xml_schema(text: str, resources: dict[str, str] | None = None) -> Grammar:
    """The grammar of an XML Schema document.

    Global and local elements, named and anonymous types, sequence, choice, all, groups,
    occurrence bounds, any, nillable, extension and restriction, simple types with facets, list
    and union, attributes and their groups, use and fixed, and qualified forms.  include and
    import take their documents from ``resources`` (schemaLocation -> text); an included one
    without a target namespace takes that of its includer, and circles end.  Elements of one
    name may have different types in different places.  Keys and uniqueness are not read.
    """
    x = _Xsd(resources or {})
    x.load(text)
    start = []
    for (kind, _, _), found in list(x.named.items()):
        if kind == "element" and found[0].get("abstract") != "true":
            key = x.element(*found, at_top=True)
            start += [k for k in (key, key + "-nil") if k in x.types]
    if not start:
        raise SchemaError("the schema has no global element")
    return Grammar(x.types, start)


# RelaxNG


@dataclass
class _Way:
    """One combination of what an element's pattern allows."""

    model: Model = EMPTY
    attributes: tuple[Attribute, ...] = ()
    text: str | Test | None = None
    any_attribute: bool = False


class _RelaxNg:
    def __init__(self, resources: dict[str, str]):
        self.resources, self.defines, self.types, self.keys, self.prefixes = resources, {}, {}, {}, {}
        self.all_of: dict[str, list[str]] = {}
        self.kept: list[ElementTree.Element] = []  # elements are told apart by where they lie

    def load(self, text: str, depth: int = 0) -> ElementTree.Element:
        root, prefixes = _read(text)
        if root is None or not root.tag.startswith(f"{{{RNG}}}"):
            raise SchemaError("no RelaxNG pattern")
        if depth > 50:
            raise SchemaError("includes lie over 50 deep or in a circle")
        self.prefixes = prefixes | self.prefixes
        if _local(root) == "grammar":
            self.collect(root, depth)
        return root

    def collect(self, grammar: ElementTree.Element, depth: int) -> None:
        for c in grammar:
            kind = _local(c)
            if kind in ("start", "define"):
                name = c.get("name") if kind == "define" else "#start"
                self.defines.setdefault(name, []).append(c)
            elif kind == "div":
                self.collect(c, depth)
            elif kind == "include":
                href = c.get("href")
                if href not in self.resources:
                    raise SchemaError(f"include of {href!r}, which isn't among the resources")
                before = dict(self.defines)
                self.load(self.resources[href], depth + 1)
                for own in c:  # what the include element redefines
                    name = own.get("name") if _local(own) == "define" else "#start"
                    self.defines[name] = before.get(name, []) + [own]

    def definition(self, name: str) -> ElementTree.Element:
        found = self.defines.get(name)
        if not found:
            raise SchemaError(f"no definition of {name!r}")
        if len(found) == 1:
            out = ElementTree.Element(f"{{{RNG}}}group")
            out.extend(list(found[0]))
            return out
        how = next((d.get("combine") for d in found if d.get("combine")), "choice")
        out = ElementTree.Element(f"{{{RNG}}}{how}")
        for d in found:
            inner = ElementTree.SubElement(out, f"{{{RNG}}}group")
            inner.extend(list(d))
        return out

    def element(self, x: ElementTree.Element, ns: str, refs: tuple[str, ...]) -> Model:
        """The choice of the types that an element pattern stands for."""
        if id(x) not in self.keys:
            ns = x.get("ns", ns)
            body = list(x)
            names, namespace = [x.get("name")], ns
            if names == [None]:
                names, namespace = self.name_class(body.pop(0), ns)
            elif ":" in names[0]:
                prefix, names = names[0].split(":")[0], [names[0].split(":")[1]]
                namespace = self.prefixes.get(prefix, ns)
            keys = self.keys[id(x)] = []
            holder = ElementTree.Element(f"{{{RNG}}}group")
            holder.extend(body)
            # A type that holds itself is known by its keys before its content is read; all its
            # types are put in for the first one at the end.
            keys += [f"{n}#{len(self.types)}-{k}" for k, n in enumerate(names)]
            self.kept.append(x)
            for key, n in zip(keys, names, strict=True):
                self.types[key] = Type(n, namespace=namespace)
            ways = self.ways(holder, ns, ())
            if not ways:
                raise SchemaError(f"nothing is allowed in element {names[0]}")
            for key, n in zip(keys, names, strict=True):
                self.all_of[key] = [key, *(f"{key}/{k}" for k in range(1, len(ways)))]
                for own, w in zip(self.all_of[key], ways, strict=True):
                    self.types[own] = Type(n, w.model, w.text, None if w.any_attribute else list(w.attributes), namespace)
        return one_of(*map(el, self.keys[id(x)]))

    def expanded(self, m: Model) -> Model:
        """A model in which each element's key stands for all its types."""
        if m.kind == "name":
            mine = self.all_of.get(m.name, [m.name])
            return m if len(mine) == 1 else one_of(*map(el, mine))
        if m.kind == "all":
            if any(len(self.all_of.get(n, [n])) > 1 for n, *_ in m.counts):
                raise SchemaError("an element of several types within interleave isn't supported")
            return m
        return replace(m, parts=tuple(self.expanded(p) for p in m.parts))

    def name_class(self, x: ElementTree.Element, ns: str) -> tuple[list[str], str]:
        if _local(x) == "name":
            return [(x.text or "").strip().rpartition(":")[2]], x.get("ns", ns)
        if _local(x) == "choice":
            found = [self.name_class(c, ns) for c in x]
            if len({f[1] for f in found}) == 1:
                return [n for f in found for n in f[0]], found[0][1]
        raise SchemaError(f"names by {_local(x)} aren't supported")

    def ways(self, x: ElementTree.Element, ns: str, refs: tuple[str, ...]) -> list[_Way]:
        kind, ns = _local(x), x.get("ns", ns)
        inner = [c for c in x if isinstance(c.tag, str) and c.tag.startswith(f"{{{RNG}}}")]
        if kind == "element":
            return [_Way(self.element(x, ns, refs))]
        if kind == "attribute":
            return self.attribute(x, inner, ns)
        if kind in ("text", "mixed"):
            return [_Way(w.model, w.attributes, "mixed", w.any_attribute) for w in (self.joined(inner, ns, refs) if kind == "mixed" else [_Way()])]
        if kind in ("data", "value", "list"):
            return [_Way(text=self.value_test(x, inner))]
        if kind == "empty":
            return [_Way()]
        if kind == "notAllowed":
            return []
        if kind in ("ref", "parentRef"):
            if x.get("name") in refs:
                raise SchemaError(f"{x.get('name')!r} refers to itself outside an element")
            return self.ways(self.definition(x.get("name")), ns, (*refs, x.get("name")))
        if kind == "externalRef":
            if x.get("href") not in self.resources:
                raise SchemaError(f"reference to {x.get('href')!r}, which isn't among the resources")
            return self.ways(_read(self.resources[x.get("href")])[0], ns, refs)
        if kind == "grammar":
            return self.ways(self.definition("#start"), ns, refs)
        if kind == "group":
            return self.joined(inner, ns, refs)
        if kind == "interleave":
            return self.interleaved(inner, ns, refs)
        if kind == "choice":
            return self.merged([w for c in inner for w in self.ways(c, ns, refs)])
        if kind == "optional":
            ways = self.joined(inner, ns, refs)
            if len(ways) == 1 and ways[0].text is None and not ways[0].any_attribute and (len(ways[0].attributes) == 1 and ways[0].model == EMPTY):
                a = ways[0].attributes[0]
                return [_Way(attributes=(Attribute(a.name, a.test, False, a.namespace),))]
            return self.merged([*ways, _Way()])
        if kind in ("zeroOrMore", "oneOrMore"):
            ways = self.joined(inner, ns, refs)
            if all(not w.attributes and w.text in (None, "mixed") for w in ways):
                text = "mixed" if any(w.text for w in ways) else None
                return [_Way(times(one_of(*[w.model for w in ways]), int(kind == "oneOrMore")), (), text, any(w.any_attribute for w in ways))]
            if all(w.any_attribute and w.model == EMPTY for w in ways):
                return ways
        raise SchemaError(f"{kind} isn't supported where it stands")

    @staticmethod
    def merged(ways: list[_Way]) -> list[_Way]:
        """Ways that differ in their models alone are one."""
        out: list[_Way] = []
        for w in ways:
            same = next((o for o in out if not o.attributes and not w.attributes and o.text == w.text and o.any_attribute == w.any_attribute and "all" not in (o.model.kind, w.model.kind)), None)
            if same is None:
                out.append(w)
            else:
                out[out.index(same)] = _Way(one_of(same.model, w.model), (), w.text, w.any_attribute)
        return out

    def joined(self, parts: list[ElementTree.Element], ns: str, refs: tuple[str, ...]) -> list[_Way]:
        out = [_Way()]
        for p in parts:
            more = self.ways(p, ns, refs)
            out = [self.both(a, b) for a in out for b in more]
            if len(out) > MOST_WAYS:
                raise SchemaError(f"an element's attributes and text can be combined in over {MOST_WAYS} ways")
        return out

    @staticmethod
    def both(a: _Way, b: _Way) -> _Way:
        if a.model != EMPTY and b.model != EMPTY and "all" in (a.model.kind, b.model.kind):
            raise SchemaError("elements in any order are a whole content, not a part of one")
        model = a.model if b.model == EMPTY else b.model if a.model == EMPTY else seq(a.model, b.model)
        return _Way(model, (*a.attributes, *b.attributes), a.text if b.text is None else b.text, a.any_attribute or b.any_attribute)

    def interleaved(self, parts: list[ElementTree.Element], ns: str, refs: tuple[str, ...]) -> list[_Way]:
        """Elements in any order: each part a type, how often it may come."""
        counts, out = [], _Way()
        for p in parts:
            for w in (ways := self.ways(p, ns, refs)):
                if len(ways) > 1:
                    raise SchemaError("a choice of attributes or text within interleave isn't supported")
                m, low, high = w.model, 1, 1
                if m.kind == "rep":
                    m, low, high = m.parts[0], m.low, m.high
                while m.kind in ("or", "seq") and len(m.parts) == 1:
                    m = m.parts[0]
                if m.kind == "or" and len(m.parts) == 2 and EMPTY in m.parts:
                    m, low = next(x for x in m.parts if x != EMPTY), 0
                    while m.kind in ("or", "seq") and len(m.parts) == 1:
                        m = m.parts[0]
                if m.kind == "name":
                    counts.append((m.name, low, high))
                elif m != EMPTY:
                    raise SchemaError("only elements, each with a number of times, can stand within interleave")
                out = self.both(out, _Way(EMPTY, w.attributes, w.text, w.any_attribute))
        return [_Way(interleave(*counts) if counts else EMPTY, out.attributes, out.text, out.any_attribute)]

    def attribute(self, x: ElementTree.Element, inner: list[ElementTree.Element], ns: str) -> list[_Way]:
        name, namespace = x.get("name"), x.get("ns", "")
        if name is None:
            if _local(inner[0]) in ("anyName", "nsName"):
                return [_Way(any_attribute=True)]
            (name, *_), namespace = self.name_class(inner[0], "")
            inner = inner[1:]
        elif ":" in name:
            prefix, name = name.split(":")
            namespace = self.prefixes.get(prefix, "http://www.w3.org/XML/1998/namespace" if prefix == "xml" else "")
        test = self.value_of(inner)
        return [_Way(attributes=(Attribute(name, test, True, namespace),))]

    def value_of(self, inner: list[ElementTree.Element]) -> Test | None:
        """The test of an attribute's value; None for any."""
        if not inner or _local(inner[0]) == "text":
            return None
        kind, parts = _local(inner[0]), list(inner[0])
        if kind == "choice":
            return _any_of([t for p in parts if (t := self.value_of([p])) is not None])
        if kind == "ref":
            return self.value_of(list(self.definition(inner[0].get("name"))))
        if kind == "empty":
            return lambda v: v == ""
        return self.value_test(inner[0], parts)

    def value_test(self, x: ElementTree.Element, inner: list[ElementTree.Element]) -> Test:
        kind, name = _local(x), x.get("type", "token")
        if kind == "value":
            wanted = x.text or ""
            return (lambda v: v == wanted) if name == "string" else (lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")) == " ".join(wanted.split()))
        if kind == "list":
            return lambda v: F.lit(True)
        if name not in BUILTIN:
            raise SchemaError(f"no data type {name!r}")
        facets = {p.get("name"): (int(p.text) if "ength" in p.get("name") or "Digits" in p.get("name") else p.text) for p in inner if _local(p) == "param"}
        return _all_of([BUILTIN[name], lambda v: facets_ok(v, name, facets)])


def relax_ng(text: str, resources: dict[str, str] | None = None) -> Grammar:
    """The grammar of a RelaxNG schema in XML syntax.

    element, attribute, group, choice, optional, zeroOrMore, oneOrMore, mixed, text, empty,
    notAllowed, data with parameters, value, names by choice, definitions that combine, include
    with redefinitions, externalRef.  A choice among attributes or texts gives an element
    several types.  interleave takes elements, each with a number of times, as XML Schema's
    all does; list takes any items.  What isn't supported is a SchemaError.
    """
    x = _RelaxNg(resources or {})
    root = x.load(text)
    ways = x.ways(x.definition("#start") if _local(root) == "grammar" else root, root.get("ns", ""), ())
    start = [m.name for w in ways for m in _names(x.expanded(w.model))]
    for t in x.types.values():
        t.content = x.expanded(t.content)
    if not start:
        raise SchemaError("the schema has no root element")
    return Grammar(x.types, start)


def _names(m: Model) -> list[Model]:
    return [m] if m.kind == "name" else [n for p in m.parts for n in _names(p)]


# Schematron


@dataclass
class Schematron:
    """Patterns (id, lets, rules) in order, phases and prefixes; a rule is (context, lets, tests)."""

    patterns: list[tuple[str, dict[str, str], list[tuple]]] = field(default_factory=list)
    phases: dict[str, list[str]] = field(default_factory=dict)
    namespaces: dict[str, str] = field(default_factory=dict)
    lets: dict[str, str] = field(default_factory=dict)
    default_phase: str | None = None


def schematron(text: str) -> Schematron:
    """A Schematron schema's document: patterns, abstract rules and extends, let, phases, assert, report, value-of and name."""
    root, _ = _read(text)
    if root is None or _local(root) != "schema":
        raise SchemaError("no schema element of Schematron")
    own = lambda x, *kinds: [c for c in x if _local(c) in kinds]
    lets = lambda x: {c.get("name"): c.get("value") for c in own(x, "let")}
    out = Schematron(namespaces={c.get("prefix"): c.get("uri") for c in own(root, "ns")}, lets=lets(root), default_phase=root.get("defaultPhase"))
    abstract = {r.get("id"): r for p in own(root, "pattern") for r in own(p, "rule") if r.get("abstract") == "true"}

    def tests(rule, depth=0):
        if depth > 20:
            raise SchemaError("rules extend each other in a circle")
        found = []
        for c in own(rule, "assert", "report", "extends"):
            if _local(c) == "extends":
                if c.get("rule") not in abstract:
                    raise SchemaError(f"no abstract rule {c.get('rule')!r}")
                found += tests(abstract[c.get("rule")], depth + 1)
            else:
                found.append((_local(c), c.get("test"), _message(c)))
        return found

    for k, p in enumerate(own(root, "pattern")):
        rules = [(r.get("context"), lets(r), tests(r)) for r in own(p, "rule") if r.get("abstract") != "true"]
        out.patterns.append((p.get("id") or f"pattern-{k + 1}", lets(p), rules))
    for p in own(root, "phase"):
        out.phases[p.get("id")] = [c.get("pattern") for c in own(p, "active")]
    return out


def _message(x: ElementTree.Element) -> list[tuple[str, str]]:
    """Pieces of a message: ("text", s) or ("value", expression)."""
    parts = [("text", x.text or "")]
    for c in x:
        if _local(c) == "value-of":
            parts.append(("value", c.get("select")))
        elif _local(c) == "name":
            parts.append(("value", f"name({c.get('path') or ''})"))
        else:
            parts.append(("text", "".join(c.itertext())))
        parts.append(("text", c.tail or ""))
    return parts


def check_schematron(nodes: DataFrame, schema: Schematron | str, phase: str | None = None) -> DataFrame:
    """(doc_id, pre, rule, message, severity) of failed asserts (error) and of reports that hold (warning).

    Of a pattern's rules, the first whose context matches a node fires for it.  Contexts,
    tests, lets and the values in messages are expressions (``operators.expressions``): a let
    is put in where its name is used, so it is evaluated in that place's context; a context
    that isn't absolute matches at any depth.  The nodes of a context, all its tests and
    messages are one set of columns.
    """
    if isinstance(schema, str):
        schema = schematron(schema)
    phase = phase or schema.default_phase
    if phase not in (None, "#ALL", "#DEFAULT") and phase not in schema.phases:
        raise SchemaError(f"no such phase: {phase!r}")
    active = schema.phases.get(phase)
    out = []
    for name, of_pattern, rules in schema.patterns:
        if active is not None and name not in active:
            continue
        fired = None
        for k, (context, of_rule, tests) in enumerate(rules):
            c = _Lets(nodes, schema.lets | of_pattern | of_rule, schema.namespaces)
            parts = c.read(context)
            found = c.nodes(_anywhere(parts), Contexts(c.root(), True)).distinct()
            rows = found.rows
            if fired is not None:
                rows = rows.join(fired, ["doc_id", "pre", "idx"], "left_anti")
            here = rows.select("doc_id", "pre", "idx")
            fired = here if fired is None else fired.union(here)
            at = Contexts(type(found)(rows, False, found.attrs, found.trees), False)
            hits = []
            for n, (kind, test, message) in enumerate(tests):
                holds = c.value("boolean", c.read(test), at)
                text = [F.lit(v) if what == "text" else c.value("string", c.read(v), at) for what, v in message]
                said = F.trim(F.regexp_replace(F.concat(*text), r"\s+", " "))
                bad = ~holds if kind == "assert" else holds
                hits.append(F.when(bad, F.struct(F.lit(n).alias("n"), said.alias("message"), F.lit("error" if kind == "assert" else "warning").alias("severity"))))
            if hits:
                listed = at.rows.select("doc_id", "pre", F.explode(F.array_compact(F.array(*hits))).alias("h"))
                out.append(listed.select("doc_id", "pre", F.lit(f"{name}/{k}").alias("rule"), "h.message", "h.severity"))
    if not out:
        return nodes.limit(0).select("doc_id", "pre", F.lit("").alias("rule"), F.lit("").alias("message"), F.lit("").alias("severity"))
    every = out[0]
    for o in out[1:]:
        every = every.union(o)
    return every


def _anywhere(term: tuple) -> tuple:
    """A relative context as a path from anywhere."""
    if term[0] == "|":
        return "|", _anywhere(term[1]), _anywhere(term[2])
    if term[0] == "path" and term[1] == ".":
        first, rest = term[2][0], term[2][1:]
        if first[0] == "child":
            return "path", "/", [("descendant", *first[1:]), *rest] if not first[2] else [("descendant-or-self", (None, None, None, None), []), first, *rest]
        return "path", "/", [("descendant-or-self", (None, None, None, None), []), *term[2]]
    return term


class _Lets(Compiler):
    """A compiler to which $names are the expressions of lets."""

    def __init__(self, nodes: DataFrame, lets: dict[str, str], namespaces: dict[str, str]):
        super().__init__(nodes, {})
        self.lets, self.namespaces = lets, namespaces

    def read(self, text: str, above: tuple[str, ...] = ()) -> tuple:
        return self.filled(Reader(text, self.namespaces).whole(), above)

    def filled(self, term, above: tuple[str, ...]):
        if isinstance(term, tuple) and term and term[0] == "var":
            if term[1] not in self.lets:
                raise SchemaError(f"no such variable: ${term[1]}")
            if term[1] in above:
                raise SchemaError(f"${term[1]} names itself")
            return self.read(self.lets[term[1]], (*above, term[1]))
        if isinstance(term, tuple):
            return tuple(self.filled(t, above) for t in term)
        return [self.filled(t, above) for t in term] if isinstance(term, list) else term


