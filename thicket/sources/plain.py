"""Plain XML documents to nodes, a batch at a time: tags, attributes and texts are found in the bytes by numpy.

Plain is what tables write: elements, attributes in double quotes after one blank, and texts,
names of ASCII without prefixes; no references, declarations, comments, sections or
instructions.  A doctype may stand in front, one for all of a batch, whose subset declares
attributes without defaults and nothing else.  Whatever is not certainly plain and well-formed, within all limits, is left to
expat, so a document has the same nodes either way.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from thicket.sources.tree import DOCTYPE, ELEMENT, TEXT, Nodes

#: Bytes of documents that are read at once; longer documents are expat's.
MOST = 1 << 19
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*")
_DECLARED = r"[A-Za-z_][A-Za-z0-9_.-]* (?:CDATA|ID|IDREF|IDREFS|ENTITY|ENTITIES|NMTOKEN|NMTOKENS) #(?:REQUIRED|IMPLIED)"
_SUBSET = re.compile(rf"<!DOCTYPE ([A-Za-z_][A-Za-z0-9_.-]*) (\[(?:<!ATTLIST [A-Za-z_][A-Za-z0-9_.-]*(?: {_DECLARED})+>)+\])>")
_LT, _GT, _QUOTE, _BLANK, _SOFT, _OTHER = range(1, 7)
#: What a byte means here; 0xEF begins the characters that XML forbids and the byte order mark.
_CLASS = np.zeros(256, np.uint8)
_CLASS[:32] = _OTHER
_CLASS[[ord("&"), 0xEF]] = _OTHER
_CLASS[[ord("\n"), ord("\t")]] = _SOFT
for _c, _k in (("<", _LT), (">", _GT), ('"', _QUOTE), (" ", _BLANK)):
    _CLASS[ord(_c)] = _k


def slices(texts: pa.Array):
    """(begin, end) of stretches of documents of at most MOST bytes together, one document at least."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + MOST, "right")) - 1)
        yield begin, end
        begin = end


def _strings(data: pa.Buffer, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Stretches of bytes, in ascending order, as strings: every second one of those that the borders make."""
    if not len(begin):
        return pa.array([], pa.string())
    borders = np.column_stack([begin, end]).ravel().astype(np.int32)
    return pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), data).take(pa.array(np.arange(0, len(borders) - 1, 2)))


def _named(found: pa.Array, most: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Numbers of names, the names, and where a name isn't plain."""
    coded = found.dictionary_encode()
    names, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    wrong = np.array([not _NAME.fullmatch(x) or x == "xmlns" or len(x) > most for x in names], bool)
    return numbers, names, wrong[numbers] if len(names) else np.zeros(0, bool)


def _read(ids: list, texts: pa.Array, o, doctype: tuple[str, str] | None = None) -> Nodes | np.ndarray:
    """The nodes of documents, or which of them are not plain, as far as one look tells.

    ``doctype`` is the name and the subset of one that stands before each of them, and isn't in the texts.
    """
    n_docs = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n_docs + 1].astype(np.int64)
    data = texts.buffers()[2].slice(int(at[0]), int(at[-1] - at[0]))
    at -= at[0]
    b = np.frombuffer(data, np.uint8)
    bad = np.zeros(n_docs, bool)

    # Brackets by turns, from the first byte to the last.
    what = _CLASS[b]
    place = np.flatnonzero(what)
    what = what[place]
    bad[np.searchsorted(at, place[what == _OTHER], "right") - 1] = True
    bracket = place[what <= _GT]
    first = np.searchsorted(bracket, at)
    count = np.diff(first)
    doc = np.repeat(np.arange(n_docs), count)
    bad[doc[what[what <= _GT] != 1 + (np.arange(len(bracket)) - first[doc]) % 2]] = True
    bad |= (count == 0) | (count % 2 == 1)
    full = np.flatnonzero(~bad)
    bad[full[(bracket[first[full]] != at[full]) | (bracket[first[full + 1] - 1] != at[full + 1] - 1)]] = True
    if bad.any():
        return bad

    # Names, and attributes between pairs of quotes.
    lt, gt, doc, first = bracket[0::2], bracket[1::2], doc[0::2], first // 2
    n_tags = len(lt)

    def within(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those within tags, and the tags."""
        tag = np.searchsorted(lt, places) - 1
        inside = places < gt[tag]
        return places[inside], tag[inside]

    closing = b[lt + 1] == ord("/")
    bad[doc[within(place[what == _SOFT])[1]]] = True
    blank = np.append(within(place[what == _BLANK])[0], len(b))
    name_end = np.minimum(blank[np.searchsorted(blank, lt)], gt)
    quote, tag = within(place[what == _QUOTE])
    quotes = np.bincount(tag, minlength=n_tags)
    bad[doc[(quotes % 2 == 1) | (closing & (quotes > 0)) | ((quotes == 0) & (name_end != gt))]] = True
    if bad.any():
        return bad
    opens, closes, owner = quote[0::2], quote[1::2], tag[0::2]
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    before = np.where(new, name_end[owner], np.append(0, closes[:-1]) + 1)
    ends = np.append(new[1:], True)[: len(owner)]
    wrong = (b[before] != ord(" ")) | (b[opens - 1] != ord("=")) | (opens - 1 <= before + 1) | (ends & (closes + 1 != gt[owner])) | (closes - opens > o.max_attribute_length)
    bad[doc[owner[wrong]]] = True
    begins = lt + 1 + closing
    bad[doc[name_end <= begins]] = True
    bad[doc[quotes > 2 * o.max_attributes]] = True
    if bad.any():
        return bad
    name, names, wrong = _named(_strings(data, begins, name_end), o.max_name_length)
    bad[doc[wrong]] = True
    key, keys, wrong = _named(_strings(data, before + 1, opens - 1), o.max_name_length)
    bad[doc[owner[wrong]]] = True
    if doctype:  # values of declared types are trimmed, which is expat's work
        typed = np.array([bool(re.search(rf"[ ]{re.escape(x)} (?!CDATA)", doctype[1])) for x in keys], bool)
        bad[doc[owner[typed[key] & (np.searchsorted(blank, closes) > np.searchsorted(blank, opens))]]] = True
    pair = np.sort(owner * max(1, len(keys)) + key)
    bad[doc[pair[1:][pair[1:] == pair[:-1]] // max(1, len(keys))]] = True

    # Levels; of each level, tags open and close by turns.
    level = np.cumsum(1 - 2 * closing.astype(np.int64))
    level -= np.append(0, level)[first[:-1]][doc]
    last = np.zeros(n_tags, bool)
    last[first[1:] - 1] = True
    bad[doc[(level == 0) != last]] = True
    bad[doc[level < 0]] = True
    bad[doc[level > min(o.max_depth, 1 << 15)]] = True
    text_begin, text_end = gt + 1, np.append(lt[1:], len(b))
    bad[doc[text_end - text_begin > o.max_text_length]] = True
    if bad.any():
        return bad
    turns = np.argsort((level + closing).astype(np.uint16), kind="stable")
    bad[doc[turns[0::2][name[turns[0::2]] != name[turns[1::2]]]]] = True
    if bad.any():
        return bad

    # A document's node before its first tag, an element for a tag that opens, a text after a tag.
    begin = np.zeros(n_tags, np.int64)
    begin[first[:-1]] = 1 if doctype is None else 2
    some = text_end > text_begin
    size = begin + ~closing + some
    row = np.cumsum(size) - size
    nodes = Nodes()
    code, spot = np.zeros(int(size.sum()), np.int64), np.ones(int(size.sum()), np.int64)
    starts, opening, texty = row[first[:-1]], np.flatnonzero(~closing), np.flatnonzero(some)
    element = row + begin
    spot[starts] = 0
    code[element[opening]] = 8 * level[opening] + ELEMENT
    text = (element + ~closing)[texty]
    code[text] = 8 * (level[texty] + 1) + TEXT
    number = np.array([nodes.name_of(x) for x in names], np.int64)[name[opening]]
    depth, of, above = level[opening], np.zeros(len(opening), np.int64), np.zeros(0, np.int64)
    for d in range(1, int(depth.max()) + 1):
        here = np.flatnonzero(depth == d)
        parent = of[above[np.searchsorted(above, here) - 1]] if d > 1 else np.zeros(len(here), np.int64)
        kinds, which = np.unique(parent * len(nodes.names) + number[here], return_inverse=True)
        of[here] = np.array([nodes.spot_below(*divmod(int(x), len(nodes.names))) for x in kinds], np.int64)[which]
        above = here
    spot[element[opening]] = of
    taken = np.full(len(code), -1, np.int64)
    taken[text] = np.arange(len(text))
    nodes.code, nodes.spot, nodes.owner = code, spot, element[owner]
    pieces = _strings(data, text_begin[texty], text_end[texty])
    if doctype:
        code[starts + 1], spot[starts + 1], taken[starts + 1] = 8 + DOCTYPE, nodes.spot_of(nodes.name_of(doctype[0])), len(pieces)
        pieces = pa.concat_arrays([pieces, pa.array([doctype[1]], pa.string())])
    nodes.content = pieces.take(pa.array(taken, mask=taken < 0))
    none = pa.nulls(len(owner), pa.string())
    nodes.attributes = (pa.array(keys, pa.string()).take(pa.array(key)), _strings(data, opens + 1, closes), none, none)
    nodes.documents = [(s, i, None) for s, i in zip(starts.tolist(), ids, strict=True)]
    return nodes


def plain_nodes(ids: list, texts: pa.Array, o) -> tuple[Nodes | None, np.ndarray]:
    """The nodes of the plain ones of these documents, if any, and the places of the others."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    left, doctype = np.flatnonzero((size > 0) & (size <= MOST)), None
    if len(left) and (m := _SUBSET.match(texts[int(left[0])].as_py())):
        doctype = m.groups()
        left = left[pc.starts_with(texts.take(pa.array(left)), m[0]).to_numpy(zero_copy_only=False)]
        texts = pc.utf8_slice_codeunits(texts, len(m[0]))
    while len(left):
        found = _read([ids[i] for i in left], texts.take(pa.array(left)) if len(left) < len(texts) else texts, o, doctype)
        if isinstance(found, Nodes):
            return found, np.setdiff1d(np.arange(len(texts)), left, assume_unique=True)
        left = left[~found]
    return None, np.arange(len(texts))
