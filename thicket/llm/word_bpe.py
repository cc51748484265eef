"""BPE encoding and decoding with a pair occurrence index.

A batch's distinct words stand one behind another in one symbol array.  Each adjacent pair
that the vocabulary merges is indexed with all its positions; active ranks are applied in
ascending order, each to all its positions at once, and the lists of the neighbouring pairs
that come into being are updated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import without_results

#: The split of words that the word-level vocabulary uses (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Blanks of which str.split() and Unicode's White_Space differ.
_ODD_BLANK = re.compile("[\x1c-\x1f]")
_BLANK = re.compile("[ \n]")
#: Places where one word ends and another begins, whatever stands around: before a digit, after a letter and before a mark.
_BETWEEN_WORDS = re.compile(r"(?=[0-9])|(?<=[A-Za-z])(?=[!-/:-@\[-`{-~])")
#: Letters of what is remembered at most; of a chunk that is taken in parts; of a text that is cut at blanks.
SHORT, LONG_CHUNK, LONG_TEXT = 64, 1 << 16, 1 << 20
#: Bytes of words that are merged at once; a longer word is cut where nothing merges.
LONG_WORD = 1 << 19


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in own else chr(256 + b - sum(x < b for x in own)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a BPE file with word ends (``</w>``), lower-casing and NFC."""

    def __init__(self, path: str, most: int = 256 << 20):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.rank: list[dict[int, int]] = [{} for _ in self.token]  # left symbol -> right symbol -> rank
        self.made: list[int] = []  # rank -> new symbol
        self.pair: list[tuple[int, int]] = []  # rank -> pair
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right = self.vocab[a], self.vocab[b]
            self.rank[left].setdefault(right, len(self.made))
            self.pair.append((left, right))
            self.made.append(self.vocab[a + b])
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.final = [self.vocab[x + self.end] for x in letters]
        pattern = regex.compile(PATTERN)
        self.split, self.matches = pattern.findall, pattern.finditer
        self._take_rare(path, regex)
        #: Bytes that stand side by side within some token; between all others nothing ever merges.
        self.joint = np.zeros((256, 256), bool)
        byte = {c: b for b, c in enumerate(letters)}
        for t in self.vocab:
            raw = [byte[c] for c in t.removesuffix(self.end) if c in byte]
            self.joint[raw[:-1], raw[1:]] = True
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Ids of chunks of text and of words of up to SHORT letters, which take about ``most`` bytes at most.
        self.seen: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most, self.held = most, 0

    def merge(self, words: list[bytes], closed: list[bool] | None = None) -> list[bytes]:
        """Ids (little-endian 32-bit) of each of the distinct, non-empty words; those that aren't closed have no word end."""
        sym: list[int] | array = [] if sum(map(len, words)) < LONG_WORD else array("i")
        starts = []
        for w, ends in zip(words, closed or repeat(True), strict=False):
            starts.append(len(sym))
            sym.extend(map(self.inner.__getitem__, w[:-1]))
            sym.append((self.final if ends else self.inner)[w[-1]])
        n, rank, made, pair = len(sym), self.rank, self.made, self.pair
        # Words end at -1 in both directions, so no pair reaches from one word into the next.
        row = list if isinstance(sym, list) else partial(array, "i")
        after, before = row(range(1, n + 1)), row(range(-1, n - 1))
        for s in starts:
            before[s] = -1
            if s:
                after[s - 1] = -1
        if n:
            after[n - 1] = -1
        places: dict[int, list[int]] = {}
        for i in range(n):
            j = after[i]
            if j >= 0:
                r = rank[sym[i]].get(sym[j])
                if r is not None:
                    if r in places:
                        places[r].append(i)
                    else:
                        places[r] = row([i])
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            here = places.pop(r)
            (a, b), new = pair[r], made[r]
            if a == b:
                here = sorted(here) if isinstance(here, list) else np.sort(np.frombuffer(here, np.int32)).tolist()
            for i in here:
                j = after[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue  # another merge has taken one of the two since
                sym[i], sym[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    q = rank[new].get(sym[k])
                    if q is not None:
                        if q in places:
                            places[q].append(i)
                        else:
                            places[q] = [i]
                            heapq.heappush(active, q)
                h = before[i]
                if h >= 0:
                    q = rank[sym[h]].get(new)
                    if q is not None:
                        if q in places:
                            places[q].append(h)
                        else:
                            places[q] = [h]
                            heapq.heappush(active, q)
        flat = np.array(sym, np.int64)
        alive = flat >= 0
        cuts = np.concatenate([[0], np.cumsum(alive)])
        raw = flat[alive].astype("<u4").tobytes()
        bounds = (4 * cuts[[*starts, n]]).tolist()
        return [raw[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]

    def _normal(self, text: str) -> str:
        if not text.isascii():
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # a final sigma is no other letter here
        return text.lower()

    def _take_rare(self, path: str, regex) -> None:
        """Characters for which the tokenizers library's Unicode tables may be others than Python's.

        Those are all beyond the first plane, and those of it that no table, or not every
        table, assigns, puts into the same class, lower-cases or orders alike.  Chunks that
        hold one are normalised and split by the file's own normaliser and splitter.
        """
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.normaliser = Tokenizer.from_file(path).normalizer
        self.splitter = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)
        plane = [chr(i) for i in range(128, 0x10000) if not 0xD800 <= i < 0xE000]
        rare = {c for c in plane if unicodedata.category(c) == "Cn"}
        text = "".join(plane)
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            spans = pre_tokenizers.Split(Regex(f"{kind}+"), "removed", invert=True).pre_tokenize_str(text)
            rare |= set("".join(x for x, _ in spans)) ^ set(regex.findall(kind, text))
        letters = [c for c in plane if not c.isspace() and c not in rare]
        marks = [c for c in letters if unicodedata.combining(c)]
        probes = {unicodedata.combining(c): c for c in marks}.values()  # one mark of each combining class
        samples = [(c, c) for c in letters] + [(c, f"a{x}") for c in marks for p in probes for x in (c + p, p + c)]
        theirs = self.normaliser.normalize_str(" ".join(x for _, x in samples)).split(" ")
        rare |= {c for (c, x), y in zip(samples, theirs, strict=True) if self._normal(x) != y}
        self.rare = re.compile(f"[{''.join(map(re.escape, sorted(rare)))}\U00010000-\U0010ffff]").search

    def _split(self, chunk: str) -> list[str]:
        if chunk.isascii() or not self.rare(chunk):
            return self.split(self._normal(chunk))
        return [x for x, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(chunk))]

    def _words_of(self, chunk: str):
        """The words of a long chunk, one by one; rare characters are taken in parts that end between words."""
        if chunk.isascii() or not self.rare(chunk):
            yield from (m[0] for m in self.matches(self._normal(chunk)))
            return
        pos = 0
        while pos < len(chunk):
            cut = _BETWEEN_WORDS.search(chunk, pos + LONG_CHUNK) if len(chunk) - pos > LONG_CHUNK else None
            end = cut.start() if cut else len(chunk)
            yield from self._split(chunk[pos:end])
            pos = end

    def _merged(self, words: list[str]) -> None:
        """Puts distinct new words into ``words``, about LONG_WORD bytes at a time."""
        raw = [w.encode() for w in words]
        for a, b in _runs(np.array([len(x) for x in raw], np.int64), LONG_WORD):
            ids = self.merge(raw[a:b]) if len(raw[a]) < LONG_WORD else [*map(self._long_word, raw[a:b])]
            self.words.update(zip(words[a:b], ids, strict=True))

    def _long_word(self, word: bytes) -> bytes:
        """The ids of one word, cut where its bytes can't merge, so that only a part is held at once."""
        x, out, pos = np.frombuffer(word, np.uint8), [], 0
        while pos < len(x):
            end = min(pos + LONG_WORD, len(x))
            while end < len(x):
                left = x[end - 1 : end - 1 + min(LONG_WORD, len(x) - end)]
                cuts = np.flatnonzero(~self.joint[left, x[end : end + len(left)]])
                if len(cuts):
                    end += int(cuts[0])
                    break
                end += len(left)
            out += self.merge([word[pos:end]], [end == len(x)])
            pos = end
        return b"".join(out)

    def learn(self, chunks) -> list[tuple[dict, str]]:
        """Puts distinct new chunks of text without blanks into ``seen``; says what isn't to be kept."""
        words, seen = self.words, self.seen
        new = list(chunks)
        parts = [*map(self._split, new)]
        fresh = list({p for ps in parts for p in ps if p not in words})
        self._merged(fresh)
        for x, ps in zip(new, parts, strict=True):
            seen[x] = words[ps[0]] if len(ps) == 1 else b"".join([words[p] for p in ps])
        self.held += sum(150 + 5 * len(x) for x in new) + sum(150 + 5 * len(x) for x in fresh)
        return [(seen, x) for x in new if len(x) > SHORT] + [(words, x) for x in fresh if len(x) > SHORT]

    def _long_chunk(self, chunk: str) -> bytes:
        """The ids of a long text without blanks, some of its words at a time."""
        out, ps, size = [], [], 0

        def flush():
            nonlocal ps, size
            missing = {p for p in ps if p not in self.words}
            self._merged(list(missing))
            out.append(b"".join([self.words[p] for p in ps]))
            for p in missing:
                del self.words[p]
            ps, size = [], 0

        for word in self._words_of(chunk):
            ps.append(word)
            size += len(word)
            if size >= LONG_TEXT // 8:
                flush()
        flush()
        return b"".join(out)

    def _parts(self, text: str) -> list[str]:
        """A text, cut at blanks if it is a long one."""
        out, pos = [], 0
        while len(text) - pos > LONG_TEXT:
            m = _BLANK.search(text, pos + LONG_TEXT)
            if not m:
                break
            out.append(text[pos : m.start()])
            pos = m.start()
        return [*out, text[pos:] if pos else text]

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that are encoded each for itself: nothing merges across blanks."""
        if _ODD_BLANK.search(text):
            import regex

            return [x for x in regex.split(r"\s+", text) if x]
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        if any(len(x) > LONG_TEXT for x in texts):
            return [b"".join([self._encode([p])[0] for p in self._parts(x)]) if len(x) > LONG_TEXT else self._encode([x])[0] for x in texts]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        pieces = [[text] if not any(x in text for x in self.special) else self.split_special.split(text) for text in texts]
        split = [[(x, None) if x in self.special else (x, self.chunks(x)) for x in ps] for ps in pieces]
        if self.held > self.most:
            self.seen.clear()
            self.words.clear()
            self.held = 0
        seen = self.seen
        missing = {c for ps in split for _, cs in ps if cs for c in cs if c not in seen}
        long = {c for c in missing if len(c) > LONG_CHUNK}
        passing = self.learn(missing - long) if missing else []
        get = seen.__getitem__ if not long else lambda c: self._long_chunk(c) if c in long else seen[c]
        out = [b"".join([np.array([self.special[x]], "<u4").tobytes() if cs is None else b"".join(map(get, cs)) for x, cs in ps]) for ps in split]
        for table, x in passing:
            table.pop(x, None)
        return out

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One per worker and file, so that what it has seen serves later tasks."""
    if path not in _made:
        _made[path] = WordBpe(path)
    return _made[path]


def _runs(sizes: np.ndarray, limit: int):
    run = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _coded(batches, path: str, full: bool):
    from thicket.llm.text import utf8

    bpe = word_bpe(path)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for a, b in _runs(np.diff(utf8(texts)[1]), 4 << 20):
            ids = bpe.encode([x or "" for x in texts[a:b].to_pylist()])
            decoded = [bpe.decode(x) for x in ids]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            columns = [batch.column(k)[a:b] for k in range(batch.num_columns - 1)]
            if full:
                out = [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
            else:
                out = [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            yield pa.RecordBatch.from_arrays([*columns, n, *out], names=[str(k) for k in range(len(columns) + 3)])


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """docs' columns but the text, then n_tokens and the ids and decoded text (or, with digests, the SHA-256 of both).

    Ids are those of the vocabulary file without added special tokens; special tokens'
    strings within a text get their ids.  ``ids`` are little-endian unsigned 32-bit
    integers; ``decoded`` is decoded from them.  A null text counts as empty: no ids, an
    empty decoded text.  Each row stands for itself, so repeated rows and null ids give
    rows alike; an empty table gives an empty result; columns of docs that bear a result's
    name, in any case, are replaced.  A narrow transformation: nothing is shuffled.
    """
    result = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    others = [c for c in without_results(docs, tuple(result), text_col).columns if c.lower() != text_col.lower()]
    plain = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").cast("string"))
    kinds = [f.dataType for f in plain.schema.fields[:-1]]
    from pyspark.sql.types import BinaryType, LongType, StringType, StructType

    schema = StructType()
    for k, kind in enumerate([*kinds, LongType(), StringType() if digests else BinaryType(), StringType()]):
        schema.add(str(k), kind)
    return plain.mapInArrow(partial(_coded, path=path, full=not digests), schema).toDF(*others, *result)
