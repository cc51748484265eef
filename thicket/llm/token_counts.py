"""Token counts of a unigram segmentation, by dynamic programming on a trie of pre-tokens."""

from __future__ import annotations

import re
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from thicket.llm.common import without_results
from thicket.llm.text import utf8

#: What stands for the blank before a word (a fixed value of such vocabularies).
MARK = "▁"
#: How far an unknown character's score lies under the least piece's.
UNKNOWN = 10.0
#: Characters of a pre-token up to which it enters the trie; of a text that is taken at once.
LONGEST, LONG_TEXT = 256, 1 << 20
_BLANK, _WORD = re.compile("[ \n]"), re.compile(r"\S+")


def file_scores(path: str) -> dict[str, float]:
    """piece -> score, as the sentencepiece file at ``path`` has them; control, byte and unknown pieces have none."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}


class UnigramTrie:
    """Counts tokens of pre-tokens on a trie of those seen; a shared prefix is computed once.

    A node of depth d stands for d characters and holds the forward score of these, and its
    number of tokens: best[d] is the largest of best[c] + score(piece c..d); of equal scores,
    the fewer tokens.  A character that no piece ends at is unknown: it scores less than any
    piece and counts as many tokens as it has UTF-8 bytes (byte fallback).  ``ends`` keeps the
    count at each terminal.  The trie is dropped when it has ``most_nodes`` nodes, terminals
    when there are ``most_ends``; what is longer than LONGEST characters passes through a
    short window of states instead.
    """

    def __init__(self, scores: dict[str, float], most_nodes: int = 600_000, most_ends: int = 600_000):
        self.scores, self.most_nodes, self.most_ends = scores, most_nodes, most_ends
        self.longest = max(map(len, scores), default=0)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        lengths: dict[str, set[int]] = {}
        for p in scores:  # a piece's possible lengths by its last two characters
            lengths.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: sorted(v) for k, v in lengths.items()}
        self.ends: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node * 2**21 + character -> node
        self.best, self.count = array("d", [0.0]), array("q", [0])

    def _step(self, t: str, e: int, best, count, shift: int = 0) -> tuple[float, int]:
        """Score and number of tokens of the first e characters of t, from those of fewer (best[e - 1 - shift] and so on)."""
        scores, c = self.scores, t[e - 1]
        one = scores.get(c)
        b, k = (best[e - 1 - shift] + self.unknown, count[e - 1 - shift] + len(c.encode())) if one is None else (best[e - 1 - shift] + one, count[e - 1 - shift] + 1)
        if e > 1:
            for m in self.lengths.get(t[e - 2 : e], ()):
                if m > e:
                    break
                if m > 1:
                    s = scores.get(t[e - m : e])
                    if s is not None:
                        s += best[e - m - shift]
                        if s > b or (s == b and count[e - m - shift] + 1 < k):
                            b, k = s, count[e - m - shift] + 1
        return b, k

    def insert(self, t: str) -> int:
        """The number of tokens of a pre-token; its nodes are those of its longest known prefix, and new ones."""
        if len(t) > LONGEST:
            return self._long(t)
        child, node = self.child, 0
        path_best, path_count = [0.0], [0]
        for e, c in enumerate(t, 1):
            key = node << 21 | ord(c)
            node = child.get(key, -1)
            if node < 0:
                b, k = self._step(t, e, path_best, path_count)
                node = child[key] = len(self.best)
                self.best.append(b)
                self.count.append(k)
            path_best.append(self.best[node])
            path_count.append(self.count[node])
        self.ends[t] = path_count[-1]
        return path_count[-1]

    def _long(self, t: str) -> int:
        best, count, shift = [0.0], [0], 0
        for e in range(1, len(t) + 1):
            b, k = self._step(t, e, best, count, shift)
            best.append(b)
            count.append(k)
            if len(best) > 4096 + self.longest:
                shift += 4096
                del best[:4096], count[:4096]
        return count[-1]

    def counts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """The numbers of pre-tokens and of tokens of each text."""
        words, tokens, ends = [], [], self.ends
        for text in texts:
            n = k = 0
            for part in _parts(text):
                for w in part.split() if len(part) <= 2 * LONG_TEXT else (m[0] for m in _WORD.finditer(part)):
                    t = MARK + w
                    n += 1
                    found = ends.get(t)
                    k += self.insert(t) if found is None else found
                if len(self.best) > self.most_nodes:
                    self.clear()
                if len(ends) > self.most_ends:
                    ends.clear()
            words.append(n)
            tokens.append(k)
        return words, tokens


def _parts(text: str) -> list[str]:
    """A text, cut at blanks if it is a long one."""
    out, pos = [], 0
    while len(text) - pos > LONG_TEXT:
        m = _BLANK.search(text, pos + LONG_TEXT)
        if not m:
            break
        out.append(text[pos : m.start()])
        pos = m.start()
    return [*out, text[pos:] if pos else text]


_made: dict[str, UnigramTrie] = {}


def _counted(batches, path: str, at: int):
    if path not in _made:
        _made[path] = UnigramTrie(file_scores(path))
    trie = _made[path]
    for b in batches:
        texts = b.column(at)
        run = np.cumsum(np.diff(utf8(texts)[1])) >> 22
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
        words, n = [], []
        for x, y in zip(cuts, cuts[1:], strict=False):
            for total, some in zip((words, n), trie.counts([t or "" for t in texts[x:y].to_pylist()]), strict=True):
                total += some
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words, pa.int64()), pa.array(n, pa.int64())], names=[*b.schema.names, "n_pretokens", "n_tokens"])


def token_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs' columns, then n_pretokens and n_tokens of the whole text.

    Pre-tokens are the text's runs without white space, each after the mark of a word's
    begin; n_tokens sums the tokens of their best segmentation into the pieces of the
    sentencepiece file at ``path`` under the scores of that file (``file_scores``); the
    file's normaliser leaves letters as they are.  A null text counts as empty: no
    tokens.  Rows stand for themselves, so repeated rows and null ids make no difference; an
    empty table gives an empty result; columns of docs that bear a result's name, in any
    case, are replaced.  A narrow transformation: nothing is shuffled, and what a worker
    remembers is bounded, however long a text is and with or without blanks.
    """
    docs = without_results(docs, ("n_pretokens", "n_tokens"), text_col)
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    schema = StructType([*docs.schema.fields]).add("n_pretokens", LongType()).add("n_tokens", LongType())
    return docs.mapInArrow(partial(_counted, path=path, at=at), schema).select(*[F.col(f"`{c}`") for c in schema.names])
