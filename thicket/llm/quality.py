"""A byte-level convolutional quality classifier in numpy.

Learned filters of 8 bytes move over the text's bytes in steps of 4; their largest responses
in overlapping chunks of 256 bytes (64 shared with the next) cover the whole document, and
the chunks' mean and maximum are combined into one probability.  A long text passes in
slices that end at chunk borders, with a running sum and maximum, so that what is held
doesn't depend on its length.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from thicket.llm.common import without_results
from thicket.llm.text import utf8

STEP, WIDTH, BLOCK, CHUNK, HOP = 4, 8, 16, 4, 3  # bytes, bytes, steps in a block, blocks in a chunk, blocks between chunks


#: Bytes of texts that are scored together; a longer text passes in slices of SLICE_CHUNKS chunks.
SLICE, SLICE_CHUNKS = 1 << 20, 5000


def symbols(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each text padded with zeros to whole blocks, and its first block (n + 1 offsets)."""
    unit = STEP * BLOCK
    start = np.concatenate([[0], np.cumsum(-(-(np.diff(at) + STEP) // unit))])
    out = np.zeros(int(start[-1]) * unit, np.uint8)
    if len(raw):
        out[np.arange(len(raw)) + np.repeat(start[:-1] * unit - at[:-1], np.diff(at))] = raw
    return out, start


def _chunks(start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block of every chunk, and each text's first chunk (n + 1 offsets)."""
    n = np.diff(start)
    many = np.maximum(1, -(-(n - CHUNK) // HOP) + 1)
    first = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(len(n)), many)
    a = start[:-1][owner] + HOP * (np.arange(first[-1]) - first[:-1][owner])
    return a, np.minimum(a + CHUNK, start[1:][owner]) - 1, first


class Network:
    """embedding (256, e), filters (8 * e, f) with bias, and the weights of mean and maximum."""

    def __init__(self, e: int = 8, f: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "emb": rng.normal(0, 0.5, (256, e)).astype(np.float32),
            "w": rng.normal(0, 1 / np.sqrt(WIDTH * e), (WIDTH * e, f)).astype(np.float32),
            "b": np.zeros(f, np.float32),
            "v": rng.normal(0, 0.2, 2 * f).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.shift = 0.0
        self.prior: float | None = None  # what every text scores where nothing could be learned

    def responses(self, sym: np.ndarray, start: np.ndarray, ahead: np.ndarray | None = None) -> np.ndarray:
        """(steps, f) filter responses; the last step of a text sees ``ahead``, by default zeros."""
        e, f = self.p["emb"].shape[1], self.p["w"].shape[1]
        half = STEP * e
        both = np.concatenate([self.p["w"][:half], self.p["w"][half:]], axis=1)
        x = self.p["emb"][sym].reshape(-1, half) @ both
        after = np.empty((len(x), f), np.float32)
        after[:-1] = x[1:, f:]
        after[start[1:] * BLOCK - 1] = self.p["emb"][np.zeros(STEP, np.uint8) if ahead is None else ahead].reshape(-1) @ self.p["w"][half:]
        after += x[:, :f]
        return after

    def _chunk_values(self, sym, start, ahead=None):
        """(chunks, f) values, and what the gradient needs of their making."""
        r = self.responses(sym, start, ahead).reshape(-1, BLOCK, self.p["w"].shape[1])
        top = r.max(axis=1)
        a, z, first = _chunks(start)
        m = top[a]
        for k in range(1, CHUNK):
            np.maximum(m, top[np.minimum(a + k, z)], out=m)
        return np.tanh(np.maximum(m + self.p["b"], 0) / 4), (r, top, a, z, first)

    def _pooled(self, sym, start):
        m, (r, top, a, z, first) = self._chunk_values(sym, start)
        mean = np.add.reduceat(m, first[:-1], axis=0) / np.diff(first)[:, None]
        high = np.maximum.reduceat(m, first[:-1], axis=0)
        return np.concatenate([mean, high], axis=1), (r, top, a, z, first, m)

    def _long(self, raw: np.ndarray) -> float:
        """The logit of one text, slice by slice."""
        unit, f = STEP * BLOCK, self.p["w"].shape[1]
        blocks = -(-(len(raw) + STEP) // unit)
        many = max(1, -(-(blocks - CHUNK) // HOP) + 1)
        total, high = np.zeros(f), np.zeros(f, np.float32)
        for c in range(0, many, SLICE_CHUNKS):
            a, z = HOP * c, min(HOP * (min(c + SLICE_CHUNKS, many) - 1) + CHUNK, blocks)
            sym, ahead = np.zeros((z - a) * unit, np.uint8), np.zeros(STEP, np.uint8)
            for out, piece in ((sym, raw[a * unit : z * unit]), (ahead, raw[z * unit : z * unit + STEP])):
                out[: len(piece)] = piece
            m, _ = self._chunk_values(sym, np.array([0, z - a]), ahead)
            total += m.sum(axis=0, dtype=np.float64)
            np.maximum(high, m.max(axis=0), out=high)
        return float(np.concatenate([total / many, high]) @ self.p["v"] + self.p["c"][0])

    def logits(self, sym, start) -> np.ndarray:
        return self._pooled(sym, start)[0] @ self.p["v"] + self.p["c"][0]

    def score(self, text) -> np.ndarray:
        """A probability for each text of an Arrow column, about SLICE bytes of text at a time."""
        if self.prior is not None:
            return np.full(len(text), self.prior)
        raw, at = utf8(text)
        out, i, n = [], 0, len(at) - 1
        while i < n:
            if at[i + 1] - at[i] > SLICE:
                out.append(np.array([self._long(raw[at[i] : at[i + 1]])]))
                i += 1
                continue
            j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1))
            out.append(self.logits(*symbols(raw[at[i] : at[j]], at[i : j + 1] - at[i])))
            i = j
        z = np.concatenate(out).astype(np.float64) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z + self.shift, -60, 60)))

    def gradients(self, sym, start, y, weight) -> dict[str, np.ndarray]:
        p = self.p
        e, f = p["emb"].shape[1], p["w"].shape[1]
        x, (r, top, a, z, first, m) = self._pooled(sym, start)
        d = (1 / (1 + np.exp(-(x @ p["v"] + p["c"][0]))) - y) * weight
        g = {"v": x.T @ d + 1e-4 * p["v"], "c": np.array([d.sum()], np.float32)}
        n, owner = np.diff(first), np.repeat(np.arange(len(y)), np.diff(first))
        dm = (d / n)[owner, None] * p["v"][:f]
        dm = dm + (m == x[owner, f:]) * d[owner, None] * p["v"][f:]
        dm *= (m > 0) * (1 - m * m) / 4
        g["b"] = dm.sum(axis=0)
        # The step that gave the maximum: its block of the chunk, then its step of the block.
        best = np.stack([top[np.minimum(a + k, z)] for k in range(CHUNK)]).argmax(axis=0)
        block = np.minimum(a[:, None] + best, z[:, None])
        step = block * BLOCK + r.argmax(axis=1)[block, np.arange(f)]
        padded = np.concatenate([sym, np.zeros(WIDTH, np.uint8)])
        seen = padded[step[..., None] * STEP + np.arange(WIDTH)]  # (chunks, f, 8)
        seen[..., STEP:][np.isin(step, start[1:] * BLOCK - 1)] = 0
        inputs = p["emb"][seen].reshape(*step.shape, WIDTH * e)
        g["w"] = np.einsum("cfi,cf->if", inputs, dm, optimize=True)
        back = (dm[..., None] * p["w"].T[None]).reshape(-1, e)
        g["emb"] = np.stack([np.bincount(seen.reshape(-1), back[:, k], 256) for k in range(e)], axis=1)
        return g

    def fit(self, text, y: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
        """Adam on the class-balanced logistic loss, then a shift that puts 0.7 at the classes' best border."""
        raw, at = utf8(text)
        parts = [symbols(raw[a:b], np.array([0, b - a])) for a, b in zip(at[:-1], at[1:], strict=True)]
        share = np.where(y == 1, y.mean(), 1 - y.mean())
        weight = (0.5 / np.maximum(share, 1e-9)).astype(np.float32)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        rng, t = np.random.default_rng(seed), 0
        epochs = max(epochs, -(-700 * batch // len(y)))  # small samples are seen more often
        total = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                sym = np.concatenate([parts[i][0] for i in rows])
                start = np.concatenate([[0], np.cumsum([parts[i][1][-1] for i in rows])])
                g = self.gradients(sym, start, y[rows], weight[rows] / len(rows))
                t += 1
                lr = rate * (1 - 0.9 * t / total)
                for name, x in self.p.items():
                    u, s = moment[name]
                    u += 0.1 * (g[name] - u)
                    s += 0.01 * (g[name] ** 2 - s)
                    x -= (lr * (u / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        z = np.concatenate([self.logits(*p) for p in parts])
        good, bad = np.sort(z[y == 1]), np.sort(z[y == 0])
        if len(good) and len(bad):
            # 0.7 goes where the fewest of either class, by share, lie on the wrong side; of such places, the middle.
            places = np.sort(z)
            wrong = np.searchsorted(good, places, "left") / len(good) + 0.5 * (1 - np.searchsorted(bad, places, "left") / len(bad))
            best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
            below = places[best[0] - 1] if best[0] else places[0] - 1
            self.shift = float(np.log(0.7 / 0.3) - (0.5 * places[best[0]] + 0.5 * below))
        return self


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = 1500, max_bytes: int = 24 << 20, epochs: int = 7) -> Network:
    """A network fitted on a bounded sample of labelled rows.

    The bounds are ``rows_per_class`` texts of either label, those of the smallest hash of
    their id, and of these together ``max_bytes`` of whole texts (see ``_fitting``); texts
    over half of ``max_bytes`` are passed over.  Rows whose crc32(id as text) mod 4 is 2 are
    held out.  Null labels, ids and texts, and labels but 0 and 1, are passed over.  Where
    labelled texts of both labels exist, but those of a label are all too long, a ValueError
    says so.  Where there are texts of one label alone, nothing tells texts apart: every text
    scores that label; and without labelled texts every text scores 1, for there is nothing
    against any.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(F.crc32(F.col("id").cast("string")) % 4 != 2).distinct()
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("th")).filter("id is not null and text is not null")
    # The bounds see sizes, not texts.
    slim = texts.select("id", "th", F.octet_length("text").cast("long").alias("size")).join(usable, "id").withColumn("o", F.xxhash64("id", F.lit(11)))
    order = ["o", "id", "th"]
    sample = {y: [tuple(r) for r in slim.filter((F.col("y") == y) & (F.col("size") <= max_bytes // 2)).distinct().orderBy(*order).limit(rows_per_class).select("id", "th", "size").collect()] for y in (0, 1)}
    chosen = [(*r[:2], y) for y, rows in _fitting(sample, max_bytes).items() for r in rows]
    net = Network()
    if len({y for *_, y in chosen}) < 2:
        labels_seen = {r.y for r in slim.select("y").distinct().collect()}
        if len(labels_seen) == 2:
            raise ValueError(f"labelled texts of both labels exist, but those of one are all over max_bytes / 2 = {max_bytes // 2} bytes: no classifier is fitted")
        net.prior = float(min(labels_seen, default=1))
        return net
    some = docs.sparkSession.createDataFrame(chosen, "id long, th long, y int")
    rows = texts.join(F.broadcast(some), ["id", "th"]).dropDuplicates(["id", "th", "y"]).withColumn("o", F.xxhash64("id", F.lit(11))).orderBy("o", "id", "y", "text").select("text", "y").toArrow()
    return net.fit(rows.column("text"), rows.column("y").to_numpy().astype(np.float32), epochs)


def _fitting(sample: dict[int, list[tuple]], max_bytes: int) -> dict[int, list[tuple]]:
    """The rows (.., size) of each label that fit together in ``max_bytes``, in their order.

    The label of fewer bytes gets up to half, the other what is left.  Only a text that
    doesn't fit is passed over, not those after it; and texts over a sixteenth of the budget
    come after the others, so that a few of them can't take the place of all.
    """
    out, left = {}, max_bytes
    for k, y in enumerate(sorted(sample, key=lambda y: sum(r[-1] for r in sample[y]))):
        budget = left if k else max_bytes // 2
        taken, room = set(), budget
        for i in sorted(range(len(sample[y])), key=lambda i: 16 * sample[y][i][-1] > budget):
            if sample[y][i][-1] <= room:
                taken.add(i)
                room -= sample[y][i][-1]
        out[y] = [r for i, r in enumerate(sample[y]) if i in taken]
        left -= budget - room
    return out


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **fit) -> DataFrame:
    """One row per document: docs' columns, then held_out, score, predicted.

    score is the probability of label 1, of the whole text (a null text counts as empty;
    empty texts are scored like any other); predicted is 1 if score >= threshold.  held_out
    says that crc32(id as text) mod 4 is 2 (a null id is never held out).  The score depends
    on the text alone, so repeated rows score alike; where the labels are of one kind, or
    none, all texts score alike (see ``train``); an empty table gives an empty result;
    columns of docs that bear a result's name, in any case, are replaced.  See ``train`` for the sample
    that the classifier is fitted on; scoring is a narrow transformation.
    """
    docs = without_results(docs, ("held_out", "score", "predicted"), id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(train(docs, labels, id_col, text_col, **fit)))
    schema = StructType([*docs.schema.fields]).add("score", DoubleType())
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def scored(batches):
        net = pickle.loads(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(net.score(b.column(at)))], names=[*b.schema.names, "score"])

    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))
    out = docs.mapInArrow(scored, schema)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*names, held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
