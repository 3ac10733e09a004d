"""Quality classifier: gated attention over the passages of a document.

A document is a bag of passages. Every passage is encoded as a vector; a gate learnt from
document labels weighs the passages; the weighted mean is scored (attention-based
multiple-instance learning).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from waymark.llm.common import Words, duplicated, hash_names, mix, slices

PASSAGE_WORDS = 64
HASHED = 64
SHAPES = 14
#: Labelled documents per class that the model is fitted on, at most (lowest hash first).
SAMPLE_PER_CLASS = 1200
#: Passages of a sampled document that enter the fit, spread over the whole text.
SAMPLE_PASSAGES = 24
#: Bytes of text that are encoded at a time: a worker's arrays take some twenty times as much, and
#: what a worker once took stays with it while later steps run.
TEXT_BYTES = 1 << 20
#: A document is predicted good from this score on.
CUT = 0.3


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and vector of every passage of 64 words (the last one is shorter).

    Vectors hold shape statistics (length, case, digits, symbols, punctuation, repetition,
    stops) and hashed word counts. A text without words has one passage of zeros.
    """
    words = Words(texts)
    n, ids, doc = len(words.ids), words.ids, words.doc
    per_doc = np.maximum(1, -(-words.counts // PASSAGE_WORDS))
    base = np.concatenate([[0], np.cumsum(per_doc)])
    rows = np.repeat(np.arange(words.rows), per_doc)
    place = base[doc] + (np.arange(n) - words.starts[doc]) // PASSAGE_WORDS
    out = np.zeros((base[-1], SHAPES + HASHED), np.float32)
    if not n:
        return rows, out
    size = np.bincount(place, minlength=base[-1]).astype(np.float32)
    some = np.maximum(size, 1)
    names = words.names
    length = np.asarray(pc.utf8_length(names), dtype=np.float64)

    def share(pattern):
        return np.asarray(pc.count_substring_regex(names, pattern), dtype=np.float64)

    def per_passage(values):
        return np.bincount(place, weights=values[ids], minlength=base[-1])

    chars = np.maximum(1, per_passage(length))
    upper, letters = share(r"\p{Lu}"), share(r"\p{L}")
    for k, values in enumerate([
        upper, share(r"\p{N}"), share(r"[#*$%&|<>]"), share(r"[.,;:]"), share(r"[!?]"),
        share(r"[^\p{L}\p{N}\s]"),
    ]):
        out[:, k] = 4 * per_passage(values) / chars
    out[:, 6] = chars / some / 8
    out[:, 7] = np.sqrt(np.maximum(0, per_passage(length**2) / some - (chars / some) ** 2)) / 4
    out[:, 8] = per_passage(((upper == letters) & (letters > 1)).astype(float)) / some
    out[:, 9] = per_passage((letters == 0).astype(float)) / some
    for k, width in ((10, 1), (11, 3)):
        first = words.windows(width)
        first = first[place[first] == place[first + width - 1]]
        keys = tuple(ids[first + i] for i in range(width)) + (place[first],)
        again = np.bincount(place[first[duplicated(keys)]], minlength=base[-1])
        out[:, k] = again / some
    out[:, 12] = size / PASSAGE_WORDS
    out[:, 13] = per_passage(np.asarray(pc.match_substring_regex(names, r"[.!?]$"), dtype=float)) / some * 4
    slot = (mix(hash_names(names)) % np.uint64(HASHED)).astype(np.int64)
    counts = np.bincount(place * HASHED + slot[ids], minlength=base[-1] * HASHED)
    out[:, SHAPES:] = np.sqrt(counts.reshape(-1, HASHED) / some[:, None])
    return rows, out


@dataclass
class Model:
    """Standardisation, encoder, gate and head. All arrays are small and fixed in size."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict

    def forward(self, x: np.ndarray, rows: np.ndarray, n: int):
        """Per bag logit; rows ascending, every bag has a passage."""
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale) @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = (t * g) @ p["w"]
        starts = np.searchsorted(rows, np.arange(n))
        a = np.exp(raw - np.maximum.reduceat(raw, starts)[rows])
        a /= np.add.reduceat(a, starts)[rows]
        z = np.add.reduceat(h * a[:, None], starts)
        return z @ p["c"] + p["b"], (h, t, g, a, z, starts)

    def score(self, x, rows, n) -> np.ndarray:
        if not n:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.forward(x, rows, n)[0], -40, 40)))


def fit(x: np.ndarray, rows: np.ndarray, y: np.ndarray, prior: float, epochs: int = 30, hidden: int = 24) -> Model:
    """Fit on balanced bags by Adam; the bias is then moved to the classes' true shares."""
    rng = np.random.default_rng(7)
    mean, scale = x.mean(0), x.std(0) + 0.05
    d = x.shape[1]
    p = {
        "E": rng.normal(0, d**-0.5, (d, hidden)), "e": np.zeros(hidden),
        "V": rng.normal(0, 0.3, (hidden, hidden)), "U": rng.normal(0, 0.3, (hidden, hidden)),
        "w": rng.normal(0, 0.3, hidden), "c": rng.normal(0, 0.3, hidden), "b": np.zeros(1),
    }
    model = Model(mean, scale, p)
    n = len(y)
    starts = np.searchsorted(rows, np.arange(n + 1))
    weight = np.where(y == 1, n / 2 / max(1, (y == 1).sum()), n / 2 / max(1, (y == 0).sum()))
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for part in np.array_split(order, max(1, n // 128)):
            take = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in part])
            sub = np.repeat(np.arange(len(part)), [starts[i + 1] - starts[i] for i in part])
            xs = (x[take] - mean) / scale
            logit, (h, t, g, a, z, first) = model.forward(x[take], sub, len(part))
            grad = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[part]) * weight[part] / len(part)
            dz = grad[:, None] * p["c"]
            da = (h * dz[sub]).sum(1)
            draw = a * (da - np.add.reduceat(a * da, first)[sub])
            dtg = draw[:, None] * p["w"]
            dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
            dh = (dz[sub] * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
            grads = {
                "E": xs.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg,
                "w": (t * g).T @ draw, "c": z.T @ grad, "b": np.array([grad.sum()]),
            }
            step += 1
            for k in p:
                g1 = grads[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g1
                v2[k] = 0.999 * v2[k] + 0.001 * g1**2
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    p["b"] = p["b"] + np.log(prior / (1 - prior))
    return model


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most `SAMPLE_PER_CLASS` labelled documents of each class outside the held-out
    fifth. Their encoded passages reach the driver, at most `SAMPLE_PASSAGES` per document.
    Labels that contradict each other for a doc_id, and null ones, are left out."""
    usable = (
        labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
    )
    order = F.struct(F.xxhash64("doc_id"), "doc_id")
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col("quality") == y).orderBy(order).limit(SAMPLE_PER_CLASS)
        part = part.select("doc_id", F.col("quality").alias("_quality"))
        chosen = part if chosen is None else chosen.unionByName(part)
    share = usable.agg(F.avg("quality")).head()[0]
    bags = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def encoded(batches):
        for batch in slices(batches, "text", TEXT_BYTES):
            rows, x = encode(batch.column("text"))
            starts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            picked = []
            for i in range(batch.num_rows):
                k = starts[i + 1] - starts[i]
                some = np.unique(np.linspace(0, k - 1, min(k, SAMPLE_PASSAGES)).astype(int)) + starts[i]
                picked.append(x[some].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_quality").cast(pa.int32()), pa.array(picked, pa.binary())],
                ["doc_id", "y", "x"],
            )

    got = bags.mapInArrow(encoded, "doc_id long, y int, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    width = SHAPES + HASHED
    y = np.array([r.y for r in got], dtype=float)
    if len(set(y)) < 2:  # nothing to learn from: every score is the share of good labels
        one = np.zeros((2, width))
        model = fit(one, np.arange(2), np.array([0.0, 1.0]), 0.5, epochs=0)
        rate = min(max(0.5 if share is None else float(share), 1e-3), 1 - 1e-3)
        model.p["c"], model.p["b"] = model.p["c"] * 0, np.array([np.log(rate / (1 - rate))])
        return model
    bags_x = [np.frombuffer(r.x, "<f4").reshape(-1, width).astype(float) for r in got]
    rows = np.repeat(np.arange(len(got)), [len(b) for b in bags_x])
    return fit(np.concatenate(bags_x), rows, y, float(share))


def scored(batches, model: Model):
    """The batches with `quality_score`."""
    for batch in slices(batches, "text", TEXT_BYTES):
        rows, x = encode(batch.column("text"))
        s = model.score(x, rows, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, "quality_score"])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of `docs` with `quality_score`, from whole texts; null counts as empty."""
    schema = StructType([*docs.schema.fields, StructField("quality_score", DoubleType())])
    return docs.mapInArrow(lambda batches: scored(batches, model), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, …) with quality_score; repeated rows are scored alike."""
    return score_documents(docs, train(docs, labels))
