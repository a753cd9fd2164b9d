"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each keeps its largest response, and a
softmax over them gives the languages. The network is trained in numpy on windows of labelled texts; a document's
probabilities are the mean over all its windows. As embedding and filters are linear, a filter's response is a sum of one
table entry for each byte under it, which is how whole batches of windows are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, text_chunks
from ._spark import durable, labelled_texts, nth_value

LETTER = r"\p{L}"
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: Bytes of windows scored together.
BATCH = 192 << 10
#: Label of made-up texts in no language, for telling whether a text is in any.
NO_LANGUAGE = "\0none"


class Net(NamedTuple):
    labels: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # width x EMBED x FILTERS, for each width
    bias: np.ndarray  # all filters
    out: np.ndarray  # all filters x labels
    out_bias: np.ndarray


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each padded with zero bytes; and each window's row."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][row] + nth * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    out = np.concatenate([LOWER[data], np.zeros(WINDOW, np.uint8)])[at]
    out[at >= offsets[1:][row][:, None]] = 0
    return out, row


def train(texts: list[bytes], labels: list[str], steps: int = 500, batch: int = 64, seed: int = 9) -> Net | None:
    """Adam on the cross-entropy of windows; every label weighs the same. None without labels."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    blocks = [np.frombuffer(t + bytes(-len(t) % WINDOW), np.uint8).reshape(-1, WINDOW) for t in texts]
    x = LOWER[np.concatenate(blocks)]
    y = np.repeat(np.searchsorted(names, np.array(labels)), [len(b) for b in blocks])
    full = (x > 0).sum(axis=1) >= WINDOW // 8
    if full.any() and len(set(y[full])) == len(names):
        x, y = x[full], y[full]
    by = [np.flatnonzero(y == k) for k in range(len(names))]
    by = [b for b in by if len(b)]
    if not by:
        return None
    n_f = FILTERS * len(WIDTHS)
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "b": np.zeros(n_f), "o": rng.normal(0, 0.3, (n_f, len(names))), "c": np.zeros(len(names))}
    p |= {f"f{w}": rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS)) for w in WIDTHS}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, -(-batch // len(by))) for b in by])
        xb, yb = x[pick].astype(np.int64), y[pick]
        # Every fourth window is as short as a short text.
        stop = np.where(rng.random(len(xb)) < 0.25, rng.integers(8, WINDOW + 1, len(xb)), WINDOW)
        xb[np.arange(WINDOW) >= stop[:, None]] = 0
        emb = p["e"][xb]
        pooled, where = [], []
        for k, w in enumerate(WIDTHS):
            r = sum(emb[:, j : WINDOW - w + 1 + j] @ p[f"f{w}"][j] for j in range(w)) + p["b"][k * FILTERS : (k + 1) * FILTERS]
            where.append(r.argmax(axis=1))
            pooled.append(np.maximum(r.max(axis=1), 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ p["o"] + p["c"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(len(yb)), yb] -= 1
        q /= len(yb)
        g = {"o": h.T @ q, "c": q.sum(axis=0), "e": np.zeros_like(p["e"])}
        dh = (q @ p["o"].T) * (h > 0)
        g["b"] = dh.sum(axis=0)
        for k, w in enumerate(WIDTHS):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            gf = np.zeros_like(p[f"f{w}"])
            for j in range(w):
                under = xb[np.arange(len(xb))[:, None], where[k] + j]
                gf[j] = np.einsum("nfe,nf->ef", p["e"][under], d)
                np.add.at(g["e"], under, d[:, :, None] * p[f"f{w}"][j].T[None])
            g[f"f{w}"] = gf
        for k, a in p.items():
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            a -= 0.01 * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Net(names, p["e"], [p[f"f{w}"] for w in WIDTHS], p["b"], p["o"], p["c"])


def tables(net: Net) -> list[list[np.ndarray]]:
    """For each width and each byte under a filter, the responses of all 256 byte values."""
    return [[np.ascontiguousarray(net.embed @ f[j], np.float32) for j in range(len(f))] for f in net.filters]


def probabilities(net: Net, responses: list[list[np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Softmax of each window."""
    pooled = []
    for own in responses:
        w = len(own)
        r = np.take(own[0], x[:, : WINDOW - w + 1], axis=0)
        for j in range(1, w):
            r += np.take(own[j], x[:, j : WINDOW - w + 1 + j], axis=0)
        pooled.append(r.max(axis=1))
    h = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0)
    z = h @ net.out + net.out_bias
    q = np.exp(z - z.max(axis=1, keepdims=True))
    return q / q.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 500) -> Net | None:
    """Train on the whole texts of at most `per_label` ids of each label in `docs`; texts without a letter teach nothing."""
    rows = _labelled(docs, id_col, text_col, lang_col, per_label)
    return train([t.encode() for _, t in rows], [lang for lang, _ in rows])


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_label: int) -> list[tuple[str, str]]:
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"), F.col(text_col).alias("text"))
    return [(lang, text) for lang, _, text in labelled_texts(rows.select("id", "label"), rows, per_label) if any(c.isalpha() for c in text)]


def no_language(text: bytes, rng: np.random.Generator) -> bytes:
    """A text like `text` in no known language: its letters exchanged for others throughout, as in a language never learnt;
    its bytes between spaces in disorder; or a run of codes."""
    kind = rng.integers(3)
    data = LOWER[np.frombuffer(text, np.uint8)]
    if kind == 0:
        swap = np.arange(256, dtype=np.uint8)
        swap[0x61:0x7B] = rng.permutation(swap[0x61:0x7B])
        swap[0x80:0xC0] = rng.permutation(swap[0x80:0xC0])
        return swap[data].tobytes()
    if kind == 1:
        at = np.flatnonzero(data != 0x20)
        out = data.copy()
        out[at] = data[rng.permutation(at)]
        return out.tobytes()
    signs = (b"0123456789abcdef", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=", b"0123456789.,:;-/ ", b"!#$%&*+-/<=>?@^_|~ x")
    own = np.frombuffer(signs[rng.integers(4)], np.uint8)
    return own[rng.integers(len(own), size=min(len(text), 4096))].tobytes()


class Gate(NamedTuple):
    """A network that also knows texts of no language, and the most of those that a text may look like."""

    net: Net
    limit: float


def fit_gate(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_label: int = 500, loss: float = 0.001, seed: int = 5) -> Gate | None:
    """Learn from labelled rows that are not held out, of at most `per_label` ids of each label, and from made-up texts in no language. The
    limit is a half, or more if over a share `loss` of all labelled texts that are held out would go by it; it doesn't depend on how
    many languages there are. None without labels."""
    rows = _labelled(docs.filter(~held_out(id_col)), id_col, text_col, lang_col, per_label)
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    texts = [t.encode() for _, t in rows]
    made = [no_language(t, rng) for t in texts]
    net = train(texts + made, [lang for lang, _ in rows] + [NO_LANGUAGE] * len(made), steps=800)
    return Gate(net, limit_of(docs.filter(held_out(id_col)), net, text_col, lang_col, loss))


def limit_of(docs: DataFrame, net: Net, text_col: str, lang_col: str, loss: float) -> float:
    """The least limit, a half or more, by which at most a share `loss` of all labelled texts with a letter in `docs` go.

    Every one is judged. Only those that are more like no language than a half bear on the limit, so these values are written and
    the one of the wanted rank among them is selected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        own, none = tables(net), net.labels.index(NO_LANGUAGE)
        for batch in batches:
            like = np.concatenate([np.zeros(0), *(mean[:, none] for _, mean in means(net, own, batch.column(0)))])
            over = like[like > 0.5]
            yield pa.RecordBatch.from_arrays([pa.array([len(like)], pa.int64()), pa.array([over], pa.list_(pa.float64()))], ["n", "over"])

    rows = docs.filter(F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False))).select(F.col(text_col).alias("text"))
    judged = durable(rows.mapInArrow(run, "n long, over array<double>"))
    seen = judged.agg(F.sum("n").alias("n"), F.sum(F.size("over")).alias("over")).first()
    if not seen.over:
        return 0.5
    # Of n values in order the one at n (1 - loss), counted from the first of those over a half.
    rank = int(seen.n * (1 - loss)) - (seen.n - seen.over)
    if rank < 0:
        return 0.5
    counts = judged.select(F.explode("over").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    return float(nth_value(counts, rank))


def means(net: Net, own: list[list[np.ndarray]], texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Of each run of texts: its first row, and each text's mean probabilities over all its windows."""
    for chunk in text_chunks(texts, BATCH):
        n = len(chunk.offsets) - 1
        total, count = np.zeros((n, len(net.labels))), np.zeros(n)
        if len(chunk.data):
            x, row = windows_of(chunk.data, chunk.offsets)
            for k in range(0, len(x), BATCH // WINDOW):
                np.add.at(total, row[k : k + BATCH // WINDOW], probabilities(net, own, x[k : k + BATCH // WINDOW]))
            count = np.bincount(row, minlength=n)
        yield chunk.first, total / np.maximum(count, 1)[:, None]


def judge(net: Net | None, own: list[list[np.ndarray]], texts: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; `letters` says which texts have a letter."""
    preds, scores = ["und"] * len(texts), np.zeros(len(texts))
    for first, mean in means(net, own, texts) if net else ():
        best = mean.argmax(axis=1)
        for k in np.flatnonzero(letters[first : first + len(mean)].astype(bool)).tolist():
            preds[first + k], scores[first + k] = net.labels[best[k]], min(mean[k, best[k]], 1.0)
    return preds, scores


def identify(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, lang_pred, score (mean probability of that language over all windows of the text).

    Null texts and texts without a letter are `und` with score 0, and so is everything where no label was learnt. Rows
    that repeat an id each get a row; ties go to the first label in order; an empty table gives none. Only the columns
    of id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        own = tables(net) if net else []
        for batch in batches:
            preds, scores = judge(net, own, batch.column(1), batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    letter = F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False))
    out = docs.select(F.col(id_col).cast("string"), F.col(text_col), letter.alias("letter")).mapInArrow(run, "id string, lang_pred string, score double")
    return out.select(F.col("id").cast(kind).alias(id_col), "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows not to learn from; a null id has no remainder and is not held out, but can't be learnt from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The registered form: id, held_out, lang_pred, score; learnt from rows that are not held out."""
    net = fit(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    return identify(docs, net, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """`docs` without those of no language, decided for each row by its own text.

    Null texts, texts without a letter and, where labels can be learnt from, texts that look more than the gate's limit
    like texts of no language go: codes, letters in disorder, and languages never learnt. Rows that repeat an id, or have
    none, are judged each; all columns stay as they are. An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_gate(docs, id_col, text_col, lang_col, **options))
    at, width = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = shared.value
        own = tables(gate.net) if gate else []
        for batch in batches:
            stays = batch.column(width).to_numpy(zero_copy_only=False).astype(bool)
            for first, mean in means(gate.net, own, batch.column(at)) if gate else ():
                stays[first : first + len(mean)] &= mean[:, gate.net.labels.index(NO_LANGUAGE)] <= gate.limit
            yield batch.select(range(width)).filter(pa.array(stays, pa.bool_()))

    letter = F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False))
    return docs.select("*", letter.alias("__letter")).mapInArrow(run, docs.schema)
