"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows of ``WINDOW``, forwards and
backwards, labels every byte, and a document's probabilities are the mean over
all its bytes.  It is trained here in numpy by backpropagation through time.

Training rows are those with a language whose crc32(id as text) mod 3 is not 1.
Of each language about ``SAMPLE`` documents are drawn by a hash of the id and
``PIECES`` stretches of ``STRETCH`` characters cut from places that the hash
gives: a bounded, documented sample, collected by the driver.  Nothing but the
text enters a prediction, and every byte of every text is read.

Texts that are null, or hold no letter, get ``und`` with score 0; so does every
text where no row can be learnt from.  An empty table gives an empty result.
Equal texts get equal predictions, whatever their ids; repeated rows are drawn
once; very long texts are read window by window; of labels that tie for a text
the first by name is taken.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rowwise

HIDDEN, WINDOW = 8, 128
SAMPLE, PIECES, STRETCH = 400, 3, 192
STEPS, BATCH, TRAIN_WINDOW = 300, 192, 48
#: Of more languages than this, those of most rows are learnt, and of equal ones the first by name.
MOST_LABELS = 1000
#: Windows of a block of the forward pass.
BLOCK = 1024


def held_out(id_col):
    """Rows that are never learnt from."""
    return F.crc32(id_col.cast("string")) % 3 == 1


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int = SAMPLE) -> list[tuple[str, str]]:
    """(label, stretch) pairs: about ``per_label`` documents of each label, by a hash."""
    rows = docs.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MOST_LABELS).collect()
    if not counts:
        return []
    n_of = F.create_map(*[F.lit(v) for r in counts for v in (r["label"], r["n"])])
    h = F.xxhash64(F.lit("train"), "id", "text")
    # a label that is not learnt has no number, and draws nothing; repeated rows are drawn once
    drawn = rows.where((F.pmod(h, F.element_at(n_of, F.col("label"))) < per_label) & F.col("text").rlike(r"\p{L}"))
    room = F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substr(F.col("text"), (F.pmod(F.xxhash64("id", i), room) + 1).cast("int"), F.lit(STRETCH)))
    return sorted((r["label"], s) for r in drawn.select("label", cut.alias("cut")).distinct().collect() for s in r["cut"])


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(p, steps):
    """States and gates of both directions; ``steps``: bytes as directions x time x batch."""
    _, t_max, batch = steps.shape
    hidden = p["u"].shape[1]
    h = np.zeros((t_max + 1, 2, batch, hidden), np.float32)
    gates = []
    for t in range(t_max):
        x = np.stack([p["x"][d][steps[d, t]] for d in (0, 1)])
        a = h[t] @ p["u"]
        z = _sigmoid(x[..., :hidden] + a[..., :hidden])
        r = _sigmoid(x[..., hidden : 2 * hidden] + a[..., hidden : 2 * hidden])
        n = np.tanh(x[..., 2 * hidden :] + r * a[..., 2 * hidden :])
        h[t + 1] = z * h[t] + (1 - z) * n
        gates.append((z, r, n, a[..., 2 * hidden :]))
    return h, gates


def _outputs(p, h):
    """Label probabilities, time x batch x labels."""
    y = h[1:, 0] @ p["v"][0] + h[:0:-1, 1] @ p["v"][1] + p["c"]
    y = np.exp(y - y.max(-1, keepdims=True))
    return y / y.sum(-1, keepdims=True)


def _gradients(p, steps, labels, mask):
    h, gates = _forward(p, steps)
    prob = _outputs(p, h)
    t_max, batch, _ = prob.shape
    loss = -np.log(np.maximum(prob[:, np.arange(batch), labels], 1e-9))[mask].mean()
    d = prob.copy()
    d[:, np.arange(batch), labels] -= 1
    d *= (mask / mask.sum())[..., None]
    flat = d.reshape(-1, d.shape[-1])
    hidden = p["u"].shape[1]
    g = {"c": flat.sum(0), "v": np.stack([h[1:, 0].reshape(-1, hidden).T @ flat, h[:0:-1, 1].reshape(-1, hidden).T @ flat])}
    out = np.stack([d @ p["v"][0].T, (d @ p["v"][1].T)[::-1]], axis=1)  # time x direction x batch x hidden
    du = np.zeros_like(p["u"])
    inputs = np.empty((t_max, 2, batch, 3 * hidden), np.float32)
    back = np.zeros((2, batch, hidden), np.float32)
    for t in range(t_max - 1, -1, -1):
        z, r, n, un = gates[t]
        dh = out[t] + back
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h[t] - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        inputs[t] = np.concatenate([dz, dr, dn], -1)
        da = np.concatenate([dz, dr, dn * r], -1)
        du += h[t].transpose(0, 2, 1) @ da
        back = dh * z + da @ p["u"].transpose(0, 2, 1)
    g["u"] = du
    g["x"] = np.stack([np.stack([np.bincount(steps[k].ravel(), inputs[:, k, :, j].ravel(), 256) for j in range(3 * hidden)], 1) for k in (0, 1)]).astype(np.float32)
    return loss, g


def train(pairs: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 5) -> dict:
    """The network's weights and its labels, by backpropagation through time with Adam."""
    labels = sorted({a for a, _ in pairs})
    rng = np.random.default_rng(seed)
    of: list[list[bytes]] = [[] for _ in labels]
    for a, s in pairs:
        if len(raw := s.encode("utf-8", "replace")) > 0:
            of[labels.index(a)].append(raw)
    p = {
        "x": rng.normal(0, 0.3, (2, 256, 3 * hidden)),
        "u": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)),
        "v": rng.normal(0, 0.3, (2, hidden, len(labels))),
        "c": np.zeros(len(labels)),
    }
    p = {k: a.astype(np.float32) for k, a in p.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1 if len(labels) > 1 else 1):
        y = rng.integers(0, len(labels), BATCH)
        s, mask = np.zeros((BATCH, TRAIN_WINDOW), np.uint8), np.zeros((BATCH, TRAIN_WINDOW), bool)
        for i, k in enumerate(y):
            raw = of[k][rng.integers(len(of[k]))]
            at = rng.integers(0, max(1, len(raw) - TRAIN_WINDOW + 1))
            raw = raw[at : at + TRAIN_WINDOW]
            s[i, : len(raw)] = np.frombuffer(raw, np.uint8)
            mask[i, : len(raw)] = True
        _, g = _gradients(p, np.stack([s.T, s.T[::-1]]), y, mask.T)
        size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = 0.03 * (1 - 0.9 * step / steps)
        for k in p:
            a = g[k] * min(1.0, 1.0 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p | {"labels": labels}


class Reader:
    """The forward pass over many windows: features by windows, so that each gate is contiguous."""

    def __init__(self, p: dict):
        self.hidden, self.labels = p["u"].shape[1], p["labels"]
        half = np.ones(3 * self.hidden, np.float32)
        half[: 2 * self.hidden] = 0.5  # sigmoid(a) = tanh(a / 2) / 2 + 1 / 2
        self.x = [np.ascontiguousarray((p["x"][d] * half).T) for d in (0, 1)]
        self.u = [np.ascontiguousarray((p["u"][d] * half).T) for d in (0, 1)]
        self.v = [np.ascontiguousarray(p["v"][d].T) for d in (0, 1)]
        self.c = p["c"][:, None].astype(np.float32)

    def _states(self, d: int, bytes_: np.ndarray) -> np.ndarray:
        """States after each of the bytes (time x windows): time x hidden x windows."""
        n_steps, n = bytes_.shape
        k = self.hidden
        states = np.empty((n_steps, k, n), np.float32)
        h = np.zeros((k, n), np.float32)
        x, a = np.empty((3 * k, n), np.float32), np.empty((3 * k, n), np.float32)
        for t in range(n_steps) if d == 0 else range(n_steps - 1, -1, -1):
            np.take(self.x[d], bytes_[t], axis=1, out=x, mode="clip")
            np.matmul(self.u[d], h, out=a)
            zr = x[: 2 * k]
            zr += a[: 2 * k]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            new = a[2 * k :]
            new *= zr[k:]
            new += x[2 * k :]
            np.tanh(new, out=new)
            h = np.subtract(h, new, out=states[t])
            h *= zr[:k]
            h += new
        return states

    def windows(self, bytes_: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Summed label probabilities of each window (windows x time), over its first ``lengths`` bytes."""
        by_time = np.ascontiguousarray(bytes_.T)
        y = np.matmul(self.v[0], self._states(0, by_time))
        y += np.matmul(self.v[1], self._states(1, by_time))
        y += self.c
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        if lengths.min() < len(by_time):
            y *= (np.arange(len(by_time))[:, None] < lengths)[:, None, :]
        return y.sum(axis=0, dtype=np.float64).T

    def documents(self, raws: list[bytes]) -> np.ndarray:
        """Label probabilities of each text: the mean over its bytes; zeros for an empty one."""
        out = np.zeros((len(raws), len(self.labels)))
        sizes = np.array([len(r) for r in raws])
        counts = -(-sizes // WINDOW)
        flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
        at = 0
        for r, n in zip(raws, counts):
            flat[at : at + len(r)] = np.frombuffer(r, np.uint8)
            at += int(n) * WINDOW
        bytes_ = flat.reshape(-1, WINDOW)
        owner = np.repeat(np.arange(len(raws)), counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        lengths = np.minimum(WINDOW, np.repeat(sizes, counts) - (np.arange(len(bytes_)) - first) * WINDOW)
        for a in range(0, len(bytes_), BLOCK):
            got = self.windows(bytes_[a : a + BLOCK], lengths[a : a + BLOCK])
            for c in range(len(self.labels)):
                out[:, c] += np.bincount(owner[a : a + BLOCK], got[:, c], len(raws))
        return out / np.maximum(sizes, 1)[:, None]


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """Per row: the id, ``keep`` columns, ``lang_pred`` and ``score``; no shuffle."""
    rows = docs.select(F.col(id_col).alias("__id"), *[F.col(c) for c in keep if c != id_col], F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("__read"))

    def make():
        reader = Reader(model) if model else None

        def fn(texts):
            raws = [t.encode("utf-8", "replace") if t and reader else b"" for t in texts]
            pred, score, a = ["und"] * len(raws), [0.0] * len(raws), 0
            while a < len(raws):
                b, size = a, 0
                while b < len(raws) and (b == a or size + len(raws[b]) <= 1 << 20):
                    size += len(raws[b])
                    b += 1
                if size:
                    prob = reader.documents(raws[a:b])
                    for i, k in enumerate(prob.argmax(1)):
                        if raws[a + i]:
                            pred[a + i], score[a + i] = reader.labels[k], min(1.0, float(prob[i, k]))
                a = b
            return [pred, score]

        return fn

    return rowwise(rows, ["__read"], make, "lang_pred string, score double").withColumnRenamed("__id", id_col)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **settings) -> dict | None:
    """A model of ``docs``' labelled rows; None where there are none."""
    pairs = sample(docs, id_col, text_col, label_col)
    return train(pairs, **settings) if pairs else None


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **settings) -> DataFrame:
    """Per row: the id, ``held_out``, ``lang_pred`` and ``score``."""
    model = fit(docs, id_col, text_col, label_col, **settings)
    out = predict(docs, model, id_col, text_col)
    return out.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", least: float = 0.35, **settings) -> DataFrame:
    """``docs`` without the rows that have no language: ``und``, or a score below ``least``.  All columns are kept."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    model = fit(docs, id_col, text_col, label_col, **settings)
    plain = docs.toDF(*names.values())
    found = predict(plain, model, names[id_col], names[text_col], keep=list(names.values()))
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(*[F.col(v).alias(c) for c, v in names.items()])
