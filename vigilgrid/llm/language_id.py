"""Language of a text by a bidirectional gated recurrent network over its bytes.

Two gated recurrent layers read the bytes of a window, one from each end; their states give a
distribution over the learned languages at every position, trained by backpropagation through time in
numpy. A document's probabilities are the mean over all its letter positions, so whole texts count,
window by window, in bounded memory. Gates and candidates use x / (1 + |x|) (scaled to 0..1 for gates)
in place of the exponential functions; it has the same shape and costs a tenth.

Training reads a bounded sample, documented by ``SAMPLE_PER_LANG`` and ``WINDOWS_PER_TEXT``: of every
language the texts with the smallest hash. The parameters of the network are a few kilobytes and
travel with the task; no row moves for prediction.

Defined results: ``und`` with score 0 for a null text or one without a letter; the same for every text
if no labelled text is given; ties go to the language that sorts first; repeated rows give a row each; very long texts
are read whole, in windows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .common import append_values, fresh_name, map_texts, smallest_hashes

SAMPLE_PER_LANG = 400
WINDOWS_PER_TEXT = 6
MAX_LANGS = 1000
UNKNOWN = "und"
TRAIN_LENGTH = 64
READ_LENGTH = 128
READ_WINDOWS = 4096
SPACE = 0x20

_LETTER_BYTES = np.zeros(256, dtype=bool)
_LETTER_BYTES[ord("a") : ord("z") + 1] = True
_LETTER_BYTES[0x80:] = True


@dataclass
class Network:
    """Weights: per direction the input rows of all bytes (gates, candidate) and the recurrent matrix."""

    langs: list[str]
    inputs: np.ndarray  # direction, 3 * hidden, 256
    recurrent: np.ndarray  # direction, 3 * hidden, hidden
    out: np.ndarray  # direction, languages, hidden
    bias: np.ndarray  # languages

    @classmethod
    def start(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return cls(
            langs,
            normal(2, 3 * hidden, 256, scale=0.3),
            normal(2, 3 * hidden, hidden, scale=hidden**-0.5),
            normal(2, len(langs), hidden, scale=hidden**-0.5),
            np.zeros(len(langs), np.float32),
        )

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.out, self.bias]


def _squash(x: np.ndarray, spare: np.ndarray) -> None:
    """x / (1 + |x|), in place."""
    np.abs(x, out=spare)
    spare += 1
    x /= spare


def position_probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """Distribution over the languages at every position: (length, languages, windows) of (length, windows) bytes."""
    length, n = windows.shape
    hidden = net.recurrent.shape[2]
    scores = np.empty((length, len(net.langs), n), np.float32)
    scores[:] = net.bias[:, None]
    x = np.empty((3 * hidden, n), np.float32)
    u, spare = np.empty_like(x), np.empty((2 * hidden, n), np.float32)
    windows = windows.astype(np.intp)
    for way in range(2):
        h = np.zeros((hidden, n), np.float32)
        for t in range(length) if way == 0 else range(length - 1, -1, -1):
            net.inputs[way].take(windows[t], axis=1, out=x, mode="clip")
            np.matmul(net.recurrent[way], h, out=u)
            gates = x[: 2 * hidden]
            gates += u[: 2 * hidden]
            _squash(gates, spare)
            gates += 1
            gates *= 0.5
            new = u[2 * hidden :]
            new *= gates[hidden:]
            new += x[2 * hidden :]
            _squash(new, spare[:hidden])
            h -= new
            h *= gates[:hidden]
            h += new
            scores[t] += net.out[way] @ h
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the marked positions, and its gradients by backpropagation through time."""
    length, n = windows.shape
    hidden = net.recurrent.shape[2]
    kept = []
    scores = np.zeros((length, len(net.langs), n), np.float32) + net.bias[:, None]
    for way in range(2):
        h = np.zeros((hidden, n), np.float32)
        steps = []
        for t in range(length) if way == 0 else range(length - 1, -1, -1):
            x = net.inputs[way][:, windows[t]]
            u = net.recurrent[way] @ h
            gates = x[: 2 * hidden] + u[: 2 * hidden]
            gates = 0.5 + 0.5 * gates / (1 + np.abs(gates))
            z, r = gates[:hidden], gates[hidden:]
            new = x[2 * hidden :] + r * u[2 * hidden :]
            new = new / (1 + np.abs(new))
            after = new + z * (h - new)
            steps.append((t, h, gates, u[2 * hidden :], new, after))
            h = after
            scores[t] += net.out[way] @ h
        kept.append(steps)
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=1, keepdims=True)
    total = max(1.0, float(mask.sum()))
    loss = -float((np.log(p[:, labels, np.arange(n)] + 1e-9) * mask).sum()) / total
    p[:, labels, np.arange(n)] -= 1
    p *= (mask / total)[:, None, :]
    grads = [np.zeros_like(w) for w in net.weights]
    grads[3] += p.sum(axis=(0, 2))
    flat = windows.ravel()
    for way in range(2):
        rec, out = net.recurrent[way], net.out[way]
        carried = np.zeros((hidden, n), np.float32)
        into = np.empty((length, 3 * hidden, n), np.float32)
        for t, h, gates, un, new, after in reversed(kept[way]):
            grads[2][way] += p[t] @ after.T
            dh = out.T @ p[t] + carried
            z, r = gates[:hidden], gates[hidden:]
            da = dh * (1 - z) * (1 - np.abs(new)) ** 2
            dg = np.concatenate([dh * (h - new), da * un]) * 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
            du = np.concatenate([dg, da * r])
            grads[1][way] += du @ h.T
            carried = dh * z + rec.T @ du
            into[t, : 2 * hidden] = dg
            into[t, 2 * hidden :] = da
        for i in range(3 * hidden):
            grads[0][way, i] = np.bincount(flat, weights=into[:, i].ravel(), minlength=256)
    return loss, grads


def train(
    windows: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = 8, steps: int = 360, batch: int = 256, seed: int = 7
) -> Network:
    """Fit a network to windows of bytes (windows, length) with Adam; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    net = Network.start(langs, hidden, rng)
    first = [np.zeros_like(w) for w in net.weights]
    second = [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(windows), batch)
        part = windows[rows].T
        _, grads = gradients(net, part, labels[rows], _LETTER_BYTES[part].astype(np.float32))
        rate = 0.02 * min(1.0, 2 * (1 - (step - 1) / steps))
        for w, g, m, v in zip(net.weights, grads, first, second, strict=True):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def sample_windows(
    df: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG, per_text: int = WINDOWS_PER_TEXT
) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of bytes with the number of their language, from the texts with the smallest hashes.

    The choice moves hashes only and a language sends ``per_lang`` of them per task at most; the texts
    are met by a broadcast of that bounded list. What reaches the driver is at most
    ``languages * per_lang * per_text`` windows, for ``MAX_LANGS`` languages at most.
    """
    usable = df.select(F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_lang"))
    usable = usable.filter(F.col("_lang").isNotNull() & (F.length("_text") > 0)).withColumn("_h", F.xxhash64("_text"))
    distinct = usable.select("_lang", "_h").distinct()
    picked = smallest_hashes(distinct, "_lang", "_h", per_lang).select("_lang", "_h").collect()
    if len({row["_lang"] for row in picked}) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not picked:
        return np.zeros((0, TRAIN_LENGTH), np.uint8), np.zeros(0, np.int64), []
    # Made from Arrow: from Python rows Spark makes tables in more Python workers, which linger.
    columns = {"_lang": pa.array([row["_lang"] for row in picked], pa.string()), "_h": pa.array([row["_h"] for row in picked], pa.int64())}
    names = df.sparkSession.createDataFrame(pa.table(columns))
    rows = usable.join(F.broadcast(names), ["_lang", "_h"], "left_semi").select("_lang", "_h", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, cuts = [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = _bytes(value)
                spare = max(0, len(data) - TRAIN_LENGTH)
                for start in sorted({spare * i // max(1, per_text - 1) for i in range(per_text)}):
                    cuts.append(data[start : start + TRAIN_LENGTH].ljust(TRAIN_LENGTH, b" "))
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cuts, pa.binary())], names=["lang", "cut"])

    found = sorted(tuple(row) for row in rows.mapInArrow(run, "lang string, cut binary").distinct().collect())
    langs = sorted({name for name, _ in found})
    windows = np.frombuffer(b"".join(bytes(cut) for _, cut in found), np.uint8).reshape(-1, TRAIN_LENGTH)
    labels = np.array([langs.index(name) for name, _ in found])
    return windows, labels, langs


def balanced(labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Positions in which every label has as many as the most frequent one, by repeats."""
    groups = [np.flatnonzero(labels == k) for k in np.unique(labels)]
    most = max(map(len, groups))
    return np.concatenate([np.resize(rng.permutation(g), most) for g in groups])


def fit(df: DataFrame, text: str = "text", lang: str = "lang", **options) -> Network | None:
    """Network for the languages of ``df``; None without a labelled text."""
    windows, labels, langs = sample_windows(df, text, lang)
    if not langs:
        return None
    rows = balanced(labels, np.random.default_rng(3))
    return train(windows[rows], labels[rows], langs, **options)


def document_probabilities(net: Network, texts: list[str]) -> np.ndarray:
    """Mean distribution over the letter positions of each whole text: (texts, languages)."""
    sums = np.zeros((len(texts), len(net.langs)))
    data, starts, fresh, owners, at = [], [], [], [], 0
    for k, text in enumerate(texts):
        raw = _bytes(text)
        if len(raw) < READ_LENGTH:
            raw = raw.ljust(READ_LENGTH)
        first = np.arange(0, len(raw), READ_LENGTH)
        # The last window ends with the text; what the window before has read already is not counted again.
        begin = np.minimum(first, len(raw) - READ_LENGTH)
        data.append(raw)
        starts.append(begin + at)
        fresh.append(first - begin)
        owners.append(np.full(len(first), k))
        at += len(raw)
    buffer = np.frombuffer(b"".join(data), np.uint8)
    starts, fresh, owners = np.concatenate(starts), np.concatenate(fresh), np.concatenate(owners)
    steps = np.arange(READ_LENGTH)
    for i in range(0, len(starts), READ_WINDOWS):
        windows = buffer[starts[i : i + READ_WINDOWS] + steps[:, None]]
        counted = _LETTER_BYTES[windows] & (steps[:, None] >= fresh[i : i + READ_WINDOWS])
        p = position_probabilities(net, windows)
        p *= counted[:, None, :]
        np.add.at(sums, owners[i : i + READ_WINDOWS], p.sum(axis=0).T)
    return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)


FIELDS = [("lang_pred", StringType()), ("score", DoubleType())]


def _predictor(net: Network | None):
    def many(texts: list) -> tuple:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        lettered = [i for i, text in enumerate(texts) if any(map(str.isalpha, text))]
        if net is not None and lettered:
            p = document_probabilities(net, [texts[i] for i in lettered])
            for i, row in zip(lettered, p, strict=True):
                best = int(row.argmax())
                names[i], scores[i] = net.langs[best], float(min(1.0, row[best]))
        return names, scores

    return many


def predict(df: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score``: most probable language of every whole text and its mean probability."""
    return map_texts(df, key, text, FIELDS, lambda: _predictor(net))


def keep_known(df: DataFrame, net: Network | None, text: str = "text", min_score: float = 0.35) -> DataFrame:
    """Rows of ``df`` whose text has a language that the network is not in doubt about."""
    name, score = fresh_name(df, "_lang_pred"), fresh_name(df, "_lang_score")
    found = append_values(df, text, [(name, StringType()), (score, DoubleType())], lambda: _predictor(net))
    return found.filter((F.col(name) != UNKNOWN) & (F.col(score) >= min_score)).drop(name, score)
