"""Language ID with a bidirectional gated recurrent network over bytes.

The network reads windows of a text's bytes in both directions and labels every byte; a document's
probabilities are the mean over its letters' bytes. It is trained in numpy by backpropagation through
time, on the driver, from a bounded sample of labelled rows. Prediction runs whole texts through it:
the windows of a chunk of texts are the rows of a matrix, so one step of the recurrence is a few array
operations for thousands of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.shipping import ship
from lexiwave.llm.bytewords import chunks, text_buffers
from lexiwave.llm.sampling import smallest_hashes_by

HIDDEN = 8
#: bytes read at once, of which the outer ``MARGIN`` on either side, where there is text, only warm up the state
WINDOW, MARGIN = 256, 16
UNDETERMINED = "und"

#: bounds of what is learned from: rows of all languages together, windows of a row, characters of a window
SAMPLE_ROWS, SAMPLE_WINDOWS, SAMPLE_CHARS = 2000, 6, 60

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Per direction: ``inputs`` [257, 3H] by byte (256: none), ``state`` [H, 3H], ``bias`` [H]; ``out`` [2H, L]."""

    languages: list[str]
    params: dict[str, np.ndarray]

    @classmethod
    def new(cls, languages: list[str], hidden: int, seed: int) -> "Network":
        rng, params = np.random.default_rng(seed), {}
        for d in "fb":
            params[f"inputs_{d}"] = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
            params[f"state_{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            params[f"bias_{d}"] = np.zeros(hidden, np.float32)
        params["out"] = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        params["out_bias"] = np.zeros(len(languages), np.float32)
        return cls(languages, params)

    def _run(self, codes: np.ndarray, d: str) -> dict[str, np.ndarray]:
        """One direction over [T, B] bytes; everything the backward pass needs."""
        p, (steps, lanes) = self.params, codes.shape
        inputs, state, bias = p[f"inputs_{d}"], p[f"state_{d}"], p[f"bias_{d}"]
        n = len(bias)
        keep = {k: np.empty((steps, lanes, n), np.float32) for k in ("before", "z", "r", "cand", "lin")}
        live = (codes < 256).astype(np.float32)[:, :, None]
        h = np.zeros((lanes, n), np.float32)
        hidden = np.empty((steps, lanes, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, u = inputs[codes[t]], h @ state
            gates = _sigmoid(x[:, : 2 * n] + u[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            lin = u[:, 2 * n :] + bias
            cand = np.tanh(x[:, 2 * n :] + r * lin)
            for k, v in (("before", h), ("z", z), ("r", r), ("cand", cand), ("lin", lin)):
                keep[k][t] = v
            h = (cand + z * (h - cand)) * live[t]
            hidden[t] = h
        return keep | {"hidden": hidden, "live": live}

    def _back(self, codes: np.ndarray, d: str, run: dict[str, np.ndarray], dhidden: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Backpropagation through time of one direction, added to ``grads``."""
        state = self.params[f"state_{d}"]
        steps, lanes, n = run["hidden"].shape
        dh = np.zeros((lanes, n), np.float32)
        dx = np.empty((steps, lanes, 3 * n), np.float32)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            dh = (dh + dhidden[t]) * run["live"][t]
            before, z, r, cand, lin = (run[k][t] for k in ("before", "z", "r", "cand", "lin"))
            dcand = dh * (1 - z) * (1 - cand * cand)
            dz = dh * (before - cand) * z * (1 - z)
            dr = dcand * lin * r * (1 - r)
            dlin = dcand * r
            du = np.concatenate([dz, dr, dlin], axis=1)
            grads[f"state_{d}"] += before.T @ du
            grads[f"bias_{d}"] += dlin.sum(0)
            dx[t] = np.concatenate([dz, dr, dcand], axis=1)
            dh = dh * z + du @ state.T
        flat = codes.ravel()
        order = np.argsort(flat, kind="stable")
        values, first = np.unique(flat[order], return_index=True)
        grads[f"inputs_{d}"][values] += np.add.reduceat(dx.reshape(-1, 3 * n)[order], first, axis=0)

    def loss(self, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean cross-entropy of all letter positions of [T, B] codes, and its gradients."""
        p = self.params
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        runs = {d: self._run(codes, d) for d in "fb"}
        hidden = np.concatenate([runs["f"]["hidden"], runs["b"]["hidden"]], axis=2)
        logits = hidden @ p["out"] + p["out_bias"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        counted = np.append(_LETTER, False)[codes] * weight[None, :]
        total = max(float(counted.sum()), 1e-9)
        lane = np.arange(codes.shape[1])
        loss = float(-(np.log(prob[:, lane, target] + 1e-12) * counted).sum() / total)
        dlogits = prob
        dlogits[:, lane, target] -= 1
        dlogits *= (counted / total)[:, :, None].astype(np.float32)
        flat = dlogits.reshape(-1, dlogits.shape[2])
        grads["out"] += hidden.reshape(len(flat), -1).T @ flat
        grads["out_bias"] += flat.sum(0)
        dhidden = dlogits @ p["out"].T
        n = dhidden.shape[2] // 2
        self._back(codes, "f", runs["f"], dhidden[:, :, :n], grads)
        self._back(codes, "b", runs["b"], dhidden[:, :, n:], grads)
        return loss, grads

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """[T, L, B] label scores of [T, B] bytes; code 256 stands for no byte."""
        p = self.params
        steps, lanes = codes.shape
        out = np.empty((steps, len(p["out_bias"]), lanes), np.float32)
        out[:] = p["out_bias"][None, :, None]
        padded = codes.max(initial=0) == 256
        for d in "fb":
            state, inputs, bias = p[f"state_{d}"], p[f"inputs_{d}"], p[f"bias_{d}"]
            n = len(bias)
            # the gates' halves are folded into the weights: sigmoid(x) = (1 + tanh(x / 2)) / 2; and with
            # twice the gate, g = 1 + tanh, the candidate's part is (state / 2 + bias / 2) * g
            state_g, inputs_g = np.ascontiguousarray(state[:, : 2 * n]) / 2, np.ascontiguousarray(inputs[:, : 2 * n]) / 2
            state_c, inputs_c = np.ascontiguousarray(state[:, 2 * n :]) / 2, np.ascontiguousarray(inputs[:, 2 * n :])
            half, bias = p["out"][:n] if d == "f" else p["out"][n:], bias / 2
            label = np.ascontiguousarray(half.T)
            h = np.zeros((lanes, n), np.float32)
            g, xg = np.empty((lanes, 2 * n), np.float32), np.empty((lanes, 2 * n), np.float32)
            c, xc, scores = np.empty_like(h), np.empty_like(h), np.empty((out.shape[1], lanes), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.take(inputs_g, codes[t], axis=0, out=xg, mode="clip")
                np.take(inputs_c, codes[t], axis=0, out=xc, mode="clip")
                np.matmul(h, state_g, out=g)
                np.matmul(h, state_c, out=c)
                g += xg
                np.tanh(g, out=g)
                g += 1
                c += bias
                c *= g[:, n:]
                c += xc
                np.tanh(c, out=c)
                # h = c + z * (h - c), with z = g / 2
                h -= c
                h *= g[:, :n]
                h *= 0.5
                h += c
                if padded:
                    h *= (codes[t] < 256)[:, None]
                np.matmul(label, h.T, out=scores)
                out[t] += scores
        return out


def train(windows: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = 160, lanes: int = 192, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit a network by Adam on random batches of the windows; languages weigh the same however rare."""
    languages = sorted(set(labels))
    net = Network.new(languages, hidden, seed)
    if len(languages) < 2:
        return net
    size = max(map(len, windows))
    codes = np.full((len(windows), size), 256, np.int64)
    for i, w in enumerate(windows):
        codes[i, : len(w)] = np.frombuffer(w, np.uint8)
    target = np.searchsorted(languages, labels)
    share = np.bincount(target, minlength=len(languages)) / len(target)
    weight = (1 / share[target]).astype(np.float32)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.params.items()}
    second = {k: np.zeros_like(v) for k, v in net.params.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), lanes)
        _, grads = net.loss(codes[pick].T, target[pick], weight[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.params[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label_texts(net: Network, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, margin: int = MARGIN, lanes: int = 2048) -> np.ndarray:
    """[texts, L] mean probabilities over the bytes of letters; zeros for a text without any.

    Windows overlap by two margins, whose labels count in the neighbour that has them inside.
    """
    sizes, core = np.diff(offsets), window - 2 * margin
    if core < 1:
        raise ValueError("a window is longer than its two margins")
    per_text = np.where(sizes <= window, (sizes > 0).astype(np.int64), -(-sizes // core))
    owner = np.repeat(np.arange(len(sizes)), per_text)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    whole = sizes[owner] <= window
    inner = np.where(whole, 0, number * core)  # within the text, of the labels that count
    outer = np.where(whole, sizes[owner], np.minimum(inner + core, sizes[owner]))
    begin = np.maximum(inner - margin, 0)
    length = np.minimum(outer + margin, sizes[owner]) - begin
    begin, inner, outer = begin + offsets[owner], inner - begin, outer - begin
    sums, letters = np.zeros((len(sizes), len(net.languages))), np.zeros(len(sizes))
    order = np.argsort(-length, kind="stable")  # full windows first: they need no masks
    padded = np.concatenate([data, np.zeros(window, np.uint8)])
    for a in range(0, len(order), lanes):
        own = order[a : a + lanes]
        steps = int(length[own[0]])
        at = np.arange(steps)[:, None]
        codes = padded[begin[own][None, :] + at].astype(np.int32)
        counted = _LETTER[codes] & (at >= inner[own][None, :]) & (at < outer[own][None, :])
        codes[at >= length[own][None, :]] = 256
        logits = net.logits(codes)
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits, out=logits)
        prob *= (counted / prob.sum(axis=1))[:, None, :]
        lane_sums = prob.sum(axis=0, dtype=np.float64)
        for k in range(len(lane_sums)):
            sums[:, k] += np.bincount(owner[own], lane_sums[k], len(sizes))
        letters += np.bincount(owner[own], counted.sum(axis=0), len(sizes))
    return sums / np.maximum(letters, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept for testing: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Network:
    """Train on ``rows`` labelled rows not held out, an equal share a language: those whose hashed ids and texts are the smallest.

    Of each, ``SAMPLE_WINDOWS`` windows of ``SAMPLE_CHARS`` characters at hashed places are read. Rows equal
    in id and text count once; rows with a null id differ by their texts.
    """
    t = F.col(text_col)
    key = F.xxhash64(F.col(id_col), t)
    start = lambda i: F.pmod(F.xxhash64(key, i), F.greatest(F.char_length(t) - SAMPLE_CHARS, F.lit(1)).cast("long")).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(1), F.lit(SAMPLE_WINDOWS)), lambda i: F.substring(t, start(i), SAMPLE_CHARS))
    known = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.char_length(t) > 0))
    short = known.select(key.alias("key"), F.col(lang_col).cast("string").alias("lang"), cut.alias("windows"))
    sample = smallest_hashes_by(short, "lang", "key", rows).select("lang", "windows").collect()
    pairs = [(w.encode(), r.lang) for r in sample for w in r.windows if w]
    return train([w for w, _ in pairs], [x for _, x in pairs]) if pairs else Network.new([], HIDDEN, 0)


def _has_letter(text: bytes, ascii_letter: bool) -> bool:
    return ascii_letter or any(map(str.isalpha, text.decode("utf-8", "ignore")))


def predict(docs: DataFrame, net: Network, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with lang_pred and score.

    Null texts, empty ones and ones without a letter are ``und`` with score 0, and so is everything for a
    network that learned no language. Rows are independent; repeated rows get equal results, ties go to
    the language first in code point order, and an empty table gives an empty result. A very long text is read
    whole, in windows.
    """
    return _labelled(docs.select(F.struct(*keep).alias("row"), F.col(text_col).cast("string").alias("text")), net).select("row.*", "lang_pred", "score")


def _labelled(rows: DataFrame, net: Network) -> DataFrame:
    """(row, lang_pred, score) of (row, text)."""
    schema = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = text_buffers(part.column(1))
                plain = _LETTER[data] & (data < 128)
                seen = np.concatenate([[0], np.cumsum(plain)])
                has_plain = seen[offsets[1:]] > seen[offsets[:-1]]
                prob = label_texts(net, data, offsets) if net.languages else np.zeros((part.num_rows, 1))
                best = prob.argmax(axis=1)
                names, scores = [], []
                for i in range(part.num_rows):
                    known = net.languages and offsets[i + 1] > offsets[i] and _has_letter(data[offsets[i] : offsets[i + 1]].tobytes() if not has_plain[i] else b"", bool(has_plain[i]))
                    names.append(net.languages[best[i]] if known else UNDETERMINED)
                    scores.append(min(1.0, float(prob[i, best[i]])) if known else 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    ship(rows.sparkSession)
    return rows.mapInArrow(work, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = learn(docs)
    out = predict(docs, net, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: a document whose most probable language has no more than this is in no one language
LEAST_SCORE = 0.5


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; undetermined ones and mixtures go.

    Columns stay as they were, whatever their names. Null and empty texts and texts without a letter are
    undetermined; rows are judged one by one, so null ids and repeated rows need no care; very long texts are
    read whole, and of equal probabilities the language first in code point order counts; a table without
    labelled texts, and so an empty one, has no language and leaves nothing.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    good = _labelled(rows, learn(docs)).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") > LEAST_SCORE))
    return good.select(*[F.col("row")[c].alias(c) for c in docs.columns])
