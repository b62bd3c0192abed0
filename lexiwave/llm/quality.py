"""Quality rules with a linear-chain conditional random field over a text's lines.

Each line has binary features read off its bytes. The field labels every line content or boilerplate,
with weights for features and for pairs of neighbouring labels, and is fitted in numpy by gradient ascent
on the likelihood (forward-backward) of a bounded sample of documents with a quality label, whose lines get
labels of their own from it (``line_labels``). The Viterbi path over all lines of a text decides: the share
of words in content lines must reach ``LEAST_CONTENT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.shipping import ship
from lexiwave.llm.bytewords import RunHash, Words, chunks, range_keys, text_buffers
from lexiwave.llm.sampling import smallest_hashes

LEAST_WORDS, MOST_REPEATED = 50, 50
LEAST_CONTENT = 0.5
#: bounds of the sample: documents of each quality, neighbouring lines of a document
SAMPLE_DOCS, SAMPLE_LINES = 400, 200

_SYMBOLS = b"#*$%&|<>"


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL = _table(_SYMBOLS)
_UPPER, _LOWER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(bytes(range(48, 58)))
_STOP, _SHOUT, _MARK = _table(b".;:?"), _table(b"!"), _table(_SYMBOLS + b"=_~^\\{}[]@+")

#: upper edges of the bins of each measure of a line; a value falls in the first bin it is below
BINS = {
    "words": (1, 3, 6, 12, 25, 60),
    "word_bytes": (2, 3, 4.5, 6, 8, 12),
    "upper": (0.01, 0.06, 0.15, 0.4, 0.7),
    "digit": (0.001, 0.02, 0.1, 0.3),
    "mark": (0.001, 0.01, 0.03, 0.08, 0.2),
    "shout": (0.001, 0.02, 0.1),
    "echo": (0.001, 0.1, 0.3, 0.6),
    "repeated": (0.001, 0.2, 0.5, 0.9),
    "copy": (0.5,),
}
_FIRST = np.cumsum([0] + [len(v) + 1 for v in BINS.values()])
FEATURES = int(_FIRST[-1])


class Lines:
    """Counts and line features of a column of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words, texts = Words(data, offsets), len(offsets) - 1
        self.texts, keys = texts, words.keys()
        in_word = np.zeros(len(data) + 1, np.int64)
        whole = (data & 0xC0) != 0x80
        inside = np.zeros(len(data), np.int8)
        if len(words.start):
            inside[words.start] = 1
            closing = words.end[words.end < len(data)]
            np.subtract.at(inside, closing, 1)
            inside = np.cumsum(inside, dtype=np.int8)
        np.cumsum(whole & (inside > 0), out=in_word[1:])
        self.n_words = words.count
        self.word_chars = in_word[offsets[1:]] - in_word[offsets[:-1]]
        self.n_symbols = self._sums(_SYMBOL[data], offsets)
        # windows of three words found twice in their text
        hashes, starts = RunHash(keys), np.flatnonzero(words.doc[: max(len(keys) - 2, 0)] == words.doc[2:])
        repeated = self._twice(words.doc[starts], hashes(starts, starts + 3))
        depth = np.zeros(len(keys) + 1, np.int64)
        for i in range(3):
            depth[starts[repeated] + i] += 1
        in_repeat = depth[:-1] > 0
        self.n_repeat_words = np.bincount(words.doc[in_repeat], minlength=texts)
        # lines
        breaks = np.flatnonzero(data == 10)
        owner = np.searchsorted(offsets, breaks, side="right") - 1
        per_text = np.bincount(owner, minlength=texts) + 1
        self.first = np.concatenate([[0], np.cumsum(per_text)])
        begin = np.empty(self.first[-1], np.int64)
        begin[self.first[:-1]] = offsets[:-1]
        rest = np.ones(len(begin), bool)
        rest[self.first[:-1]] = False
        begin[rest] = breaks + 1
        end = np.empty_like(begin)
        end[self.first[1:] - 1] = offsets[1:]
        end[:-1][rest[1:]] = breaks
        text = np.repeat(np.arange(texts), per_text)
        first_word = np.searchsorted(words.start, begin)
        last_word = np.searchsorted(words.start, end)
        self.line_words = last_word - first_word
        worded = np.flatnonzero(self.line_words > 0)
        copy = self._later(text[worded], range_keys(data, begin[worded], end[worded]))
        is_copy = np.zeros(len(begin), bool)
        is_copy[worded[copy]] = True
        self.n_dup_lines = np.bincount(text[is_copy], minlength=texts)
        # measures, as shares of the line's bytes or words
        size = np.maximum(end - begin, 1)
        share = lambda table: (lambda s: (s[end] - s[begin]) / size)(np.concatenate([[0], np.cumsum(table[data])]))
        number = np.maximum(self.line_words, 1)
        echo = np.zeros(len(keys) + 1, np.int64)
        np.cumsum(np.append(False, (keys[1:] == keys[:-1]) & (words.doc[1:] == words.doc[:-1])) if len(keys) else [], out=echo[1:])
        seen = np.concatenate([[0], np.cumsum(in_repeat)])
        upper, lower = share(_UPPER), share(_LOWER)
        measures = {
            "words": self.line_words, "word_bytes": size / number, "upper": upper / np.maximum(upper + lower, 1e-9), "digit": share(_DIGIT),
            "mark": share(_MARK), "shout": share(_SHOUT), "echo": (echo[last_word] - echo[first_word]) / number,
            "repeated": (seen[last_word] - seen[first_word]) / number, "copy": is_copy,
        }
        self.features = np.stack([f + np.searchsorted(BINS[k], measures[k], side="right") for k, f in zip(BINS, _FIRST)], axis=1)

    @staticmethod
    def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    @staticmethod
    def _order(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((keys, owner))
        same = np.zeros(len(order), bool)
        same[1:] = (keys[order[1:]] == keys[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        return order, same

    @classmethod
    def _twice(cls, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether a key occurs twice or more with its owner."""
        order, same = cls._order(owner, keys)
        out = np.zeros(len(order), bool)
        out[order] = same | np.append(same[1:], False)
        return out

    @classmethod
    def _later(cls, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether an earlier place has the same key and owner."""
        order, same = cls._order(owner, keys)
        out = np.zeros(len(order), bool)
        out[order] = same
        return out


@dataclass
class LineField:
    """Weights: ``line`` [FEATURES, 2] by label (0 boilerplate, 1 content), ``pair`` [2, 2] from label to label."""

    line: np.ndarray
    pair: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.line[features].sum(axis=1)

    def labels(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The Viterbi path of every text; ties go to content."""
        gain = (scores[:, 1] - scores[:, 0]).tolist()
        (p00, p01), (p10, p11) = self.pair.tolist()
        out = np.ones(len(gain), np.int8)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            # the best path's advantage of ending in content, and where each label came from
            lead, came = gain[a], []
            for i in range(a + 1, b):
                to1, to0 = lead + p11 >= p01, lead + p10 >= p00
                came.append((to0, to1))
                lead = gain[i] + (lead + p11 if to1 else p01) - (lead + p10 if to0 else p00)
            now = lead >= 0
            if now and all(t1 for _, t1 in came):
                continue
            for i in range(b - 1, a - 1, -1):
                out[i] = now
                if i > a:
                    now = came[i - a - 1][now]
        return out

    @staticmethod
    def expected(score: np.ndarray, live: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log of the sum over all labellings, label probabilities, pair probabilities) of [T, N, 2] scores.

        Sequences are columns and live from the first step on; pair probabilities [T - 1, N, 2, 2] are of
        each step with the next. By the forward-backward recursions.
        """
        length, texts = live.shape
        forward, backward = np.zeros((length, texts, 2)), np.zeros((length, texts, 2))
        forward[0] = score[0]
        for t in range(1, length):
            new = np.logaddexp(forward[t - 1][:, :1] + pair[0], forward[t - 1][:, 1:] + pair[1]) + score[t]
            forward[t] = np.where(live[t][:, None], new, forward[t - 1])
        total = np.logaddexp(forward[-1][:, 0], forward[-1][:, 1])
        for t in range(length - 2, -1, -1):
            ahead = backward[t + 1] + score[t + 1]
            new = np.logaddexp(ahead[:, :1] + pair[:, 0], ahead[:, 1:] + pair[:, 1])
            backward[t] = np.where(live[t + 1][:, None], new, backward[t + 1])
        one = np.exp(forward + backward - total[None, :, None]) * live[:, :, None]
        two = np.exp(forward[:-1, :, :, None] + pair + (score[1:] + backward[1:])[:, :, None, :] - total[None, :, None, None]) * live[1:, :, None, None]
        return total, one, two

    @classmethod
    def fit(
        cls, features: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, pairs: bool = True,
        steps: int = 150, rate: float = 0.1, ridge: float = 3e-4, pair_ridge: float = 0.01,
    ) -> "LineField":
        """Maximum likelihood of the lines' labels; ``weight`` by text. Without ``pairs`` lines are independent."""
        counts = np.diff(first)
        texts, length = len(counts), int(counts.max(initial=1))
        at = np.arange(length)
        live = at[:, None] < counts[None, :]
        index = np.where(live, first[:-1][None, :] + at[:, None], 0)
        field = cls(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (field.line, field.pair)]
        per_text = (np.full(texts, 1 / texts) if weight is None else weight / weight.sum()) / np.maximum(counts, 1)
        lines, own = features[index[live]], label[index]
        truth = (own[:, :, None] == np.array([0, 1])) & live[:, :, None]
        moved = truth[:-1, :, :, None] & truth[1:, :, None, :]
        for step in range(1, steps + 1):
            _, one, two = cls.expected(field.scores(features)[index] * live[:, :, None], live, field.pair)
            rows = ((truth - one) * per_text[None, :, None])[live]
            d_line = np.zeros_like(field.line)
            for k in range(lines.shape[1]):
                for y in (0, 1):
                    d_line[:, y] += np.bincount(lines[:, k], rows[:, y], FEATURES)
            d_pair = ((moved - two) * per_text[None, :, None, None]).sum((0, 1)) * pairs
            for w, g, (m, v), r in ((field.line, d_line, moments[0], ridge), (field.pair, d_pair, moments[1], pair_ridge)):
                g = g - r * w
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return field


#: in a good document a line counts as boilerplate only if it looks as little like content as this
CLEAR = 0.1


def line_labels(features: np.ndarray, first: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """1 for content and 0 for boilerplate, by line, from the qualities of whole texts.

    Lines by themselves are told apart first, with their text's quality as label. A line of a bad text that
    looks like those of good ones is content, and a line of a good text that clearly does not is boilerplate,
    so labels differ within texts. A bad text keeps at least its least content-like line as boilerplate.
    """
    owner = np.repeat(np.arange(len(quality)), np.diff(first))
    own = quality[owner]
    share = np.bincount(own, minlength=2)
    alone = LineField.fit(features, np.arange(len(own) + 1), own, 1 / np.maximum(share[own], 1), pairs=False)
    score = alone.scores(features)
    looks = 1 / (1 + np.exp(score[:, 0] - score[:, 1]))
    label = np.where(own == 1, looks >= CLEAR, looks >= 0.5).astype(np.int64)
    for t in np.flatnonzero(quality == 0).tolist():
        a, b = first[t], first[t + 1]
        if b > a:
            label[a + int(looks[a:b].argmin())] = 0
    return label


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> LineField | None:
    """Fit on the ``sample`` labelled documents of each quality with the smallest hashed ids, or None.

    Executors send features of lines, not texts. Of a document of more than ``lines`` lines, a run of that
    many at a place hashed from its text is learned from. Nothing is learned unless documents of both
    qualities are found.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = None
    for q in (0, 1):
        some = smallest_hashes(marked.where(F.col("quality") == q), "doc_id", sample)
        ids = some if ids is None else ids.unionByName(some)
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = text_buffers(part.column(2))
                found, out = Lines(data, offsets), []
                for i in range(part.num_rows):
                    a, b = found.first[i], found.first[i + 1]
                    if b - a > lines:
                        a += int(range_keys(data, offsets[i : i + 1], offsets[i + 1 : i + 2])[0] % np.uint64(b - a - lines + 1))
                    out.append(found.features[a : min(b, a + lines)].astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], names=["doc_id", "quality", "features"])

    # at most 2 * sample ids go to every executor
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))), "doc_id").where(F.col("text").isNotNull())
        .select("doc_id", "quality", "text").mapInArrow(work, "doc_id long, quality int, features binary")
        .groupBy("doc_id", "quality").agg(F.min("features").alias("features")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    )
    quality = np.array([r.quality for r in rows], np.int64)
    if len(set(quality.tolist())) < 2:
        return None
    each = [np.frombuffer(r.features, "<i2").reshape(-1, len(BINS)).astype(np.int64) for r in rows]
    features, first = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
    share = np.bincount(quality, minlength=2)
    return LineField.fit(features, first, line_labels(features, first, quality), 1 / share[quality])


def judge(docs: DataFrame, field: LineField | None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_CONTENT) -> DataFrame:
    """One row per input row: id, counts, base_failed, kept and content_share.

    Words are runs of characters other than space and U+0009 to U+000D. Null and empty texts have no words
    and fail. Without a field every text is content. Rows are independent, so repeated rows need no care; ties
    between labels go to content. A very long text is labelled whole, as one sequence of lines. An empty table gives an empty result and other columns are ignored.
    """
    ship(docs.sparkSession)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("id", pa.int64())] + [(c, pa.int64()) for c in names] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                lines = Lines(*text_buffers(part.column(1)))
                n, repeat = lines.n_words, lines.n_repeat_words
                failed = (n < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * n)
                content = np.ones(len(lines.features), bool) if field is None else field.labels(field.scores(lines.features), lines.first) == 1
                owner = np.repeat(np.arange(lines.texts), np.diff(lines.first))
                share = np.bincount(owner, lines.line_words * content, lines.texts) / np.maximum(n, 1)
                columns = [part.column(0), *(pa.array(getattr(lines, c).astype(np.int64)) for c in names)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(~failed & (share >= least)), pa.array(share)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "id long, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean, content_share double")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, field).withColumnRenamed("id", "doc_id")
