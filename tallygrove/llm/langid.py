"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's bytes, one in each direction; every
byte position gets a distribution over languages from both states.  A
document's probabilities are the mean over all its positions.  Nothing resets a
state inside a text: words, white space and letters of several bytes are read
through.  So that long texts are read by many lanes at once, a text is cut into
chunks of ``CHUNK`` bytes; the states at a chunk's ends come from reading the
``CONTEXT`` bytes beyond them first, which is what the whole text's states are
but for what a gated unit remembers from further away (tests bound the
difference).

The network is trained on the driver in numpy by backpropagation through time,
on windows drawn from a bounded sample of texts: ``sample_docs`` distinct ones of
each language, those with the smallest hashes, and ``sample_bytes`` in all
languages together.  A text longer than its even share of these (16 kB with four
languages) is represented by excerpts from its whole length, cut on the
executors.  Weights are some tens of kilobytes.

Defined results: a null text and a text without a letter are ``und`` with score
0; so is every text if there was nothing to learn from; rows without a label
aren't learned from; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_arrow, lower_ascii, pieces, settle, table

UNKNOWN = "und"
HIDDEN = 12
CHUNK = 256
CONTEXT = 32
SAMPLE_DOCS = 256
#: What reaches the driver of all samples, and the excerpts that stand for a text longer than its share of it.
SAMPLE_BYTES, PIECES = 1 << 24, 8
STEPS = 250
BATCH = 192
#: Bytes that a training window has.
TRAINED = 48
#: The code of a place outside the text: its gates keep the state as it is.
OUTSIDE = 256
#: Chunks that are read side by side.
LANES = 1024


class BiGru:
    """params: for each direction d in (0, 1) X (inputs of 256 bytes), U, c; and the label layer V, b.  Features come first, lanes last."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.params = {f"{name}{d}": draw(*shape) for d in (0, 1) for name, shape in (("X", (3 * hidden, 256)), ("U", (3 * hidden, hidden)), ("c", (hidden, 1)))}
        self.params |= {"V": draw(len(languages), 2 * hidden), "b": np.zeros((len(languages), 1), np.float32)}

    def _inputs(self, d: int) -> np.ndarray:
        """X and a column for places outside: an update gate of one."""
        h = self.hidden
        outside = np.zeros((3 * h, 1), self.params[f"X{d}"].dtype)
        outside[:h] = 1e4
        return np.concatenate([self.params[f"X{d}"], outside], axis=1)

    def _run(self, codes: np.ndarray, d: int, trace: list | None = None):
        """States after each place of codes (places, lanes), in reading order of the direction."""
        p, h, (places, lanes) = self.params, self.hidden, codes.shape
        x, u, c = self._inputs(d), p[f"U{d}"], p[f"c{d}"]
        state = np.zeros((h, lanes), x.dtype)
        for t in range(places) if d == 0 else range(places - 1, -1, -1):
            at = x.take(codes[t], axis=1)
            rec = u @ state
            gates = 0.5 + 0.5 * np.tanh(0.5 * (at[: 2 * h] + rec[: 2 * h]))
            inner = rec[2 * h :] + c
            new = np.tanh(at[2 * h :] + gates[h:] * inner)
            if trace is not None:
                trace.append((t, state, gates[:h], gates[h:], inner, new))
            state = new + gates[:h] * (state - new)
            yield t, state

    def _folded(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """X, and U with c as a last column, halved where a gate's sigmoid is written as a tanh of half its argument."""
        h = self.hidden
        x, u = self._inputs(d).copy(), np.concatenate([self.params[f"U{d}"], np.zeros((3 * h, 1), np.float32)], axis=1)
        u[2 * h :, h:] = self.params[f"c{d}"]
        x[: 2 * h] *= 0.5
        u *= 0.5
        return x, u

    def _read(self, codes: np.ndarray, d: int, out: np.ndarray, first: int, end: int) -> None:
        """Adds to ``out`` the layer's share of the logits of places first to end; the same steps as ``_run``, in place."""
        h, lanes = self.hidden, codes.shape[1]
        x, u = self._folded(d)
        label = np.ascontiguousarray(self.params["V"][:, d * h : (d + 1) * h])
        at, rec, state, share = (np.zeros((n, lanes), np.float32) for n in (3 * h, 3 * h, h + 1, len(label)))
        state[h] = 1
        gates, update, reset, new, inner, now = at[: 2 * h], at[:h], at[h : 2 * h], at[2 * h :], rec[2 * h :], state[:h]
        for t in range(end) if d == 0 else range(len(codes) - 1, first - 1, -1):
            np.take(x, codes[t], axis=1, out=at, mode="clip")
            np.matmul(u, state, out=rec)
            gates += rec[: 2 * h]
            np.tanh(gates, out=gates)
            gates += 1
            inner *= reset
            new += inner
            np.tanh(new, out=new)
            now -= new
            now *= update
            now *= 0.5
            now += new
            if first <= t < end:
                np.matmul(label, now, out=share)
                out[t - first] += share

    def probabilities(self, codes: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray:
        """(places, languages, lanes) of the places from first to end; those around them are read for the states."""
        end = len(codes) if end is None else end
        codes = codes.astype(np.intp)
        out = np.empty((end - first, len(self.languages), codes.shape[1]), np.float32)
        out[:] = self.params["b"]
        for d in (0, 1):
            self._read(codes, d, out, first, end)
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def gradients(self, codes: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Of the mean cross-entropy over the places inside: codes (places, lanes), a label for each lane."""
        p, h, (places, lanes) = self.params, self.hidden, codes.shape
        kind = p["V"].dtype
        both, traces = np.empty((places, 2 * h, lanes), kind), ([], [])
        for d in (0, 1):
            for t, state in self._run(codes, d, traces[d]):
                both[t, d * h : (d + 1) * h] = state
        out = p["V"] @ both + p["b"]
        out -= out.max(axis=1, keepdims=True)
        prob = np.exp(out)
        prob /= prob.sum(axis=1, keepdims=True)
        weight = (codes != OUTSIDE).astype(kind)
        weight /= weight.sum()
        lane = np.arange(lanes)
        loss = float(-(np.log(prob[:, label, lane] + 1e-9) * weight).sum())
        prob[:, label, lane] -= 1
        prob *= weight[:, None, :]
        grads = {"V": np.einsum("tkn,thn->kh", prob, both, optimize=True), "b": prob.sum(axis=(0, 2))[:, None]}
        back = p["V"].T @ prob
        order = np.argsort(codes.ravel(), kind="stable")
        starts = np.searchsorted(codes.ravel()[order], np.arange(256))
        ends = np.searchsorted(codes.ravel()[order], np.arange(256), "right")
        for d in (0, 1):
            u, carry = p[f"U{d}"], np.zeros((h, lanes), kind)
            at, into = np.empty((3 * h, places, lanes), kind), np.empty((places, 3 * h, lanes), kind)
            before = np.empty((places, h, lanes), kind)
            for t, state, update, reset, inner, new in reversed(traces[d]):
                carry += back[t, d * h : (d + 1) * h]
                keep = carry * update
                g_new = (carry - keep) * (1 - new * new)
                at[:h, t] = into[t, :h] = keep * (1 - update) * (state - new)
                at[h : 2 * h, t] = into[t, h : 2 * h] = g_new * inner * reset * (1 - reset)
                at[2 * h :, t] = g_new
                into[t, 2 * h :] = g_new * reset
                before[t] = state
                carry = keep + u.T @ into[t]
            sums = np.concatenate([np.zeros((3 * h, 1), np.float64), np.cumsum(at.reshape(3 * h, -1)[:, order], axis=1, dtype=np.float64)], axis=1)
            grads[f"X{d}"] = (sums[:, ends] - sums[:, starts]).astype(kind)
            grads[f"U{d}"] = np.einsum("tin,tjn->ij", into, before, optimize=True)
            grads[f"c{d}"] = into[:, 2 * h :].sum(axis=(0, 2))[:, None]
        return loss, grads

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text of a piece the sum of its places' probabilities."""
        k, rows = len(self.languages), len(offsets) - 1
        out = np.zeros((rows, k))
        sizes = np.diff(offsets)
        many = -(-sizes // CHUNK)
        row = np.repeat(np.arange(rows), many)
        start = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * CHUNK
        size = np.minimum(CHUNK, offsets[row + 1] - start)
        order = np.argsort(-size, kind="stable")
        lanes = max(32, min(LANES, (1 << 22) // (CHUNK * max(k, 1))))
        for at in range(0, len(order), lanes):
            chosen = order[at : at + lanes]
            codes = coded(data, start[chosen], int(size[chosen[0]]), offsets[row[chosen]], offsets[row[chosen] + 1])
            prob = self.probabilities(codes, CONTEXT, CONTEXT + int(size[chosen[0]]))
            prob *= (np.arange(len(prob))[:, None] < size[chosen])[:, None, :]
            np.add.at(out, row[chosen], prob.sum(axis=0).T)
        return out


def coded(data: np.ndarray, start: np.ndarray, size: int, low: np.ndarray, high: np.ndarray, context: int = CONTEXT) -> np.ndarray:
    """Codes (places, lanes) of ``size`` bytes from each start on and ``context`` before and after them; OUTSIDE beyond [low, high)."""
    at = start + np.arange(-context, size + context)[:, None]
    inside = (at >= low) & (at < high)
    return np.where(inside, data[np.clip(at, 0, max(len(data) - 1, 0))].astype(np.int16), np.int16(OUTSIDE))


def train(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> BiGru:
    """Adam over windows drawn evenly from all languages, and from each language's bytes; the gradient's norm is cut at 1."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[bytes]] = {}
    for text, language in samples:
        if text:
            by.setdefault(language, []).append(text)
    languages = sorted(by)
    model = BiGru(languages, hidden, seed)
    if len(languages) < 2:
        return model
    data = lower_ascii(np.frombuffer(b"".join(t for k in languages for t in by[k]), np.uint8))
    offsets = np.concatenate([[0], np.cumsum([len(t) for k in languages for t in by[k]])])
    bounds = np.concatenate([[0], np.cumsum([sum(map(len, by[k])) for k in languages])])
    m = {k: np.zeros_like(v) for k, v in model.params.items()}
    v = {k: np.zeros_like(x) for k, x in model.params.items()}
    for step in range(1, steps + 1):
        label = rng.integers(0, len(languages), batch)
        middle = bounds[label] + (rng.random(batch) * (bounds[label + 1] - bounds[label])).astype(np.int64)
        row = np.searchsorted(offsets, middle, "right") - 1
        codes = coded(data, middle - TRAINED // 2, TRAINED, offsets[row], offsets[row + 1], context=0)
        _, grads = model.gradients(codes, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g / max(1.0, norm)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.params[k] -= (rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def _excerpts(text: str, rank: str, room: Column) -> Column:
    """All bytes of a text that fits in ``room``; of a longer one up to PIECES excerpts that fill it, each at a place drawn by hash from its part of the text."""
    data, size = F.col(text).cast("binary"), F.octet_length(text)
    many = F.greatest(F.lit(1), F.least(F.lit(PIECES), F.floor(room / (4 * TRAINED)))).cast("int")
    length, stretch = F.floor(room / many).cast("int"), F.floor(size / many).cast("int")
    place = lambda i: i * stretch + F.pmod(F.xxhash64(rank, i), (stretch - length + 1).cast("long")).cast("int") + 1
    return F.when(size <= room, F.array(data)).otherwise(F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substring(data, place(i), length)))


def sample(docs: DataFrame, text_col: str = "text", label_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, str]]:
    """Texts and labels of ``sample_docs`` distinct texts of each language at most, ``sample_bytes`` in all.

    A text of more bytes than its even share of these gives excerpts from its
    whole length; they are cut where the text is.  So many languages that a
    share is shorter than a training window are refused.
    """
    from pyspark.sql import Window

    rows = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).filter("label is not null and text is not null").withColumn("rank", F.xxhash64("text"))
    best = rows.select("label", "rank").distinct()
    for part in ([F.pmod("rank", F.lit(16))], []):  # a language of a third of all rows is cut down in parts first
        line = Window.partitionBy("label", *part).orderBy("rank")
        best = best.withColumn("n", F.row_number().over(line)).filter(F.col("n") <= sample_docs).select("label", "rank")
    last = settle(best.groupBy("label").agg(F.max("rank").alias("last")), "language-ranks")  # one row for each language
    room = sample_bytes // max(1, last.count() * sample_docs)
    if room < TRAINED:
        raise ValueError(f"more languages than {sample_bytes} bytes of samples serve: {last.count()}")
    chosen = rows.join(F.broadcast(last), "label").filter(F.col("rank") <= F.col("last"))  # at most sample_bytes / sample_docs / TRAINED rows
    found = chosen.select("label", "rank", _excerpts("text", "rank", F.lit(room)).alias("parts")).groupBy("label", "rank").agg(F.min("parts").alias("parts"))
    return [(bytes(part), r.label) for r in found.orderBy("label", "rank").collect() for part in r.parts]  # sample_bytes at most


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", sample_docs: int = SAMPLE_DOCS, **options) -> BiGru:
    """Train on a bounded sample of the labelled rows of ``docs``."""
    return train(sample(docs, text_col, label_col, sample_docs), **options)


def _judged(rows: pa.RecordBatch, column: str, data: np.ndarray, offsets: np.ndarray, model: BiGru) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of a piece: whether it has a language, the best one, its mean probability."""
    letter = pc.fill_null(pc.match_substring_regex(rows.column(column), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not model.languages:
        return np.zeros(rows.num_rows, bool), np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows)
    mean = model.sums(lower_ascii(data), offsets) / np.maximum(np.diff(offsets), 1)[:, None]
    best = mean.argmax(axis=1)
    return letter, best, np.where(letter, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)


def _detect(batches, model: BiGru):
    names = np.array([*model.languages, UNKNOWN], object)
    for rows, data, offsets in pieces(batches, "text"):
        known, best, score = _judged(rows, "text", data, offsets, model)
        named = pa.array(names[np.where(known, best, len(model.languages))], pa.string())
        yield pa.RecordBatch.from_arrays([rows.column("rid"), rows.column("doc_id"), named, pa.array(score)], ["rid", "doc_id", "lang_pred", "score"])


def _kept(batches, model: BiGru, least: float, column: str):
    for rows, data, offsets in pieces(batches, column):
        known, _, score = _judged(rows, column, data, offsets, model)
        yield rows.filter(pa.array(known & (score >= least)))


def detect(docs: DataFrame, model: BiGru, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """rid (the input row of this call), doc_id, lang_pred, score."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(in_arrow, partial(_detect, model=model), f"rid long, doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: BiGru, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in a learned language of at least that score, in place."""
    placed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name twice, whatever the columns are called
    return placed.transform(in_arrow, partial(_kept, model=model, least=least, column=f"c{docs.columns.index(text_col)}"), placed.schema).toDF(*docs.columns)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return detect(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
