"""Operator 7: language identification by error-correcting output codes.

Each language has a codeword; one binary classifier per bit predicts it from
hashed letter n-grams (1 to 3 letters).  Decoding weighs each bit's logistic
loss by how well its classifier did on the training rows, and takes the
codeword of least weighted loss.  ``score`` is its share of exp(-loss) over all
codewords; ``ambiguous`` is set where the runner-up is close.

The classifiers learn from at most ``SAMPLE`` labelled rows a language, those of
smallest hashed (doc_id, text); the rows' feature vectors are made on the executors
and only these fixed-size vectors reach the driver.  Everything learned is a
matrix of ``DIM`` x bits numbers, whatever the data.  Learned rows and predictions
read whole texts; predictions read nothing else.

Cases: null texts and texts without a letter are ``und`` with score 0.  Rows
with a null language are never learned from.  With one language everything is
that language (score 1); with none, ``und``.  Repeated rows are predicted alike.  A
null doc_id is held out by the hash of ''.  Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import cut

DIM = 1 << 12
SAMPLE = 600
CHUNK = 1 << 18                      # code points worked on at once
CLOSE = 0.2
UND = "und"
_MAX = 0x110000
_kind: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 where it is none."""
    if "lower" not in _kind:
        out = np.zeros(_MAX, np.uint32)
        for c in range(_MAX):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _kind["lower"] = out
    return _kind["lower"]


def counts(text: str) -> np.ndarray | None:
    """Counts of the text's letter n-grams in DIM buckets; None without a letter."""
    if not text:
        return None
    total, any_letter, last = np.zeros(DIM), False, np.zeros(2, np.uint64)
    table = letters()
    for i in range(0, len(text), CHUNK):
        code = np.frombuffer(text[i:i + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        x = table[code].astype(np.uint64)
        any_letter = any_letter or bool(x.any())
        x = np.concatenate([last, x])
        here = x[2:] != 0
        one, two = x[2:], x[1:-1] * np.uint64(_MAX) + x[2:]
        three = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + two
        for salt, h in ((1, one), (2, two), (3, three)):
            h = (h[here] + np.uint64(salt << 56)) * np.uint64(0xD6E8FEB86659FD93)
            total += np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=DIM)
        last = x[-2:]
    return total if any_letter else None


def features(total: np.ndarray) -> np.ndarray:
    """Square roots of the shares: long texts count like short ones."""
    v = np.sqrt(total)
    return v / np.sqrt(v @ v)


def code_words(n: int) -> np.ndarray:
    """n codewords of -1 and 1.  Few languages get the exhaustive code, in which any
    two codewords differ in half the bits; more get the best of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = [[1] + [1 if (c >> i) & 1 else -1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(bits, float).T
    rng, best, most = np.random.default_rng(7), None, -1
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], (n, int(12 * np.ceil(np.log2(n)))))
        apart = (m @ m.T)[np.triu_indices(n, 1)].max()
        varied = np.abs(m.sum(axis=0)).max() < n
        if varied and (best is None or apart < most):
            best, most = m, apart
    return best


def train(x: np.ndarray, label: np.ndarray, code: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights DIM x bits, bias, importance): logistic regressions for all bits at once,
    each row weighted so that languages count alike."""
    y = code[label].astype(np.float32)
    share = 1.0 / np.bincount(label, minlength=len(code))[label]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):                        # gradient steps with momentum
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * share
        vw, vb = 0.9 * vw - 8.0 * (x.T @ g + 1e-5 * w), 0.9 * vb - 2.0 * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = (np.sign(x @ w + b) == y) * share
    return w, b, np.maximum(right.sum(axis=0) - 0.5, 1e-3) * 2


def decode(margin: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Probability of each codeword: weighted logistic losses of the bits, softmax of their negative."""
    loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * code[None, :, :], -30, 30))) @ weight
    p = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return p / p.sum(axis=1, keepdims=True)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learning_rows(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, total): the n-gram counts of each language's first rows by hash; of rows
    that share a hash (repeated rows), one."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(~held_out())
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    first = Window.partitionBy("lang").orderBy("h")
    key = rows.select("lang", "h").distinct()
    chosen = cut(key.withColumn("i", F.row_number().over(first)).where(f"i <= {sample}").select("lang", "h"), "learning")

    def run(batches):
        for b in batches:
            got = [counts(t.as_py()) for t in b.column(1)]
            keep = [k for k, g in enumerate(got) if g is not None]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array([got[k].astype(np.float32).tobytes() for k in keep], pa.binary())],
                ["lang", "total"])
        W.release()

    # as many hashes as languages times the sample: small whatever the data
    some = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    return some.select("lang", "text").mapInArrow(run, "lang string, total binary")


def fit(docs: DataFrame, sample: int = SAMPLE):
    """(languages, codewords, weights, bias, importance)."""
    rows = learning_rows(docs, sample).collect()           # at most `sample` vectors of DIM numbers a language
    rows.sort(key=lambda r: (r["lang"], bytes(r["total"])))
    names = sorted({r["lang"] for r in rows})
    code = code_words(len(names))
    if len(names) < 2:
        return names, code, np.zeros((DIM, 1), np.float32), np.zeros(1), np.ones(1)
    x = np.empty((len(rows), DIM), np.float32)
    for i, r in enumerate(rows):
        x[i] = features(np.frombuffer(r["total"], np.float32))
    at = {n: i for i, n in enumerate(names)}
    w, b, weight = train(x, np.array([at[r["lang"]] for r in rows]), code)
    return names, code, w.astype(np.float32), b, weight


def predict(docs: DataFrame, model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names, code, w, b, weight = shared.value
        for batch in batches:
            texts = batch.column(2)
            margin, known = np.zeros((len(texts), w.shape[1])), np.zeros(len(texts), bool)
            for i, t in enumerate(texts):
                c = counts(t.as_py()) if names else None
                if c is not None:
                    known[i] = True
                    margin[i] = features(c) @ w + b
            lang, score, close = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if names and len(texts):
                p = decode(margin, code, weight)
                best = p.argmax(axis=1)
                top = np.sort(p, axis=1)
                lang = [names[k] if ok else UND for k, ok in zip(best.tolist(), known.tolist())]
                score = np.where(known, top[:, -1], 0.0)
                close = known & (top[:, -1] - (top[:, -2] if len(names) > 1 else 0) < CLOSE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score),
                                              pa.array(close)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])
        W.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return predict(docs, fit(docs, sample))
