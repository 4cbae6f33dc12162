"""Language identification (operator 3): averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes one space, and its byte
3-grams and 4-grams (word edges included) are hashed to ``BUCKETS`` embeddings. Their
mean over the whole text goes through a linear softmax. Embeddings and softmax are trained
together by stochastic gradient descent in numpy on a bounded sample of labelled
rows (``SAMPLE`` rows, dealt evenly over the languages); a fifth of it is held
back to calibrate a temperature and the rejection threshold: smaller models, each fitted without one language, are tried on that
language, and the threshold is the least one that refuses what they and the model itself get wrong, as far as right answers stay.
Because the model is
linear in the mean, embeddings and softmax fold into one table, and a text
costs two look-ups a byte.

Prediction covers whole texts and sees nothing but the text.

Defined cases: null text and text without letters give ``und`` with score 0 and are
rejected; of equal scores the first language in order wins; repeated rows are
predicted alike; without any labelled row everything is ``und``; extra
columns pass through; an empty table gives none.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentloom.llm import blocks as B
from talentloom.llm.common import table

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
DIM, EPOCHS, BATCH, RATE = 16, 8, 16, 0.5
SAMPLE = 3000
#: Right answers are kept in at least this share of the calibration rows; REJECT_BELOW holds where there is nothing to refuse.
KEEP_SHARE, REJECT_BELOW = 0.999, 0.5
#: Of the fitted rows, how many each model without one language sees, and how often.
FOREIGN_SHARE, FOREIGN_EPOCHS = 4, 4
UND = "und"
_OTHER = re.compile(r"[\W\d_]+")
CHUNK = 1 << 18


def letters(text: str | None) -> str:
    out = _OTHER.sub(" ", (text or "").lower()).strip()
    return out if any(map(str.isalpha, out)) else ""  # signs like one half count as word characters, but aren't letters


def features(cleaned: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket ids of the 3-grams and of the 4-grams that start at each byte, and offsets by text."""
    raw = [b" " + x.encode("utf-8", "surrogatepass") + b" \0\0\0" for x in cleaned]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(x) for x in raw])
    inside = np.ones(len(data), bool)
    for k in (1, 2, 3):
        inside[ends - k] = False
    at = np.flatnonzero(inside)
    three = data[at] | (data[at + 1] << 8) | (data[at + 2] << 16)
    four = three | (data[at + 3] << 24)
    shift = np.uint32(32 - BUCKET_BITS)
    one = ((three * np.uint32(0x9E3779B1)) ^ (three >> 15)) * np.uint32(0x85EBCA77) >> shift
    two = ((four * np.uint32(0xC2B2AE3D)) ^ (four >> 13)) * np.uint32(0x27D4EB2F) >> shift
    offsets = np.concatenate([[0], np.cumsum([len(x) - 3 for x in raw])])
    return one, two, offsets


class Model:
    """table: (BUCKETS, languages), calibrated; threshold: below it an answer is rejected."""

    def __init__(self, languages: list[str], weights: np.ndarray, threshold: float) -> None:
        self.languages, self.table, self.threshold = languages, weights.astype(np.float32), threshold

    def predict(self, cleaned: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its probability, for texts that have letters."""
        one, two, offsets = features(cleaned)
        logits = np.empty((len(cleaned), len(self.languages)))
        for k in range(len(self.languages)):
            weight = self.table[:, k]
            logits[:, k] = np.add.reduceat(weight[one] + weight[two], offsets[:-1], dtype=np.float64)
        logits /= 2 * np.diff(offsets)[:, None]
        p = softmax(logits)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sgd(ids: list[np.ndarray], counts: list[np.ndarray], label: np.ndarray, n_labels: int, seed: int = 7, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings (BUCKETS, DIM) and softmax weights (DIM, n_labels)."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    weights = rng.normal(0, 1 / DIM, (DIM, n_labels))
    share = [c / c.sum() for c in counts]
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(label))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            flat = np.concatenate([ids[i] for i in rows])
            part = np.concatenate([share[i] for i in rows])[:, None]
            size = np.array([len(ids[i]) for i in rows])
            mean = np.add.reduceat(embedding[flat] * part, np.cumsum(size) - size)
            error = softmax(mean @ weights)
            error[np.arange(len(rows)), label[rows]] -= 1
            back = error @ weights.T
            weights -= rate * mean.T @ error / len(rows)
            # the mean spreads a step over all subwords of a text, so embeddings take longer steps
            np.subtract.at(embedding, flat, 20 * rate * part * np.repeat(back, size, axis=0))
    return embedding, weights


def best_scale(logits: np.ndarray, label: np.ndarray) -> float:
    """Scale of the logits with the least loss."""
    rows = np.arange(len(label))
    scales = np.geomspace(0.1, 10, 81)
    loss = [-np.log(np.maximum(softmax(logits * s)[rows, label], 1e-12)).mean() for s in scales]
    return float(scales[int(np.argmin(loss))])


def calibrate(logits: np.ndarray, label: np.ndarray, foreign: np.ndarray) -> tuple[float, float]:
    """Scale of the logits, and the rejection threshold. foreign: scores that texts of unknown languages got."""
    if not len(label):
        return 1.0, REJECT_BELOW
    scale = best_scale(logits, label)
    p = softmax(logits * scale)
    good = p.argmax(axis=1) == label
    right, wrong = p.max(axis=1)[good], p.max(axis=1)[~good]
    most = float(np.quantile(right, 1 - KEEP_SHARE, method="lower")) if len(right) else REJECT_BELOW
    bad = np.concatenate([wrong, foreign])
    bad = bad[bad < most]
    return scale, float(np.nextafter(bad.max(), 1.0)) if len(bad) else min(REJECT_BELOW, most)


def _logits(folded: np.ndarray, ids: list[np.ndarray], n: list[np.ndarray]) -> np.ndarray:
    return np.array([(folded[i] * k[:, None]).sum(axis=0) / k.sum() for i, k in zip(ids, n, strict=True)]).reshape(-1, folded.shape[1])


def foreign_scores(ids: list[np.ndarray], n: list[np.ndarray], label: np.ndarray, fit: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The scores that held-back rows get from models fitted without their language."""
    out = [np.zeros(0)]
    for language in range(int(label.max()) + 1):
        some = fit[::FOREIGN_SHARE]
        some = some[label[some] != language]
        known = np.unique(label[some])
        strange, usual = held[label[held] == language], held[np.isin(label[held], known)]
        if len(known) < 2 or not len(strange) or not len(usual):
            continue
        embedding, weights = sgd([ids[i] for i in some], [n[i] for i in some], np.searchsorted(known, label[some]), len(known), epochs=FOREIGN_EPOCHS)
        folded = embedding @ weights
        scale = best_scale(_logits(folded, [ids[i] for i in usual], [n[i] for i in usual]), np.searchsorted(known, label[usual]))
        out.append(softmax(scale * _logits(folded, [ids[i] for i in strange], [n[i] for i in strange])).max(axis=1))
    return np.concatenate(out)


def train(docs: DataFrame, column: str = "text", lang: str = "lang", sample: int = SAMPLE, key: str = "doc_id") -> Model:
    """Fit on at most about `sample` labelled rows of docs, even over languages, chosen by a hash of key."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(column).isNotNull())
    count = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}  # one row per language
    if not count:
        return Model([], np.zeros((BUCKETS, 0)), REJECT_BELOW)
    each = sample / len(count)
    share = F.create_map(*[x for k, n in sorted(count.items()) for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    chosen = labelled.where(F.pmod(F.xxhash64(key, F.lit("langid")), F.lit(1_000_000)) < share[F.col(lang)] * 1_000_000)

    def run(batches):
        for batch in batches:
            texts = [letters(x.as_py()) for x in batch.column(0)]
            keep = [i for i, x in enumerate(texts) if x]
            langs = batch.column(1).to_pylist()
            for i in keep:
                one, two, _ = features([texts[i]])
                ids, n = np.unique(np.concatenate([one, two]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [langs[i]], "ids": [ids.astype("<u2").tobytes()], "n": [n.astype("<u4").tobytes()]}, schema=pa.schema([("lang", pa.string()), ("ids", pa.binary()), ("n", pa.binary())]))

    rows = chosen.select(column, lang).mapInArrow(run, "lang string, ids binary, n binary").collect()  # bounded by `sample`
    rows.sort(key=lambda r: (r["lang"], r["ids"], r["n"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), REJECT_BELOW)
    label = np.array([languages.index(r["lang"]) for r in rows])
    ids = [np.frombuffer(r["ids"], "<u2").astype(np.int64) for r in rows]
    n = [np.frombuffer(r["n"], "<u4").astype(np.float64) for r in rows]
    back = np.arange(len(rows)) % 5 == 4
    fit, held = np.flatnonzero(~back), np.flatnonzero(back)
    embedding, weights = sgd([ids[i] for i in fit], [n[i] for i in fit], label[fit], len(languages))
    folded = embedding @ weights
    logits = _logits(folded, [ids[i] for i in held], [n[i] for i in held])
    scale, threshold = calibrate(logits, label[held], foreign_scores(ids, n, label, fit, held))
    return Model(languages, folded * scale, threshold)


def predict(docs: DataFrame, model: Model, column: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score and accepted (columns of these names are replaced)."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted") and (keep_text or c != column)]
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    schema = T.StructType([*(docs.schema[c] for c in names), *fields])

    def run(batches):
        for piece, _ in B.slices(batches, column, CHUNK):
            texts = [letters(x.as_py()) for x in piece.column(column)]
            some = [i for i, x in enumerate(texts) if x and model.languages]
            lang, score = [UND] * len(texts), np.zeros(len(texts))
            if some:
                best, p = model.predict([texts[i] for i in some])
                for i, b in zip(some, best.tolist(), strict=True):
                    lang[i] = model.languages[b]
                score[some] = p
            accepted = np.zeros(len(texts), bool)
            accepted[some] = score[some] >= model.threshold
            kept = piece.select(names)
            out = pa.Table.from_arrays([*kept.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], names=[*names, "lang_pred", "score", "accepted"])
            yield from out.combine_chunks().to_batches()

    wanted = [*names, *([] if column in names else [column])]
    return docs.select(*wanted).mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose crc32 of the id's text is not 2 modulo 4 (a null id counts as empty)."""
    return docs.where(~_held_out())


def _held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 3: the predicted language of every document; learns where crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = train(training_rows(docs))
    out = predict(docs.select("doc_id", _held_out().alias("held_out"), "text"), model, keep_text=False)
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")
