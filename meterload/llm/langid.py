"""Language ID with a bit-sliced Bloom filter of character n-grams.

Position p of the filter holds one bit per language. An n-gram sets the bit of its language at a few hashed
positions; the AND of the words at an n-gram's positions is the set of all languages that contain it. A text is
looked up gram by gram, hits are counted per language, and each count is corrected for the share of grams that
the filter of that language would report by chance (its fill to the number of hashes). The largest count decides.

Learning: grams are counted per language over a bounded sample of the labelled rows (SAMPLE_ROWS per language,
chosen by a hash of doc_id). A language keeps a gram that is common in it and at least KEEP as frequent as in the
language where it is most frequent, so that a gram of every language tells nothing and is stored once. Grams count from
MIN_TEXTS texts on; a language of fewer than FEW labelled texts keeps rarer ones too, which take none from others.
The filter has as many 64-bit words a position as the languages need, whatever the input.

Defined cases: `und` with score 0 for a text that is null or has no letter, and wherever nothing was learned. Rows
with a null lang or doc_id are not learned from. held_out is false for a null doc_id. Ties go to the language that
sorts first. The whole text counts. Repeated rows are predicted alike; other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterload.llm.common import SLICE, map_arrow
from meterload.sources.tables import stored

UNDETERMINED = "und"
#: Labelled rows learned from, per language: a bound on the fit only.
SAMPLE_ROWS = 4000
#: Positions of the filter; a bit per language each, in 64-bit words.
POSITIONS = 1 << 20
HASHES = 2
#: Characters of an n-gram; words are padded with one space on both sides.
SIZES = (2, 3, 4)
#: A language keeps a gram seen in so many sampled texts ...
MIN_TEXTS = 3
#: ... or in one, if the language has fewer labelled texts than this; and ...
FEW = 30
#: ... whose share of the language's grams is so much of the largest share in any language.
KEEP = 0.6
#: Grams looked up at once, to bound memory for very long texts.
BLOCK = 1 << 20

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _letters() -> np.ndarray:
    """Per code point, whether it is a letter; made once per worker."""
    table = getattr(_letters, "table", None)
    if table is None:
        table = np.zeros(sys.maxunicode + 1, bool)
        table[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = True
        _letters.table = table
    return table


def gram_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the n-grams of the words (runs of letters, lower case) of a text, repeats included."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    # One space for each run of other characters, and one at both ends.
    line = np.concatenate(([32], np.where(letter, points, 32), [32])).astype(np.uint64)
    line = line[np.append(True, (line[1:] != 32) | (line[:-1] != 32))]
    space = line == 32
    out = []
    for n in SIZES:
        if len(line) >= n:
            codes = line[: len(line) - n + 1].copy()
            inner = np.zeros(len(codes), bool)
            for k in range(1, n):
                codes = codes * np.uint64(0x100000001B3) + line[k: len(line) - n + 1 + k]
                if k < n - 1:
                    inner |= space[k: len(line) - n + 1 + k]
            out.append((codes[~inner] + np.uint64(n)) * _MIX[0])
    hashes = np.concatenate(out)
    hashes ^= hashes >> np.uint64(29)
    return hashes


def positions(hashes: np.ndarray) -> list[np.ndarray]:
    """HASHES filter positions of each gram."""
    second = hashes * _MIX[1]
    return [((hashes + np.uint64(k) * (second | np.uint64(1))) >> np.uint64(44)).astype(np.int64) % POSITIONS
            for k in range(HASHES)]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    words: np.ndarray  # uint64, POSITIONS rows of a word for each 64 languages
    chance: np.ndarray  # per language, of a false hit


def _sample(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """About SAMPLE_ROWS labelled rows per language, by a hash of doc_id."""
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(float(SAMPLE_ROWS << 30)) / F.col("n")
    return rows.join(sizes, "lang").where(chosen).select("lang", "text")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, texts, n) of each batch."""
    for batch in batches:
        parts: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            parts.setdefault(lang, []).append(gram_hashes(text))
        for lang, found in parts.items():
            every, n = np.unique(np.concatenate(found), return_counts=True)
            once, texts = np.unique(np.concatenate([np.unique(f) for f in found]), return_counts=True)
            assert len(once) == len(every)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(every), pa.string()), "gram": every.view(np.int64),
                "texts": texts.astype(np.int64), "n": n.astype(np.int64)})


def learn(docs: DataFrame, use: Column | None = None) -> Model:
    """Fit the filter on the labelled rows for which `use` holds (those not held out)."""
    use = ~held_out(F.col("doc_id")) if use is None else use
    labelled = docs.where(use & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = stored(labelled.groupBy("lang").agg(F.count("*").alias("n")), "lang-sizes")
    sample = _sample(labelled.select("doc_id", "lang", "text"), sizes)
    counts = stored(
        sample.mapInArrow(_grams, "lang string, gram long, texts long, n long")
        .groupBy("lang", "gram").agg(F.sum("texts").alias("texts"), F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).join(
        sizes.select("lang", (F.col("n") < FEW).alias("few")), "lang")
    often = F.col("texts") >= MIN_TEXTS
    shares = counts.join(totals, "lang").where(often | F.col("few")).select(
        "lang", "gram", often.alias("often"), (F.col("n") / F.col("total")).alias("share"))
    top = shares.where("often").groupBy("gram").agg(F.max("share").alias("top"))
    kept = stored(shares.join(top, "gram", "left").where(
        F.col("top").isNull() | (F.col("share") >= F.lit(KEEP) * F.col("top"))).select("lang", "gram"), "kept-grams")
    languages = sorted(r.lang for r in kept.select("lang").distinct().collect())
    width = max(1, -(-len(languages) // 64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: i for i, lang in enumerate(languages)}
        words = np.zeros((POSITIONS, width), np.uint64)
        for batch in batches:
            order = np.array([number[lang] for lang in batch.column("lang").to_pylist()], np.int64)
            bits = np.uint64(1) << (order % 64).astype(np.uint64)
            grams = batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in positions(grams):
                np.bitwise_or.at(words, (at, order // 64), bits)
        used = np.nonzero(words)
        yield pa.RecordBatch.from_pydict({"at": used[0], "word": used[1], "mask": words[used].view(np.int64)})

    # At most POSITIONS rows for each 64 languages come to the driver, as many for any input.
    filled = kept.mapInArrow(place, "at long, word long, mask long").groupBy("at", "word").agg(
        F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros((POSITIONS, width), np.uint64)
    words[filled["at"].to_numpy(), filled["word"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    fill = np.array([((words[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, words, fill ** HASHES)


def judge(text: str | None, model: Model) -> tuple[str, float]:
    """(language, score): the score is the part of the text's grams that the language contains, corrected."""
    grams = gram_hashes(text) if text else np.empty(0, np.uint64)
    if not len(grams) or not model.languages:
        return UNDETERMINED, 0.0
    hits = np.zeros(len(model.languages))
    for start in range(0, len(grams), BLOCK):
        masks = None
        for at in positions(grams[start: start + BLOCK]):
            masks = model.words[at] if masks is None else masks & model.words[at]
        for i in range(len(model.languages)):
            hits[i] += np.count_nonzero(masks[:, i // 64] & np.uint64(1 << i % 64))
    true = np.maximum(hits - len(grams) * model.chance, 0) / (1 - model.chance)
    best = int(np.argmax(true))
    return model.languages[best], float(min(1.0, true[best] / len(grams)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # POSITIONS words for each 64 languages

    def one(batch: pa.RecordBatch) -> dict[str, list]:
        found = [judge(t, shared.value) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_arrow(rows, one, "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, min_score: float) -> DataFrame:
    """The rows of `docs` whose text has a recognised language: not `und`, and a score of min_score or more.

    Only texts go to Python and only flags come back; whole rows stay in the JVM, which filters them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(texts), SLICE):
            for text in texts.slice(at, SLICE).to_pylist():
                lang, score = judge(text, shared.value)
                found.append(lang != UNDETERMINED and score >= min_score)
        return pa.array(found, pa.bool_())

    return docs.where(known(F.col("text")))
