"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import arrow_map, picked, slices
from meshwork.llm.hashgrams import blocks, char_grams

ORDERS = (1, 2, 3)
BITS = 15
#: Documents to learn from, about: a hash picks them where there are more.
TRAIN_ROWS = 20_000
#: N-grams that the score counts at most: a long text is no surer than one of so many. The prediction counts all.
TRUST = 100

_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # 2**BITS x languages
    log_prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text, and its posterior (0 to 1) with likelihoods of TRUST n-grams at most; ``und`` and 0 without a letter."""
        n = len(texts)
        known = [k for k, t in enumerate(texts) if t is not None and _LETTER.search(t)]
        if not known or not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        total, grams = np.zeros((n, len(self.languages))), np.zeros(n)
        for codes, owner, live in blocks([(texts[k] or "").lower() for k in known], max(ORDERS) - 1):
            for order in ORDERS:
                at, h = char_grams(codes, live, order, BITS)
                if len(at):
                    mine = owner[at]
                    first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                    rows = np.array(known)[mine[first]]
                    np.add.at(total, rows, np.add.reduceat(self.log_prob[h], first, axis=0, dtype=np.float64))
                    np.add.at(grams, rows, np.diff(np.r_[first, len(at)]))
        scale = np.minimum(grams, TRUST) / np.maximum(grams, 1)
        best = (total + self.log_prior).argmax(axis=1)
        logit = total * scale[:, None] + self.log_prior
        sure = 1 / np.exp(logit - logit[np.arange(n), best][:, None]).sum(axis=1)
        named = [UNKNOWN] * n
        for k in known:
            named[k] = self.languages[best[k]]
        mask = np.zeros(n, dtype=bool)
        mask[known] = True
        return named, np.where(mask, sure, 0.0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in slices(batches, 1024):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])
        for x in names:
            tables.setdefault(x, np.zeros(1 << BITS, dtype=np.int64))
            rows[x] = rows.get(x, 0) + langs.count(x)
        for codes, owner, live in blocks([(t or "").lower() for t in texts], max(ORDERS) - 1):
            for order in ORDERS:
                at, h = char_grams(codes, live, order, BITS)
                both = np.bincount(code[owner[at]].astype(np.int64) << BITS | h, minlength=len(names) << BITS)
                for i, x in enumerate(names):
                    tables[x] += both[i << BITS : (i + 1) << BITS]
    for x, count in tables.items():
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([x] * (len(at) + 1), pa.string()), pa.array(np.r_[at, -1], pa.int64()), pa.array(np.r_[count[at], rows[x]], pa.int64())], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Learns from the rows where ``learn`` holds and the language and text are given.

    Of more than ``train_rows`` such rows a hash of the id and text picks about
    that many, at any size. Each task sums its n-grams, Spark adds the tables, and
    the driver gets 2**15 counts a language, whatever the input. Rows that repeat
    count as often as they stand there; an empty table gives a model without
    languages.
    """
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = min(1.0, train_rows / max(1, rows.count()))
    if share < 1:
        rows = rows.filter(picked(share, id_col, text_col))
    summed = arrow_map(rows.select(lang_col, text_col), _counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(summed["lang"].unique()))
    counts, docs_of = np.zeros((1 << BITS, len(names))), np.ones(len(names))
    for i, x in enumerate(names):
        mine = summed[summed["lang"] == x]
        grams = mine[mine["bucket"] >= 0]
        counts[grams["bucket"].to_numpy(), i] = grams["n"].to_numpy()
        docs_of[i] = mine.loc[mine["bucket"] < 0, "n"].sum()
    smoothed = counts + 0.5
    log_prob = np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32)
    return LanguageModel(names, log_prob, np.log(docs_of / docs_of.sum()))


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row.

    A null text, or one without a letter, is ``und`` with score 0. Texts are read
    whole, however long, in blocks of bounded size. Equal texts get equal
    results; an empty table gives no rows; without any language to learn, all is
    ``und``. The broadcast model is 2**15 floats a language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            named, score = shared.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return arrow_map(docs.select(id_col, text_col), run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def accept(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a score of ``least`` or more, with all their columns, in one pass.

    Null texts and texts without a letter go. Rows that repeat stay or go together;
    an empty table gives no rows; columns of any name or type pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            named, score = shared.value.score(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and bool(s >= least) for x, s in zip(named, score, strict=True)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
