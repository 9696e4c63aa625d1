"""The bounded training sample of the classifiers, and how they are fitted and applied."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterloom.llm.common import by_value, whole, worker_store
from rosterloom.llm.pretokens import text_parts

by_value(__name__)

FOLDS = 5
RUN = 1 << 19  # bytes of text scored together
SAMPLE_BYTES = 1 << 18  # labelled texts above this size are not learned from
ALL_BYTES = 1 << 28  # bytes of all texts learned from, at most


def held_out(id_col: str) -> Column:
    """One of five folds by the id: never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y): the labelled rows outside the held-out fold, at most ``rows`` and ``ALL_BYTES`` of them, by a hash of the id.

    Ids are chosen from the labels alone; these are at most ``rows``, so they are broadcast and no text is moved but
    the chosen ones.  Rows without id or label, and texts above ``SAMPLE_BYTES``, are not learned from; an id labelled
    twice has the larger label, an id with several texts the first of them in their order.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    place = [F.md5(F.col("id").cast("string")), F.col("id")]
    chosen = known.orderBy(*place).limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text").cast("bigint")).over(W.orderBy(*place).rowsBetween(W.unboundedPreceding, 0))
    return one.select("id", "text", "y", upto.alias("_bytes")).where(F.col("_bytes") <= ALL_BYTES).drop("_bytes")


def fitted(train: DataFrame, fit: Callable[[list[str], list[int]], bytes]) -> bytes:
    """The model that one task fits on the whole sample, the same whatever order its rows arrive in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        rows = [r for b in batches for r in zip(b["id"].to_pylist(), b["text"].to_pylist(), b["y"].to_pylist())]
        rows.sort(key=lambda r: (hashlib.md5(str(r[0]).encode()).digest(), r[1]))
        yield pa.record_batch([pa.array([fit([r[1] for r in rows], [r[2] for r in rows])], pa.binary())], names=["model"])

    row = train.repartition(1).mapInArrow(run, "model binary").head()
    return row["model"] if row else fit([], [])  # a plan known to be empty runs no task


def scored(docs: DataFrame, score: Callable[[list[str]], list[float]], threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted (1 from ``threshold`` on)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("labelled")  # what an operator before has kept is let go
        for b in batches:
            values = [v for _, texts in text_parts(b["text"], RUN) for v in score(texts)]
            yield pa.record_batch([b["id"], b["held_out"], pa.array(values, pa.float64())], names=["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), whole(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, score: Callable[[list[str]], list[float]], keep: Callable[[float], bool], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole and with all their columns, whose text's score is one to keep."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("labelled")  # what an operator before has kept is let go
        for b in batches:
            yield b.filter(pa.array([keep(v) for _, texts in text_parts(b[text_col], RUN) for v in score(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
