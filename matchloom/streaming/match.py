"""An extension beyond batch matching: a stream of queries matched against a static catalogue, micro-batch by
micro-batch.  The catalogue's index is written once, before the stream begins; each batch joins it by the set-based
ranker, so a stream gives what a batch job over the same rows gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from matchloom.functions.text import with_normalised
from matchloom.operators import index, rank
from matchloom.sources.shared import stored


def match_stream(queries: DataFrame, catalogue: DataFrame, terms_of, path: str, checkpoint: str, k: int = 1, available_now: bool = True) -> StreamingQuery:
    """queries: a stream of query_id and text; catalogue: ord and doc.  Rankings are appended as Parquet under path, in a
    folder per batch, which a batch that runs again overwrites."""

    built = index.tfidf_index(catalogue, terms_of)
    catalogue, copies = stored(catalogue.select("ord"), "catalogue"), stored(built.copies, "copies")
    built = index.TfidfIndex(stored(built.counts, "counts"), built.terms, copies, built.rare)

    def ranked(batch: DataFrame, number: int) -> None:
        found = rank.tfidf_by(built, with_normalised(batch, "text"), catalogue, terms_of, k)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run_batches(queries, ranked, checkpoint, available_now)


def run_batches(stream: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
