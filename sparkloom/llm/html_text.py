"""HTML extraction: a recurrent labeller classifies every leaf block of a page in the context of the whole page.

Pages are read in one pass, a page at a time, and labelled side by side with pages of like length; nothing is shuffled.
The model is trained on the driver on invented pages (see synthetic_pages), seeded, once a process, and is a few hundred
kilobytes.

Defined results: null html is the empty page, whose text is empty; equal pages are rows of their own; a table
without rows gives none; other columns are not read. A line break tag is white space inside its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import bounded
from .blocks_html import leaves
from .common import lean, table
from .labeller import Labeller, trained


def main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Of pages (page_id, url, html): page_id, url, text, n_chars."""
    labeller = model or trained()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            pages_ = batch.column(2).to_pylist()
            texts: list[str] = []
            for a, b in bounded([len(p) for p in pages_], 1 << 20):
                found = [leaves(p) for p in pages_[a:b]]
                for blocks, main in zip(found, labeller.label(found), strict=True):
                    texts.append("\n\n".join(x.text for x, keep in zip(blocks, main, strict=True) if keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
