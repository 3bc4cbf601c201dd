"""Text fragments of page files.  The reader of the file format is an optional library, named where it is lacking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from paperlane.errors import SourceUnreadable

SCHEMA = "doc string, content_hash string, page int, width double, height double, x_left double, y_top double, x_right double, y_bottom double, text string, raw_confidence double"


def fragments(files: DataFrame) -> DataFrame:
    """One row for each text rectangle of ``files`` (relative_path, content_hash, content); a page without text has one row with a null text."""
    try:
        import pypdfium2  # noqa: F401
    except ImportError as why:
        raise SourceUnreadable("reading page files needs pypdfium2, which isn't installed") from why

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pypdfium2

        for batch in batches:
            rows = []
            for path, digest, content in zip(batch.relative_path, batch.content_hash, batch.content, strict=True):
                book = pypdfium2.PdfDocument(content)
                for number, page in enumerate(book, 1):
                    width, height = page.get_size()
                    layer, some = page.get_textpage(), False
                    for k in range(layer.count_rects()):
                        left, low, right, high = layer.get_rect(k)
                        text = layer.get_text_bounded(left, low, right, high)
                        if text.strip():
                            some = True
                            rows.append((path, digest, number, width, height, left, height - high, right, height - low, text, 1.0))
                    if not some:
                        rows.append((path, digest, number, width, height, 0.0, 0.0, width, height, None, None))
                book.close()
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("relative_path", "content_hash", "content").mapInPandas(run, SCHEMA)
