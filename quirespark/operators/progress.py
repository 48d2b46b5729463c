"""Progress over pages, and diagnostics from the same pass as the result.

A page's kernel gives its result and rows of diagnostics together; they are written once, so both come from tasks that ended well and
nothing is computed twice. The count of finished pages is an accumulator, to which Spark adds what a task has counted only when it ends well:
an attempt that failed leaves no trace in it.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written


def with_diagnostics(pages: DataFrame, kernel: Callable[[object], tuple[dict, list[dict]]], result: str, diagnostics: str, done: Accumulator | None = None) -> tuple[DataFrame, DataFrame]:
    """doc, page and the columns `result` (DDL) of each page, and doc, page and the columns `diagnostics` of each of its diagnostic rows.
    kernel: a row of pages (a named tuple) to its result and its diagnostics."""
    kinds = dict(pages.dtypes)
    struct = ", ".join(f"{name}: {kind}" for name, kind in (c.strip().split(" ", 1) for c in diagnostics.split(",")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                found, notes = kernel(row)
                rows.append({"doc": row.doc, "page": row.page, **found, "diagnostics": notes})
            if rows:
                yield pd.DataFrame(rows)
            if done is not None:
                done.add(len(rows))

    table = written(pages.mapInPandas(run, f"doc {kinds['doc']}, page {kinds['page']}, {result}, diagnostics array<struct<{struct}>>"))
    return table.drop("diagnostics"), table.select("doc", "page", F.inline("diagnostics"))


@contextmanager
def reported(done: Accumulator, total: int, say: Callable[[str], None], every: float = 1.0) -> Iterator[None]:
    """While the block runs, say how many of all pages are finished, whenever that has changed."""
    ended = threading.Event()

    def watch() -> None:
        last = None
        while True:
            over = ended.wait(every)
            if done.value != last:
                last = done.value
                say(f"{last} of {total} pages")
            if over:
                return

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()
