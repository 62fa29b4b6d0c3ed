"""Outlines of documents that arrive piece by piece."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from loomspark.functions.outline import outline, parents

CHUNKS = "file_path string, local_index int, content string, depth int, parent_local_index int, batch_id int"
STATE = "heading_depth int, heading string, last int, batch int"


def outline_stream(deltas: DataFrame) -> DataFrame:
    """Chunks of a stream of appended texts (file_path, seq, delta).

    The state of a file is its last heading, its last number and its last
    batch.  What a trigger brings for a file is put in order of seq and
    outlined under that heading, as an appended text is.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        text = "".join(rows["delta"].fillna(""))
        depth, heading, last, batch = state.get if state.exists else (None, None, -1, -1)
        pieces = outline("#" * max(1, depth + 1) + f" {heading}\n" + text, title=False)[1:] if heading is not None else outline(text)
        if not pieces:
            return
        first, batch = last + 1, batch + 1
        index = [first + i for i in range(len(pieces))]
        for i, (d, c) in zip(index, pieces):
            if d <= 1:
                depth, heading = d, c
        state.update((depth, heading, index[-1], batch))
        up = [None if p is None else first + p for p in parents([d for d, _ in pieces])]
        yield pd.DataFrame({"file_path": key[0], "local_index": index, "content": [c for _, c in pieces], "depth": [d for d, _ in pieces], "parent_local_index": pd.array(up, "Int32"), "batch_id": batch})

    return deltas.groupBy("file_path").applyInPandasWithState(run, CHUNKS, STATE, "append", "NoTimeout")
