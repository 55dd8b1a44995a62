"""Batches of rows in small parts, so that what a kernel holds at once doesn't grow with the rows of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Rows that a kernel takes at once.
ROWS = 256


def parts(batches: Iterator[pd.DataFrame], rows: int = ROWS) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows].reset_index(drop=True)
