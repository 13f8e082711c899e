"""Texts cut into ordered, overlapping pieces by one pattern with bounded quantifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most characters of a piece, and how many of them repeat the end of the piece before.
SIZE, OVERLAP = 2_000, 200


def _pattern(most: int) -> str:
    """New characters of one piece: all that is left, else up to the last paragraph, line, sentence or word end."""
    ends = (r"\n\r?\n", r"\n", r"[.!?…][\"'”’)]?\s", r"\s")
    near = [rf".{{{most // 2},{most}}}(?<={e})" for e in ends]
    far = [rf".{{1,{most // 2}}}(?<={e})" for e in ends]
    return r"(?s)(?:" + "|".join([rf".{{1,{most}}}\z", *near, *far, rf".{{1,{most}}}"]) + ")"


def pieces(text: Column) -> Column:
    """Array of the pieces in their order; null for a null text, one piece for one of at most SIZE characters."""
    new = F.regexp_extract_all(text, F.lit(_pattern(SIZE - OVERLAP)), F.lit(0))
    # each piece's end in the text gives the piece: its new characters and the OVERLAP before them
    ends = F.aggregate(
        new,
        F.array().cast("array<int>"),
        lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + F.length(x))),
    )
    cut = F.transform(
        F.arrays_zip(new.alias("new"), ends.alias("ends")),
        lambda x: F.substring(text, F.greatest(x["ends"] - F.length(x["new"]) - OVERLAP, F.lit(0)) + 1, F.least(F.length(x["new"]) + OVERLAP, x["ends"])),
    )
    return F.when(F.length(text) <= SIZE, F.array(text)).otherwise(cut)


def split_items(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id_col, piece_no from 1, piece) of each row of df with a text that isn't empty."""
    return df.filter(F.length(text_col) > 0).select(id_col, F.posexplode(pieces(F.col(text_col))).alias("at", "piece")).select(id_col, (F.col("at") + 1).alias("piece_no"), "piece")
