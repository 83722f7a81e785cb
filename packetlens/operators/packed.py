"""Several values packed in one field: split on quotes, fold the pieces back, explode.

The text is cut at its quote characters.  A fold over the pieces knows whether it stands
inside a quotation: pieces inside are literals, pieces outside are cut at separators.
Everything runs inside the JVM on SQL arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that end an unquoted value, beside any white space and brackets.
SEPARATORS = "|;,/&+·•；，、｜／"
BRACKETS = "()[]{}<>（）［］【】"
_BLANK = r"[\s\p{Z}\x{FEFF}\x{200B}]"
#: Stand for the end of a value and for an emptied place while the fold runs.
_END = "\x1e"
#: A buffer longer than this is put aside, so that a fold over a long text stays linear.
_FLUSH = 4096


def _cls(chars: str) -> str:
    return "".join("\\" + c if c in r"[]{}()|\^$.*+?&-" else c for c in chars)


def split_packed(text: Column, *, separators: str = SEPARATORS, brackets: str = BRACKETS) -> Column:
    """The values of one packed text in written order, as ``array<string>``.

    Either quote may enclose a value; a doubled quote inside stands for one; separators and
    brackets inside quotes belong to the value.  Unquoted values end at white space,
    separators, brackets and quotes.  Empty places give nothing.  NULL and blank texts give
    an empty array; an unclosed quote reaches to the end of the text.
    """
    outside = rf"(?:{_BLANK}|[{_cls(separators + brackets)}])+"
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)['\"]|[^'\"]+"), F.lit(0))
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("buf"),
        F.lit("").alias("q"),
        F.lit("").alias("closed"),
    )

    def step(state: Column, piece: Column) -> Column:
        quote = piece.isin("'", '"')
        inside = state["q"] != ""
        # what is added, the quote that is open next, the quote that was closed just now
        doubled = ~inside & quote & (state["closed"] == piece)
        opens = ~inside & quote & ~doubled
        closes = inside & (piece == state["q"])
        added = (
            F.when(opens, F.lit(_END))
            .when(doubled, F.concat(F.lit("\x1f"), piece))
            .when(closes, F.lit(_END))
            .when(inside, F.translate(piece, _END + "\x1f", "  "))
            .otherwise(F.regexp_replace(piece, outside, _END))
        )
        grown = F.concat(state["buf"], added)
        full = F.length(grown) > _FLUSH
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(grown))).otherwise(state["done"]).alias("done"),
            F.when(full, F.lit("")).otherwise(grown).alias("buf"),
            F.when(opens | doubled, piece).when(closes, F.lit("")).otherwise(state["q"]).alias("q"),
            F.when(closes, piece).otherwise(F.lit("")).alias("closed"),
        )

    joined = F.aggregate(
        pieces, start, step, lambda s: F.array_join(F.concat(s["done"], F.array(s["buf"])), "")
    )
    # A doubled quote was first taken for an end: take the end back.
    whole = F.replace(joined, F.lit(_END + "\x1f"), F.lit(""))
    values = F.transform(
        F.split(whole, _END), lambda v: F.regexp_replace(v, rf"^{_BLANK}+|{_BLANK}+$", "")
    )
    return F.filter(values, lambda v: v != "")


def unpack_values(
    df: DataFrame,
    *,
    fields: Sequence[str],
    row_key: str,
    source_table: str,
    keep: Sequence[str] = (),
    separators: str = SEPARATORS,
) -> DataFrame:
    """One row per value of each of ``fields``, with its place (from 1) in the field.

    A row delivered twice (same key, same text) counts once.  Rows without key are kept under
    a NULL key; other columns of ``df`` play no part unless named in ``keep``.
    Returns ``source_table, row_key, field_name, item_no, item`` and ``keep``.
    """
    named = F.array(
        *[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("text")) for f in fields]
    )
    rows = df.select(
        F.lit(source_table).alias("source_table"),
        F.col(f"`{row_key}`").alias("row_key"),
        *[F.col(f"`{c}`") for c in keep],
        F.inline(named),
    ).where(F.length(F.trim("text")) > 0)
    rows = rows.distinct()
    return rows.select(
        "source_table",
        "row_key",
        "field_name",
        *keep,
        F.posexplode(split_packed(F.col("text"), separators=separators)).alias("item_no", "item"),
    ).select(
        "source_table", "row_key", "field_name", (F.col("item_no") + 1).alias("item_no"), "item", *keep
    )
