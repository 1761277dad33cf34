"""Document text from pieces, and bounding boxes in document coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.operators.scan import ROWS_PER_TASK, Carry, lookup, running
from clausework.schemas import MIN_BOX, PAGE_GAP


# Exact heights: sums of doubles would depend on their order.
EXACT = "decimal(28,9)"


def assemble_pages(
    pieces: DataFrame, doc: str = "contract_id", page: str = "page", pos: str = "pos", piece: str = "piece",
    target: str = "text",
) -> DataFrame:
    """One text per page: its pieces in order, joined by a space."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(pos, piece))), lambda x: x[piece])
    return pieces.groupBy(doc, page).agg(F.array_join(in_order, " ").alias(target))


def assemble_documents(
    pieces: DataFrame, doc: str = "contract_id", page: str = "page", pos: str = "pos", piece: str = "piece"
) -> DataFrame:
    """One text per document: its pages in order, each followed by a blank line.

    Pages come together first, so pieces spread by page. The text is one cell; for documents
    beyond that see ``chunk_pieces``, which needs no whole text.
    """
    pages = assemble_pages(pieces, doc, page, pos, piece, "_page")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(page, "_page"))), lambda x: x["_page"])
    return pages.groupBy(doc).agg(F.concat(F.array_join(in_order, "\n\n"), F.lit("\n\n")).alias("text"))


def page_offsets(
    pages: DataFrame,
    doc: str = "contract_id",
    page: str = "page",
    height: str = "height",
    gap: float = PAGE_GAP,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Pages with ``page_offset``: heights and gaps of all earlier pages.

    Summed as decimals with nine places, so the answer does not depend on how the rows are split.
    """
    step = F.col(height).cast(EXACT) + F.lit(gap).cast(EXACT)
    return running(
        pages, [doc], [page], {"page_offset": Carry("sum", step, include_row=False)}, rows_per_task
    ).withColumn("page_offset", F.col("page_offset").cast("double"))


def document_heights(pages: DataFrame, doc: str = "contract_id", height: str = "height", gap: float = PAGE_GAP) -> DataFrame:
    """Sum of page heights plus the gaps between pages."""
    return pages.groupBy(doc).agg(
        (F.sum(F.col(height).cast(EXACT)) + F.lit(gap).cast(EXACT) * (F.count(F.lit(1)) - 1)).cast("double").alias("document_height")
    )


def _scale(rendered: Column, own: Column) -> Column:
    return F.when(F.coalesce(own, F.lit(0.0)) != 0, rendered / own).otherwise(F.lit(1.0))


def box_geometry(
    boxes: DataFrame, offset_pages: DataFrame, doc: str = "contract_id", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Boxes (page, x_min .. page_height) placed on rendered pages (page, width, height, page_offset).

    Page 0 and below count as page 1. A parameter without a box (page or corner missing) and a box
    on a page that does not exist are dropped.
    """
    needed = ("page", "x_min", "y_min", "x_max", "y_max")
    boxes = boxes.dropna(subset=list(needed))
    others = [
        c for c in boxes.columns
        if c not in ("page", "x_min", "y_min", "x_max", "y_max", "page_width", "page_height")
    ]
    rendered = offset_pages.select(
        doc, F.col("page").alias("_page"), F.col("width").alias("_w"), F.col("height").alias("_h"), "page_offset"
    )
    on_page = boxes.withColumn("_page", F.greatest(F.col("page"), F.lit(1)))
    placed = lookup(on_page, rendered, [doc, "_page"], rows_per_task=rows_per_task)
    sx, sy = _scale(F.col("_w"), F.col("page_width")), _scale(F.col("_h"), F.col("page_height"))
    return placed.select(
        *others,
        F.col("_page").alias("page"),
        (F.col("x_min") * sx).alias("left"),
        (F.col("page_offset") + F.col("y_min") * sy).alias("top"),
        F.greatest((F.col("x_max") - F.col("x_min")) * sx, F.lit(float(MIN_BOX))).alias("width"),
        F.greatest((F.col("y_max") - F.col("y_min")) * sy, F.lit(float(MIN_BOX))).alias("height"),
    )
