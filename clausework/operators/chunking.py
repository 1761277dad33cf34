"""Chunks straight from document pieces, also for documents too large to be one cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions.text import chunk_documents, paragraphs, pieces_of
from clausework.operators.layout import assemble_documents, assemble_pages
from clausework.operators.scan import ROWS_PER_TASK, Carry, reachable, running, split_hot
from clausework.schemas import CHUNK_CHARS
from clausework.session import checkpointed

# Characters of one document that are put together in one task.
CHARS_PER_TASK = 32_000_000


def chunk_pieces(
    pieces: DataFrame,
    max_chars: int = CHUNK_CHARS,
    doc: str = "contract_id",
    page: str = "page",
    pos: str = "pos",
    piece: str = "piece",
    chars_per_task: int = CHARS_PER_TASK,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """doc, ``chunk_no``, ``chunk``: as if each document were assembled and then chunked.

    Ordinary documents are. One with more text than ``chars_per_task`` never becomes a cell: its
    paragraphs stay rows, spread over many tasks.
    """
    # A piece costs something even when it is empty.
    usual, long, _ = split_hot(pieces, [doc], chars_per_task, F.coalesce(F.length(piece), F.lit(0)) + 8)
    done = chunk_documents(assemble_documents(usual, doc, page, pos, piece), "text", max_chars)
    if long is None:
        return done
    pages = assemble_pages(long, doc, page, pos, piece, "_text")
    return done.unionByName(_chunk_rows(pages, max_chars, doc, page, rows_per_task))


def _chunk_rows(pages, max_chars, doc, page, rows_per_task):
    """Greedy packing of paragraph rows.

    With running text offsets, the paragraph that opens the chunk after one opened at p is the
    first that ends more than ``max_chars`` behind p's start. That gives every paragraph its
    would-be successor; walking the successors from the start of the document (and from behind
    each over-long paragraph) marks the real openings.
    """
    # Splitting by page finds the paragraphs of the whole text: pages are parted by a blank line.
    rows = pages.select(doc, page, F.posexplode(paragraphs(F.col("_text"))).alias("_i", "_para")).withColumn(
        "_size", F.length("_para")
    )
    too_long = F.col("_size") > max_chars
    rows = checkpointed(running(
        rows.withColumn("_long", too_long), [doc], [page, "_i"],
        {
            "_pos": Carry("sum", F.lit(1)),
            "_run": Carry("sum", F.when(F.col("_long"), 1).otherwise(0)),
            "_end": Carry("sum", F.col("_size") + 2),
        },
        rows_per_task,
    ))
    run = [doc, "_run"]
    short = rows.filter(~F.col("_long")).select(*run, "_pos", "_size", "_end")
    asks = short.select(
        *run, "_pos", (F.col("_size") + 2 - F.col("_end")).alias("_back"), F.lit(0).alias("_offers"),
        F.lit(None).cast("long").alias("_offer"),
    )
    offers = short.select(
        *run, "_pos", (max_chars + 2 - F.col("_end")).alias("_back"), F.lit(1).alias("_offers"),
        F.col("_pos").alias("_offer"),
    )
    jump = running(
        asks.unionByName(offers), run, ["_back", "_offers"],
        {"_next": Carry("last", F.col("_offer"), include_row=False)}, rows_per_task,
    ).filter("_offers = 0 AND _next IS NOT NULL").select(*run, "_pos", "_next")
    roots = checkpointed(short.groupBy(*run).agg(F.min("_pos").alias("_pos")))
    openings = roots.unionByName(reachable(roots, checkpointed(jump), run)).withColumn("_opens", F.lit(1))
    cuts = F.ceil(F.col("_size") / max_chars)
    placed = running(
        rows.join(openings, [*run, "_pos"], "left"), [doc], ["_pos"],
        {"_chunks": Carry("sum", F.when(F.col("_long"), cuts).otherwise(F.coalesce(F.col("_opens"), F.lit(0))))},
        rows_per_task,
    )
    # A chunk holds at most max_chars, so this group is small.
    packed = placed.filter(~F.col("_long")).groupBy(doc, (F.col("_chunks") - 1).alias("chunk_no")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_para"))), lambda x: x["_para"]), "\n\n"
        ).alias("chunk")
    )
    cut = placed.filter("_long").select(
        doc, (F.col("_chunks") - cuts).alias("_from"), F.posexplode(pieces_of(F.col("_para"), max_chars)).alias("_i", "chunk")
    ).select(doc, (F.col("_from") + F.col("_i")).alias("chunk_no"), "chunk")
    return packed.unionByName(cut).withColumn("chunk_no", F.col("chunk_no").cast("int"))
