"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every source gets a share of all words by weight, at most ``cap`` times its own words. A document's
expected number of copies is target / size of its source; the whole part is taken outright and the
fraction is rounded by the pivotal method: two fractions meet, word mass moves at random from one to
the other until one of them is 0 or 1, and the one left over meets the next. Expectations stay as
they were, and so does the sum of the source's words.

The meetings form a reduction tree. Documents are dealt by hash into groups of about ``FAN_IN``;
each group is folded in one cell and leaves one fraction, and these are the documents of the next
level, until a source has one fraction left. A source that holds a third of all documents has
proportionally many groups. The last fraction of a source is rounded to the nearer side, and then
at most three documents of the source are changed, each the one that comes nearest to the target.

Identical rows (same id, source and size) are combined first and share one entry with a
multiplicity, so that repeated rows cannot fill a group.

Defined results
  null or empty text    size 0; nothing of it is taken
  null source           a source of its own, sorted last
  repeated rows, null ids   each row counts; copies are spread evenly over identical rows
  source without words  target 0
  empty table           no rows
  other columns         ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.llm.util import WORD, bounded, checkpointed, match, plain_names, uniform

WEIGHTS = (1, 2, 3)
CAP = 3
# Fractions per fold; with hashing no group grows far beyond it.
FAN_IN = 32
# Identical rows are written out by this many per generated row of the first step.
STRIDE = 4096

_ITEM = "struct<size:long,doc_id:{0},p:double>"
_DONE = "array<struct<doc_id:{0},size:long,bit:int>>"


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Distinct (source, doc_id, size) with their number of rows ``n``."""
    words = F.size(F.regexp_extract_all(F.coalesce(docs[text_col], F.lit("")), F.lit(WORD), F.lit(0)))
    rows = docs.select(docs[source_col].alias("source"), docs[id_col].alias("doc_id"), words.cast("long").alias("size"))
    return rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))


def targets(items: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, entries and target: shares by weight, capped, the excess shared again.

    Weights go to the sources in code-point order, null last, over and over. Each round of sharing
    reads back three sums, never the sources.
    """
    spark = items.sparkSession
    per_source = checkpointed(items.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("entries")
    ))
    ordered = per_source.orderBy(F.col("source").asc_nulls_last()).select(
        "source", "source_size", "entries", F.monotonically_increasing_id().alias("place")
    )
    ordered = checkpointed(ordered.withColumn("part", F.shiftright("place", 33)))
    # Places within a sorted partition start at zero: rows before it, one number per partition.
    counts = {r.part: r["count"] for r in ordered.groupBy("part").count().toLocalIterator()}
    before, seen = [(-1, 0)], 0
    for part in sorted(counts):
        before.append((part, seen))
        seen += counts[part]
    starts = spark.createDataFrame(before, "part long, before long")
    number = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    weighed = ordered.join(F.broadcast(starts), "part").select(
        "source", "source_size", "entries", weight.cast("long").alias("weight")
    )
    weighed = checkpointed(weighed)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.lit(cap)
    left, share = total, None
    while True:
        # Sources at their cap so far; the others share what those leave.
        full = F.lit(False) if share is None else F.col("weight") * F.lit(share[0]) >= limit * F.lit(share[1])
        full = full | (F.col("source_size") == 0)
        done, open_weight, n_full = weighed.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(full.cast("int")), F.lit(0)),
        ).first()
        left = total - done
        if not open_weight or share == (left, open_weight):
            break
        share = (left, open_weight)
    numerator, denominator = share or (0, 1)
    target = F.least(
        F.col("weight").cast("double") * F.lit(float(numerator)) / F.lit(float(denominator)), limit.cast("double")
    )
    return weighed.select("source", "source_size", "entries", target.alias("target"))


def _meet(id_type: str, seed: Column):
    """One step of the fold: the running fraction meets the next one."""
    item, done = _ITEM.format(id_type), _DONE.format(id_type)

    def step(state, x):
        r = state["rest"]
        up = F.least((1 - r["p"]) * r["size"], x["p"] * x["size"])
        down = F.least(r["p"] * r["size"], (1 - x["p"]) * x["size"])
        u = uniform(seed, r["doc_id"].cast("string"), r["size"], x["doc_id"].cast("string"), x["size"])
        gain = u * (up + down) < down  # r gains with the odds that keep its expectation
        r_ends = F.when(gain, (1 - r["p"]) * r["size"] <= x["p"] * x["size"]).otherwise(
            r["p"] * r["size"] <= (1 - x["p"]) * x["size"]
        )
        bit = F.when(gain == r_ends, 1).otherwise(0)
        ended = F.when(r_ends, F.struct(r["doc_id"].alias("doc_id"), r["size"].alias("size"), bit.alias("bit"))).otherwise(
            F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), bit.alias("bit"))
        )
        moved = F.when(gain, up).otherwise(-down)
        stays = F.when(r_ends, F.struct(
            x["size"].alias("size"), x["doc_id"].alias("doc_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["p"] - moved / x["size"])).alias("p")
        )).otherwise(F.struct(
            r["size"].alias("size"), r["doc_id"].alias("doc_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["p"] + moved / r["size"])).alias("p")
        ))
        first = r["p"].isNull()
        rest = F.when(first, F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["p"].alias("p"))).otherwise(stays)
        out = F.when(first, state["done"]).otherwise(F.concat(state["done"], F.array(ended)))
        return F.struct(rest.cast(item).alias("rest"), out.cast(done).alias("done"))

    start = F.struct(F.lit(None).cast(item).alias("rest"), F.array().cast(done).alias("done"))
    return start, step


def _level(items: DataFrame, level: int, seed: int, id_type: str) -> DataFrame:
    """Fold the groups of one level: source, groups, rest (the fraction left) and done (the bits)."""
    group = F.pmod(F.xxhash64(F.lit(seed + level), "source", F.col("doc_id").cast("string"), "size"), F.col("groups"))
    cells = items.groupBy("source", group.alias("group")).agg(
        F.max("groups").alias("groups"), F.sort_array(F.collect_list(F.struct("size", "doc_id", "p")), asc=False).alias("all")
    )
    start, step = _meet(id_type, F.lit(seed))
    return cells.select("source", "groups", F.aggregate("all", start, step).alias("fold")).select("source", "groups", "fold.*")


def decide(items: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """Copies per distinct (source, doc_id, size): those columns, n, source_size, target, copies (of all n rows)."""
    items = checkpointed(items)
    per_source = checkpointed(targets(items, weights, cap))
    id_type = dict(items.dtypes)["doc_id"]
    joined = match(items, bounded(per_source), ["source"])
    wanted = F.when(F.col("size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = checkpointed(
        joined.withColumn("wanted", wanted).withColumn("whole", F.floor("wanted"))
        .withColumn("p", F.col("wanted") - F.col("whole"))
    )
    level, bits = 0, None
    open_items = joined.filter("size > 0").select(
        "source", "size", "doc_id", "p", F.greatest(F.lit(1), F.ceil(F.col("entries") / FAN_IN)).cast("long").alias("groups")
    )
    last = None
    while True:
        folded = checkpointed(_level(open_items, level, seed, id_type))
        ended = folded.select("source", F.explode("done").alias("d")).select("source", "d.*")
        bits = ended if bits is None else bits.unionByName(ended)
        closing = folded.filter("groups = 1").select("source", "rest.*")
        last = closing if last is None else last.unionByName(closing)
        open_items = folded.filter("groups > 1").select(
            "source", "rest.*", F.ceil(F.col("groups") / FAN_IN).cast("long").alias("groups")
        )
        if not open_items.take(1):
            break
        level += 1
    closed = bits.unionByName(_close(bits, last))
    # The closing changes come as extra rows of +1 or -1.
    closed = closed.groupBy("source", "doc_id", "size").agg(F.sum("bit").alias("bit"))
    out = match(joined, closed, ["source", "doc_id", "size"], "left")
    return out.select(
        "source", "doc_id", "size", "n", "source_size", "target",
        (F.col("whole") + F.coalesce("bit", F.lit(0))).alias("copies"),
    )


def _close(bits: DataFrame, last: DataFrame, rounds: int = 3) -> DataFrame:
    """Bits of the last fraction of each source, and +1 or -1 for the few documents changed to come nearer."""
    up = F.col("p") >= 0.5
    ends = checkpointed(last.select(
        "source", "doc_id", "size", up.cast("int").alias("bit"), ((up.cast("int") - F.col("p")) * F.col("size")).alias("off")
    ))
    off, out = ends.select("source", "off"), ends.drop("off")
    open_bits, changed = bits.unionByName(out), None
    for _ in range(rounds):
        free = open_bits if changed is None else match(open_bits, bounded(changed), ["source", "doc_id", "size"], "left_anti")
        pairs = match(free, bounded(off), ["source"])
        after = F.col("off") + F.col("size") * (1 - 2 * F.col("bit"))
        best = pairs.groupBy("source").agg(F.min(F.struct(F.abs(after).alias("far"), "size", "doc_id", "bit", after.alias("off"))).alias("b"))
        chosen = checkpointed(match(off, best, ["source"]).filter(F.col("b.far") < F.abs("off")))
        step = chosen.select("source", "b.doc_id", "b.size", (1 - 2 * F.col("b.bit")).alias("bit"))
        out = out.unionByName(step)
        names = step.drop("bit")
        changed = names if changed is None else changed.unionByName(names)
        off = chosen.select("source", "b.off")
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words, repeats counted)."""
    made = decide(sizes(docs, id_col, text_col, source_col), weights, cap, seed)
    # Number the identical rows of an entry; in two steps, so that no cell holds them all.
    strides = made.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRIDE).cast("long"))).alias("first"))
    rows = strides.select("*", F.explode(
        F.sequence("first", F.least(F.col("first") + STRIDE, F.col("n")) - 1)
    ).alias("i"))
    copies = _copies_of(F.col("i"), F.col("copies"), F.col("n"))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                       (copies * F.col("size")).alias("taken"))


def _copies_of(i: Column, copies: Column, n: Column) -> Column:
    """Copies of the i-th of n identical rows that get ``copies`` together."""
    each = F.floor(copies / n).cast("long")
    return (each + (i < copies - each * n).cast("long")).cast("long")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights=WEIGHTS, cap: int = CAP, seed: int = 7) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it, all columns kept."""
    names = docs.columns
    docs, (id_col, text_col, source_col) = plain_names(docs, id_col, text_col, source_col)
    made = checkpointed(decide(sizes(docs, id_col, text_col, source_col), weights, cap, seed))
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    keyed = docs.withColumns({"__source": F.col(source_col), "__doc": F.col(id_col), "__size": words})
    taken = made.filter("copies > 0").select(
        F.col("source").alias("__source"), F.col("doc_id").alias("__doc"), F.col("size").alias("__size"),
        F.col("n").alias("__n"), F.col("copies").alias("__copies"),
    )
    on = ["__source", "__doc", "__size"]
    out = match(keyed, bounded(taken.filter("__n = 1")), on).drop("__n")
    twins = taken.filter("__n > 1")
    if twins.take(1):
        # Identical rows are told apart by their other columns' hash, then by place.
        numbered = match(keyed, twins, on).withColumn(
            "__i", F.row_number().over(Window.partitionBy(*on).orderBy(F.xxhash64(F.col(text_col)))) - 1
        )
        shared = _copies_of(F.col("__i"), F.col("__copies"), F.col("__n"))
        out = out.unionByName(numbered.withColumn("__copies", shared).filter("__copies > 0").drop("__n", "__i"))
    # The largest number of copies of one row is the cap.
    return out.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).drop(
        *on, "__copies", "__again"
    ).toDF(*names)
