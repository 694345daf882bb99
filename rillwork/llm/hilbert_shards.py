"""Operator 5: shards cut from the order of a Hilbert curve over metadata.

Each dimension is quantised to ``bits`` bits, a row's cell gets its index on the
Hilbert curve, rows are sorted by it, and the sorted run is cut into shards.
Rows that are near in every dimension share a shard and a row group, so files
can be pruned by any of the dimensions. Only DataFrame functions are used.

The law is ``rows``: shard counts differ by one at most, whatever the sizes.

Cases: a null text has size 1 and the CRC of no bytes; a null in a dimension
counts as its lowest cell; equal rows lie side by side; an empty table gives an
empty table; columns of other names are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import numbered, place_of, settle, shuffle_partitions


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a cell with ``bits`` bits in each dimension.

    Skilling's transform as folds over (bit, dimension), so that no expression
    is written out twice: undo the curve's turns from the highest bit, decode
    the Gray code, interleave.
    """
    n, zero = len(cells), F.lit(0).cast("long")

    def steps(lowest: int) -> Column:
        return F.array(
            *[
                F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i"))
                for b in range(bits - 1, lowest - 1, -1)
                for i in range(n)
            ]
        )

    def turn(x: Column, step: Column) -> Column:
        first, own, low = x[0], F.get(x, step["i"]), step["q"] - 1
        hit = own.bitwiseAND(step["q"]) != 0
        flip = F.when(hit, low).otherwise(zero)
        swap = F.when(hit, zero).otherwise(first.bitwiseXOR(own).bitwiseAND(low))
        return F.transform(
            x,
            lambda v, j: v.bitwiseXOR(F.when(j == 0, flip).otherwise(zero)).bitwiseXOR(
                F.when((j == 0) | (j == step["i"]), swap).otherwise(zero)
            ),
        )

    def gray(x: Column) -> Column:
        return F.aggregate(
            F.slice(x, 2, n - 1),
            F.slice(x, 1, 1),
            lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.element_at(acc, -1)))),
        )

    def interleaved(g: Column) -> Column:
        tail = F.aggregate(
            F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]),
            zero,
            lambda acc, q: F.when(F.element_at(g, -1).bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc),
        )
        return F.aggregate(
            steps(0),
            F.struct(zero.alias("h"), tail.alias("t")),
            lambda acc, step: F.struct(
                (
                    acc["h"] * 2
                    + F.when(F.get(g, step["i"]).bitwiseXOR(acc["t"]).bitwiseAND(step["q"]) != 0, 1).otherwise(0)
                ).alias("h"),
                acc["t"].alias("t"),
            ),
            lambda acc: acc["h"],
        )

    point = F.array(*[c.cast("long") for c in cells])
    decoded = gray(F.aggregate(steps(1), point, turn)) if bits > 1 else gray(point)
    return F.transform(F.array(decoded), interleaved)[0]


def hilbert_shards(
    df: DataFrame,
    shards: int = 16,
    bits: int = 5,
    dimensions: list[Column] | None = None,
) -> DataFrame:
    """Deal ``df`` (doc_id, text, lang, source) to ``shards`` shards; one row for each row.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert.
    ``dimensions``: columns already quantised to 0 .. 2 ** bits - 1. Default:
    source and language by hash cell, and the size by half powers of two.
    """
    spark, side = df.sparkSession, 1 << bits
    plain = numbered(df.select("*", *(dimensions or [])))
    name = lambda column: f"c{place_of(df, column)}"
    text = F.coalesce(F.col(name("text")), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    if dimensions:
        cells = [F.col(f"c{len(df.columns) + k}") for k in range(len(dimensions))]
    else:
        cells = [
            F.coalesce(F.pmod(F.xxhash64(name("source")), F.lit(side - 1)) + 1, F.lit(0)).cast("long"),
            F.coalesce(F.pmod(F.xxhash64(name("lang")), F.lit(side - 1)) + 1, F.lit(0)).cast("long"),
            F.least(F.floor(F.log2(size.cast("double")) * 2), F.lit(side - 1)).cast("long"),
        ]
    cells = [F.when(c.isNull(), F.lit(0)).otherwise(c) for c in cells]
    rows = plain.select(
        F.col(name("doc_id")).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        hilbert_index(cells, bits).alias("hilbert"),
    )
    parts = shuffle_partitions(spark)
    # The hash spreads a cell that holds many rows over several ranges.
    spread = F.xxhash64("doc_id", "text_crc32")
    in_order = (
        rows.withColumn("_s", spread)
        .repartitionByRange(parts, "hilbert", "_s", "doc_id")
        .sortWithinPartitions("hilbert", "_s", "doc_id")
        .withColumn("_m", F.monotonically_increasing_id())
    )
    placed = settle(in_order, "hilbert").withColumn("_p", F.shiftright("_m", 33))
    counts = placed.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect()  # a row for each partition
    total, before, bases = 0, 0, []
    for r in counts:
        bases.append((r["_p"], before))
        before += r["n"]
    total = before
    table = spark.createDataFrame(bases or [(0, 0)], "_p long, _base long")
    rank = F.col("_base") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    few, more = divmod(total, shards)
    edge = more * (few + 1)  # the first `more` shards hold one row more
    shard = F.when(F.col("_k") < edge, F.floor(F.col("_k") / (few + 1))).otherwise(
        more + F.floor((F.col("_k") - edge) / max(few, 1))
    )
    slot = F.when(F.col("_k") < edge, F.pmod("_k", F.lit(few + 1))).otherwise(
        F.pmod(F.col("_k") - edge, F.lit(max(few, 1)))
    )
    return (
        placed.join(F.broadcast(table), "_p")  # a row for each shuffle partition
        .withColumn("_k", rank)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            shard.cast("int").alias("shard"),
            slot.cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "hilbert",
        )
    )


def write_shards(dealt: DataFrame, path: str, tasks: int | None = None) -> None:
    """Write dealt rows as one folder for each shard, in curve order within each file.

    ``tasks`` of them (the shuffle's number by default) each take one run of the
    order, so that a large shard is written by many, as files that follow each other.
    """
    run = dealt.repartitionByRange(tasks or shuffle_partitions(dealt.sparkSession), "shard", "slot")
    run.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
