"""Operator 5, sharding: proportional stratified interleaving, so that every shard has the mixture of all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.common import free_name, quoted, read
from tarnlight.sources.paths import new_path

SHARDS, SEED = 64, 17
#: Above this many rows the table of offsets (one row for each file and source in it) is joined without a broadcast.
BROADCAST_ROWS = 200_000
#: With more strata than this a row's place comes from a second sort, not from the sizes of all strata.
GRID_STRATA = 500


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, stratum: str = "source", row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of docs, with the columns shard (0 to shards - 1) and shard_row (0, 1, ... in its shard).

    Within each stratum rows are ranked 1 to n by md5 of the seed and row_id, ties by row_id and md5 of the text. All rows are
    then ordered by their fractional rank (rank - 1/2) / n, ties by stratum (null first), and cut into shards whose sizes differ
    by one row at most. A null stratum is one of its own; null ids come first among ties; rows that are equal in all of these
    are interchangeable. Texts may be null, empty or of any length: only their digest counts. Columns of docs named shard or shard_row keep their names, the new ones then get underscores before them.

    The ranks come from one range shuffle written to the shared folder: a row's rank is its place in its file plus the rows
    of its stratum in the files before. Fractional ranks of a stratum lie on an even grid, so the place of a row among all rows
    follows from the sizes of the strata alone, in whole numbers, with no second sort; each row costs one step a stratum. With
    very many strata, such as hosts, a second range shuffle by fractional rank gives the same places.
    """
    spark = docs.sparkSession
    inner = ("rank_key", "rank_tie", "file_name", "file_row", "offset_file", "offset_stratum", "offset_base", "size_stratum", "stratum_place", "stratum_rows", "odd_rank", "all_strata", "nth_row")
    n = {x: free_name(docs, x) for x in ("shard", "shard_row", *inner)}
    key, tie = n["rank_key"], n["rank_tie"]
    keyed = docs.withColumn(key, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(row_id).cast("string"), F.lit(""))))).withColumn(tie, F.md5(quoted(text)))
    order = [quoted(stratum), F.col(key), quoted(row_id), F.col(tie)]
    path = new_path(spark, "ranked")
    keyed.repartitionByRange(*order[:3]).sortWithinPartitions(*order).write.parquet(path)
    placed = spark.read.schema(keyed.schema).parquet(path).select("*", F.col("_metadata.file_path").alias(n["file_name"]), F.col("_metadata.row_index").alias(n["file_row"]))
    parts = placed.groupBy(quoted(n["file_name"]).alias("f"), quoted(stratum).alias("s")).agg(F.min(quoted(n["file_row"])).alias("first"), F.count("*").alias("n"), F.min(quoted(key)).alias("k"), F.min(quoted(row_id)).alias("i")).collect()
    parts.sort(key=lambda p: (p.s is not None, p.s, p.k, p.i is not None, p.i))
    total: dict = {}
    bases = []
    for p in parts:
        bases.append((p.f, p.s, total.get(p.s, 0) - p.first + 1))
        total[p.s] = total.get(p.s, 0) + p.n
    rows = sum(total.values())
    if not rows:
        return docs.withColumns({n["shard"]: F.lit(0).cast("int"), n["shard_row"]: F.lit(0).cast("long")}).limit(0)
    kind = docs.schema[stratum].dataType.simpleString()
    offsets = spark.createDataFrame(bases, f"{n['offset_file']} string, {n['offset_stratum']} {kind}, {n['offset_base']} long")
    sizes = spark.createDataFrame([(i, s, total[s]) for i, s in enumerate(total)], f"{n['stratum_place']} int, {n['size_stratum']} {kind}, {n['stratum_rows']} long")
    if len(bases) <= BROADCAST_ROWS:
        offsets, sizes = F.broadcast(offsets), F.broadcast(sizes)
    joined = placed.join(offsets, (quoted(n["file_name"]) == quoted(n["offset_file"])) & quoted(stratum).eqNullSafe(quoted(n["offset_stratum"]))).join(sizes, quoted(stratum).eqNullSafe(quoted(n["size_stratum"])))
    odd = F.lit(2) * (quoted(n["file_row"]) + quoted(n["offset_base"])).cast("decimal(18,0)") - F.lit(1)
    joined = joined.withColumns({n["odd_rank"]: odd.cast("decimal(19,0)"), n["stratum_rows"]: quoted(n["stratum_rows"]).cast("decimal(18,0)")})
    if len(total) <= GRID_STRATA:
        grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(size).cast("decimal(18,0)").alias("n")) for i, size in enumerate(total.values())])
        # rows of stratum x up to this row: those with (2r' - 1) * own <= (2r - 1) * n', strictly less where x comes later
        joined = joined.withColumn(n["all_strata"], grid)
        upto = F.expr(f"aggregate({n['all_strata']}, 0L, (acc, x) -> acc + (cast(({n['odd_rank']} * x.n - if(x.i > {n['stratum_place']}, 1, 0)) div {n['stratum_rows']} as long) + 1) div 2)")
    else:
        joined, upto = _placed_by_sort(joined.select(*[quoted(c) for c in docs.columns], n["odd_rank"], n["stratum_rows"], n["stratum_place"]), n)
    out = joined.withColumn(n["nth_row"], upto - 1).withColumn(n["shard"], F.expr(f"cast({n['nth_row']} * {shards} div {rows} as int)"))
    first = F.expr(f"(cast({n['shard']} as long) * {rows} + {shards - 1}) div {shards}")
    return out.withColumn(n["shard_row"], quoted(n["nth_row"]) - first).select(*[quoted(c) for c in docs.columns], n["shard"], n["shard_row"])


def _placed_by_sort(rows: DataFrame, n: dict[str, str]) -> tuple[DataFrame, Column]:
    """rows in order of fractional rank, ties by stratum, written in files that follow each other; and each row's place, from 1 on."""
    spark = rows.sparkSession
    order = [(quoted(n["odd_rank"]).cast("double") / (quoted(n["stratum_rows"]).cast("double") * 2)), quoted(n["stratum_place"])]
    path = new_path(spark, "placed")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    back = spark.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_path").alias(n["file_name"]), F.col("_metadata.row_index").alias(n["file_row"]))
    done, bases = 0, []
    for r in sorted(back.groupBy(quoted(n["file_name"]).alias("f")).count().collect(), key=lambda r: r.f):
        bases.append((r.f, done + 1))
        done += r["count"]
    # one row a file
    bases = F.broadcast(spark.createDataFrame(bases, f"{n['offset_file']} string, {n['offset_base']} long"))
    return back.join(bases, quoted(n["file_name"]) == quoted(n["offset_file"])), quoted(n["file_row"]) + quoted(n["offset_base"])


def write_shards(assigned: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The result of assign_shards as Parquet, one folder a shard, rows in their order.

    All rows and columns as they are, null, empty, long or repeated; an empty table gives an empty folder.
    """
    assigned.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "shard_row").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read(spark, sf_dir, "documents"))


SQL = f"""
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat('{SEED}:', doc_id)), doc_id NULLS FIRST, md5(text) NULLS FIRST) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST) - 1 AS nth, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, (nth * {SHARDS} // total)::INTEGER AS shard FROM placed)
SELECT doc_id, text, lang, source, n_chars, shard, (nth - (shard::BIGINT * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS shard_row FROM cut
"""
