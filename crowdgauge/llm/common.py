"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting gets a folder of its own; elsewhere a machine-local
    folder would be lost with its executor, so a missing setting is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="crowdgauge-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and a lost executor costs no
    recomputation of what came before."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names: other columns, whatever they are
    called, never meet the operator's own. Null text is empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILTER_MOST = 1 << 28  # bits of the largest filter that is broadcast: 32 MB


def filter_table(ids: DataFrame) -> tuple[DataFrame, int] | None:
    """((bucket, words), bits) with 16 to 32 bits for each id of the table ``ids``, or None if that is more than a broadcast may hold."""
    bits = 1 << max(15, (16 * ids.count()).bit_length())
    if bits > FILTER_MOST:
        return None
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(place.alias("place")).groupBy(F.expr("shiftright(place, 15)").alias("bucket"), F.expr("cast(shiftright(place, 6) & 511 AS int)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("w"))
    by_bucket = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "w"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return by_bucket.select("bucket", every.alias("words")), bits


def split_by_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows surely not among ``ids``, rows that may be), by a filter whose size follows the number of ids: of the two only the second,
    as large as ``ids`` and a little more, needs a join by id. Beyond what may be broadcast all rows may be among them.
    Rows with a null id are among the first."""
    found = filter_table(ids.select(F.col(ids.columns[0]).cast("long").alias("id")).filter("id is not null"))
    if found is None:
        return docs.filter(F.col(id_col).isNull()), docs.filter(F.col(id_col).isNotNull())
    table, bits = found
    row, hit, held = (f"{n}_{uuid.uuid4().hex}" for n in ("place", "hit", "held"))
    table = F.broadcast(table.select(F.col("bucket").alias(hit), F.col("words").alias(held)))
    placed = docs.withColumn(row, F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(bits)))
    joined = placed.join(table, F.shiftright(placed[row], 15) == table[hit], "left")
    word = F.get(F.col(held), F.shiftright(F.col(row), 6).bitwiseAND(F.lit(511)).cast("int"))
    bit = F.coalesce(F.getbit(word, F.col(row).bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False)) & F.col(id_col).isNotNull()
    return tuple(joined.filter(c).select(*docs.columns) for c in (~bit, bit))


def arrow_schema(ddl: str):
    """The Arrow schema that ``mapInArrow`` results of this DDL must have."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def batch_of(schema, columns: list[list]):
    """A record batch from Python columns; integers keep all their digits, nulls stay null."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def filtered(docs: DataFrame, text_col: str, decider: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of ``docs`` whose texts a decider keeps, with all columns as they are. ``decider`` is called once per task and
    gives a function of a list of texts; null texts are passed as empty."""
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        from crowdgauge.llm.memo import held

        held(None)
        decide = decider()
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                yield part.filter(pa.array(decide([t or "" for t in part.column(place).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
