"""Incremental embedding by key: a node is embedded when its text is new or has changed, once, however often it comes.

The state is a table: for each node id the newest version and the SHA-256 of the text that was last sent to the embedder. A row whose text has that
hash is a repeat and passes by, but for its version; one of an older version is late and passes by; of several rows of a node in one batch the newest counts (ties: the greatest
text). Each micro-batch is joined with the state of the batch before and writes the next one under its own number, so a batch that runs again replaces its own
output; no Python runs for each node. What is left is embedded and written under that number, too.
`current` is the upserted view: of each node the vector of the last batch that has one. Texts that fail are written to a folder that the stream
itself reads when it is started again, and are then tried again though their hash is known.

Columns: id string, text string, version long (null counts as 0). Null ids and empty texts pass by. A batch reads and writes the whole state,
so batches should be large beside it (`files_per_batch`). Checkpoints of the state-store form before can't be gone on with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.embeddings import Embedder, embed
from ..sources.shared import Files

NODES, STATE = "id string, text string, version long", "id string, version long, digest string"
RETRY = "id string, text string, version long, again boolean"
#: What a batch writes: the state after it, and text and asked (its version) of nodes that are to be embedded.
NEXT = f"{STATE}, text string, asked long"


def next_state(rows: DataFrame, known: DataFrame) -> DataFrame:
    """NEXT, of the rows of a batch (id, text, version, again) and the STATE before it."""
    usable = rows.where("id is not null and coalesce(text, '') <> ''").select(
        "id", "text", F.coalesce("version", F.lit(0)).cast("long").alias("version"), F.coalesce("again", F.lit(False)).alias("again"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    )
    before = known.select(F.col("id").alias("of"), F.col("version").alias("known_version"), F.col("digest").alias("known"))
    both = usable.join(before, F.col("id") == F.col("of"), "full")
    # Late rows, and texts that failed and have changed since, pass by.
    counts = F.when(F.col("known").isNull(), F.col("id").isNotNull()).when(F.col("again"), F.col("digest") == F.col("known")).otherwise(F.col("version") >= F.col("known_version"))
    best = F.max(F.when(counts, F.struct("version", "text", "digest"))).alias("best")
    failed = F.coalesce(F.max(F.col("again") & (F.col("digest") == F.col("known"))), F.lit(False)).alias("failed")
    each = both.groupBy(F.coalesce("id", "of").alias("id")).agg(best, failed, F.max("known_version").alias("known_version"), F.max("known").alias("known"))
    repeat = F.coalesce(F.col("best.digest") == F.col("known"), F.lit(False))
    asked = F.col("best").isNotNull() & (~repeat | F.col("failed"))
    # A repeat moves the version on: what is older than it is late from now on.
    version = F.when(F.col("best").isNull(), F.col("known_version")).when(repeat, F.greatest("best.version", "known_version")).otherwise(F.col("best.version"))
    return each.select("id", version.alias("version"), F.coalesce("best.digest", "known").alias("digest"), F.when(asked, F.col("best.text")).alias("text"), F.when(asked, F.col("best.version")).alias("asked"))


def run(spark: SparkSession, source: str, out: str, embedder: Embedder, files_per_batch: int = 100, **more) -> StreamingQuery:
    """Embeds what is new in the Parquet files of `source` (NODES) and ends when all of it has been read. <out> holds vectors, retry, state and
    checkpoint; `more` goes to `embed`."""
    spark.createDataFrame([], RETRY).write.mode("append").parquet(f"{out}/retry")
    fresh = spark.readStream.schema(NODES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    failed = spark.readStream.schema(RETRY).parquet(f"{out}/retry")
    both = fresh.select("*", F.lit(False).alias("again")).unionByName(failed)

    def step(batch: DataFrame, number: int) -> None:
        at = f"{out}/vectors/batch={number}"
        session, files = batch.sparkSession, Files(spark, out)
        written = [int(name.removeprefix("batch=")) for name in files.names(f"{out}/state")]
        last = max((n for n in written if n < number), default=None)
        known = session.createDataFrame([], STATE) if last is None else session.read.schema(STATE).parquet(f"{out}/state/batch={last}")
        next_state(batch, known).write.mode("overwrite").parquet(f"{out}/state/batch={number}")
        for n in written:
            if last is not None and n < last:  # a batch that runs again needs the state before it, no older one
                files.delete(f"{out}/state/batch={n}")
        asked = session.read.schema(NEXT).parquet(f"{out}/state/batch={number}").where("asked is not null").select("id", "text", F.col("asked").alias("version"), "digest")
        made = embed(asked, embedder, **more)
        asked = asked.withColumnRenamed("id", "of")
        made.join(asked, F.col("id") == F.col("of")).select("id", "embedding", "error", "digest", "version", "text").write.mode("overwrite").parquet(at)
        lost = session.read.parquet(at).where("embedding is null").select("id", "text", "version", F.lit(True).alias("again"))
        if not lost.isEmpty():
            lost.write.mode("append").parquet(f"{out}/retry")

    return both.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """id, embedding, digest, version: of each node the last vector."""
    rows = spark.read.option("basePath", f"{out}/vectors").parquet(f"{out}/vectors").where("embedding is not null")
    last = rows.groupBy("id").agg(F.max_by(F.struct("embedding", "digest", "version"), "batch").alias("v"))
    return last.select("id", "v.*")
