"""Near-duplicate removal that keeps the documents' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedup_minhash import grouped, text_hash
from .rowwise import row_hash
from .runtime import cut
from .sieve import anti, split


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, rows_per_band: int = 4) -> DataFrame:
    """One document of each near-duplicate group, with the columns it had.

    It is the row of the smallest ``(doc_id, hash of the text)``; of rows equal
    in both, that of the smallest hash of the whole row.  Rows are what is
    judged: a text unlike all others stays, whatever other rows bear its id.

    Defined results: rows with a null doc_id, and texts without words (null,
    empty or blank), stay; an empty table stays empty; other columns, whatever
    their names, come through as they are.
    """
    seen = cut(grouped(docs, width, percent, rows_per_band, same_id=False).where("doc_id is not null and n_shingles > 0").select("doc_id", "text_hash", "kept"), "kept")
    keys = [F.col("doc_id"), text_hash(docs["text"])]
    out = anti(docs, seen.where("not kept").select("doc_id", "text_hash"), keys)
    twice = cut(seen.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "repeated")
    if twice.isEmpty():
        return out
    clear, maybe = split(out, twice, [F.col("doc_id"), text_hash(out["text"])])
    equal = Window.partitionBy("k0", "k1").orderBy("hash")
    named = twice.select(F.col("doc_id").alias("k0"), F.col("text_hash").alias("k1"))
    hashed = maybe.withColumn("hash", row_hash(docs, "row"))
    first = hashed.join(named, ["k0", "k1"], "left_semi").withColumn("nth", F.row_number().over(equal)).where("nth = 1")
    return clear.unionByName(maybe.join(named, ["k0", "k1"], "left_anti").select("row")).unionByName(first.select("row")).select("row.*")
