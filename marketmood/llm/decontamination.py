"""Benchmark decontamination: size-partitioned MinHash containment search, natively in Spark SQL.

Texts become lower-case words (runs of letters and digits). Items become
five-word shingles; an item of one to four words is one shingle of its width.
Documents are looked through at width five and at each width that such a short
item has, so short items are found inside documents of any length. An item of q
distinct shingles is contained in a document that has at least ``need`` =
ceil(t q) of them, t being 0.8.

Items are partitioned by size: those of one size share ``need`` and the length
of their sketch, the q - need + 1 shingles with the smallest MinHash values. A
document that lacks all of these lacks too many shingles, so a document that
contains the item always meets its sketch: unlike banded signatures, whose
chance of meeting falls with the document's length, no containment is missed
however long the document. Documents with fewer shingles than an item's size
class needs are no candidates. Candidates are then verified by counting the item's
distinct shingles in the document, as strings.

A document is its id and text: rows that repeat both count once, rows with one
id and different texts are judged each, and a null id is kept as null. Rows of
one item id are united. Items without an id have no row in a list of pairs, as
in the SQL, but documents that contain them are dropped. Null texts, empty texts and texts without letters or
digits contain nothing and are contained nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketmood.llm.common import broadcast_if_small, free_name, read_table, stored

WIDTH = 5
THRESHOLD = 0.8


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _runs(width: int) -> Column:
    """All runs of ``width`` words of the array ``ws`` as structs w0 to w4, null beyond the width; none if there are fewer words."""
    count, none = F.greatest(F.col("n") - (width - 1), F.lit(0)), F.array().cast("array<string>")
    return F.arrays_zip(*[(F.slice("ws", k + 1, count) if k < width else none).alias(f"w{k}") for k in range(WIDTH)])


def _shingles(df: DataFrame, text: str, keep: list[str], widths: list[int] | None = None) -> DataFrame:
    """A row for each shingle with ``n`` words in its text and ``most`` shingles.

    With ``widths`` all runs of these widths; without, runs of five words, or
    one of all words of a shorter text.
    """
    n = F.col("n")
    if widths is None:
        most, runs = F.greatest(n - (WIDTH - 1), F.lit(1)), F.when(n >= WIDTH, _runs(WIDTH))
        for width in range(1, WIDTH):
            runs = runs.when(n == width, _runs(width))
    else:
        most = sum((F.greatest(n - (w - 1), F.lit(0)) for w in widths), F.lit(0))
        runs = F.when(n >= widths[0], _runs(widths[0]) if len(widths) == 1 else F.concat(*[_runs(w) for w in widths]))
    return (df.select(*keep, words(F.col(text)).alias("ws")).withColumn("n", F.size("ws")).filter("n > 0")
            .select(*keep, "n", most.alias("most"), F.inline(runs)))


PARTS = [f"w{k}" for k in range(WIDTH)]


def minhash() -> Column:
    """The one hash permutation of the search, over a shingle's words."""
    return F.xxhash64(*PARTS)


def joined() -> Column:
    return F.concat_ws(" ", *PARTS)


def item_shingles(items: DataFrame, text: str, id_col: str, threshold: float) -> DataFrame:
    """Distinct shingles of each item with its size q, what it needs and the rank of its MinHash value."""
    from pyspark.sql import Window
    own = (_shingles(items.select(F.col(id_col).alias("item_id"), F.col(text).alias("t")), "t", ["item_id"])
           .filter("item_id IS NOT NULL")
           .select("item_id", joined().alias("shingle"), minhash().alias("h"), F.least("n", F.lit(WIDTH)).alias("width")).distinct())
    by_item = Window.partitionBy("item_id")
    return (own.withColumn("q", F.count(F.lit(1)).over(by_item))
            .withColumn("need", F.ceil(F.col("q") * F.lit(threshold) - F.lit(1e-9)).cast("long"))
            .withColumn("rank", F.row_number().over(by_item.orderBy("h", "shingle"))))


def contained_items(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id",
                    item_text: str = "text", item_id: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """``(row_key, doc_id, item_id, n_item, hits, containment)`` for each document and item it contains.

    ``row_key`` is a hash of id and text. Empty tables give an empty result.
    """
    item = stored(item_shingles(items, item_text, item_id, threshold), "items")
    widths = sorted(r["width"] for r in item.select("width").distinct().collect())  # at most five
    if not widths:
        widths = [WIDTH]
    sketch = item.filter(F.col("rank") <= F.col("q") - F.col("need") + 1).select("h", "item_id", "need")
    sketch = stored(sketch, "sketches")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"),
                        F.xxhash64(F.col(id_col), F.col(text)).alias("row_key"))
    probes = _shingles(keyed, "t", ["row_key"], widths).select("row_key", "most", minhash().alias("h"))
    candidates = stored(probes.join(broadcast_if_small(sketch), "h").filter("most >= need")
                        .select("row_key", "item_id").distinct(), "candidates")

    chosen = stored(candidates.select("row_key").distinct(), "candidate-docs")
    texts = keyed.join(broadcast_if_small(chosen), "row_key", "left_semi")
    found = (_shingles(texts, "t", ["row_key", "doc_id"], widths).select("row_key", "doc_id", joined().alias("shingle"))
             .join(broadcast_if_small(item.select("shingle", "item_id", "q", "need")), "shingle")
             .join(candidates, ["row_key", "item_id"], "left_semi").distinct())
    return (found.groupBy("row_key", "doc_id", "item_id", "q", "need").agg(F.count(F.lit(1)).alias("hits"))
            .filter("hits >= need")
            .select("row_key", "doc_id", "item_id", F.col("q").alias("n_item"), "hits",
                    (F.col("hits") / F.col("q")).alias("containment")))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that contain no item, with all their columns.

    Items without an id count as well, each text as an item of its own.
    """
    own_id = F.coalesce(F.concat(F.lit("id:"), F.col("item_id").cast("string")), F.concat(F.lit("text:"), F.sha2("text", 256)))
    named = items.select(own_id.alias("item_id"), "text")
    bad = stored(contained_items(docs, named, text, id_col).select("row_key").distinct(), "contaminated")
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text)))
    return keyed.join(broadcast_if_small(bad), keyed[key] == bad["row_key"], "left_anti").drop(key)


def op7_decontamination(spark, sf_dir) -> DataFrame:
    return contained_items(read_table(spark, sf_dir, "documents"),
                           read_table(spark, sf_dir, "benchmark")).drop("row_key")


OP7_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
ir AS (SELECT item_id, ws, least(len(ws), 5) AS width, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM iw WHERE len(ws) > 0),
item AS (SELECT DISTINCT item_id, width, array_to_string(list_slice(ws, i, i + width - 1), ' ') AS shingle FROM ir),
sizes AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY 1),
dr AS (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS i FROM dw, (SELECT DISTINCT width FROM item)),
doc AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + width - 1), ' ') AS shingle FROM dr),
hits AS (SELECT doc_id, item_id, count(*) AS hits FROM doc JOIN item USING (shingle) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, hits, hits / n_item AS containment
FROM hits JOIN sizes USING (item_id) WHERE hits >= ceil(n_item * 0.8 - 1e-9)
"""
