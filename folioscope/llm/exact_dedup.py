"""Exact duplicates through an extendible-hash index on shared files.

A key is a 64-bit hash of the text. The directory says which leading bits of a key select its
bucket: it starts at the depth that the number of keys asks for, and while a bucket holds more
than ``capacity`` keys the directory doubles and that bucket is split by one more bit, as deep as
keys go. Slots that share a bucket are one row of the directory (depth, leading bits), so a lookup
tries the few depths that occur and a doubling copies nothing.

Owner tasks hold contiguous ranges of keys. An owner gets the texts of its range that share a key
with another row, walks each key's chain in byte order and starts a new entry wherever two
neighbours differ, so texts are told apart by their bytes. The index (bucket, key, chain length,
group) is written to shared files. Rows are then looked up through the directory: a key whose
chain has one entry has one text; under a key with several the row's bytes are compared with each.

The main path uses DataFrame functions only. No key is gathered in one task: group sizes are
partially aggregated, the texts of the most frequent keys are thinned out by each map task before
they go to their owner, and their index entries are broadcast to the rows.

Defined cases: a null text counts as the empty text; null ids lose against any id, and a group of
null ids alone has a null keeper; of rows that repeat the keeper's id and text exactly one is kept;
an empty table gives an empty result; texts may be of any length and are compared whole; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.runtime import LISTED, discard, documents, durable, small, spread_join, unused

CAPACITY = 4096
#: The most frequent keys whose texts are thinned out, and what is left of a text: one row each.
THINNED, SPREAD = 1 << 16, 16


def leading(key: str, depth: int) -> Column:
    """The first bits of a key as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, list[int]]:
    """The directory of distinct keys, (depth, slot, keys, bucket), and the depths that occur.

    slot holds the leading bits, bucket is the first key of the bucket's range. A bucket has at
    most ``capacity`` keys; each doubling looks at the overfull buckets alone.
    """
    depth = max(0, (keys.count() // capacity).bit_length() - 1)
    parts: list[DataFrame] = []
    levels: list[DataFrame] = []
    full = None
    while True:
        slots = keys.groupBy(leading("key", depth).alias("slot")).agg(F.count(F.lit(1)).alias("keys"))
        if full is not None:
            slots = slots.withColumn("parent", F.shiftrightunsigned("slot", 1)).join(full.select(F.col("slot").alias("parent")), "parent", "left_semi").drop("parent")
        first = F.shiftleft("slot", 64 - depth) if depth else F.lit(0).cast("bigint")
        slots = durable(slots.select(F.lit(depth).alias("depth"), "slot", "keys", first.alias("bucket")), "exact-dedup-slots")
        levels.append(slots)
        parts.append(slots.where(F.col("keys") <= capacity))
        full = slots.where(F.col("keys") > capacity)
        if full.isEmpty():
            break
        depth += 1
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = durable(whole, "exact-dedup-directory")
    discard(*levels)
    return whole, sorted(r["depth"] for r in whole.select("depth").distinct().collect()) or [0]  # 65 depths at most


def looked_up(rows: DataFrame, directory: DataFrame, depths: list[int]) -> DataFrame:
    """rows (with key) with the bucket that the directory gives them."""
    tries = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), leading("key", d).alias("slot")) for d in depths]))
    tried = rows.select("*", tries.alias("_try")).select(*rows.columns, F.col("_try.depth").alias("depth"), F.col("_try.slot").alias("slot"))
    return tried.join(small(directory.select("depth", "slot", "bucket")), ["depth", "slot"]).drop("depth", "slot")


def chains(texts: DataFrame, counted: DataFrame, span: int, listed: int) -> DataFrame:
    """(key, chain, length, body) of every key that several rows have: an entry for each different
    text in byte order, with its bytes if there are several. Keys that one row has need no comparing.
    """
    spark = texts.sparkSession
    shared = durable(counted.where("n > 1").select("key", "n"), "exact-dedup-shared")
    if shared.limit(listed + 1).count() <= listed:
        texts = texts.join(F.broadcast(shared.select("key")), "key", "left_semi")
    often = F.broadcast(shared.where(F.col("n") > SPREAD).orderBy(F.desc("n"), "key").limit(THINNED).select("key"))
    thinned = texts.join(often, "key", "left_semi").withColumn("task", F.pmod(F.spark_partition_id(), F.lit(SPREAD))).distinct().drop("task")
    every = texts.join(often, "key", "left_anti").unionByName(thinned)
    # Owners divide the slots of the least depth, so a bucket has one owner.
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owner = (leading("key", span).cast("decimal(38,0)") * owners / F.lit(1 << span).cast("decimal(38,0)")).cast("int") if span > 30 else F.shiftright(leading("key", span) * owners, span).cast("int")
    owned = every.withColumn("owner", owner).repartitionById(owners, F.col("owner"))
    walk = Window.partitionBy("owner", "key").orderBy("body")
    marked = owned.withColumn("before", F.lag("body").over(walk)).withColumn("chain", F.dense_rank().over(walk))
    entries = marked.withColumn("length", F.max("chain").over(Window.partitionBy("owner", "key"))).where(F.col("before").isNull() | (F.col("before") != F.col("body")))
    found = durable(entries.select("key", "chain", "length", F.when(F.col("length") > 1, F.col("body")).alias("body")), "exact-dedup-chains")
    discard(shared)
    return found


def told_apart(rows: DataFrame, entries: DataFrame, listed: int) -> DataFrame:
    """(row, id, key, text_sha256, chain, n, top) of rows whose key several texts have: each row's
    bytes are compared with those of its key's entries, which are spread so a frequent text is not
    gathered in one task."""
    keys = entries.select("key").distinct()
    own = rows.join(small(keys, listed), "key", "left_semi").withColumn("spread", F.pmod("row", F.lit(SPREAD)))
    side = entries.select("key", "chain", F.col("body").alias("entry"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    found = own.join(side.withColumn("spread", F.col("spread").cast("bigint")).hint("merge"), ["key", "spread"]).where(F.col("body") == F.col("entry"))
    found = durable(found.select("row", "id", "key", F.sha2("body", 256).alias("text_sha256"), "chain"), "exact-dedup-told")
    groups = found.groupBy("key", "chain").agg(F.count(F.lit(1)).alias("n"), _top())
    return spread_join(found, durable(groups.withColumn("weight", F.col("n")), "exact-dedup-groups"), ["key", "chain"], "weight")


def _top() -> Column:
    """The row that is kept: the largest id, of equal ones the first row."""
    return F.max(F.struct("id", (-F.col("row")).alias("back"))).alias("top")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, key_bits: int = 64, capacity: int = CAPACITY, listed: int = LISTED, row: Column | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, bucket, chain, row.

    ``normalise`` is the compared text as an expression (the text itself if not given). Fewer
    ``key_bits`` only make chains longer, and ``listed`` is the size up to which a counted table is
    broadcast; the result is the same. ``row`` is a stable number of the rows if there is one.
    """
    body = F.coalesce((F.col(text_col) if normalise is None else normalise).cast("string"), F.lit(""))
    key = F.xxhash64("body")
    if key_bits < 64:
        key = F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)
    number = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(number.alias("row"), F.col(id_col).alias("id"), body.alias("body")).withColumn("key", key)
    light = durable(rows.select("row", "id", "key", F.sha2("body", 256).alias("text_sha256")), "exact-dedup-rows")
    counted = durable(light.groupBy("key").agg(F.count(F.lit(1)).alias("n"), _top()), "exact-dedup-keys")
    directory, depths = build_directory(counted.select("key"), capacity)
    entries = chains(rows.select("key", "body"), counted, depths[0], listed)
    lengths = entries.where("chain = 1").select("key", "length")
    with_length = counted.join(lengths, "key", "left").withColumn("length", F.coalesce("length", F.lit(1)))
    index = durable(looked_up(with_length, directory, depths).withColumn("weight", F.col("n")), "exact-dedup-index")
    discard(counted)
    found = spread_join(looked_up(light, directory, depths), index.where("length = 1").drop("length"), ["bucket", "key"], "weight").withColumn("chain", F.lit(1))
    several = entries.where("length > 1")
    if not several.isEmpty():
        apart = told_apart(rows, several, listed)
        found = found.unionByName(looked_up(apart, directory, depths).select(*found.columns))
    keeper = F.col("top.id")
    return found.select(F.col("id").alias(id_col), keeper.alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == -F.col("top.back")).alias("kept"), "text_sha256", "bucket", F.col("chain").cast("int").alias("chain"), "row")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one row of each text.

    What goes is known by id and SHA-256, so no text is written or shuffled for it. Only rows that
    repeat the keeper's id and text can't be told apart so; of these, one of each is taken.
    """
    found = durable(exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias("id"), "text_sha256", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("keeper"), "kept"), "exact-dedup-found")
    gone = durable(found.where("NOT keeper").select("id", "text_sha256").distinct(), "exact-dedup-gone")
    again = durable(found.where("keeper AND NOT kept").select("id", "text_sha256").distinct(), "exact-dedup-again")
    discard(found)
    sha = unused(docs, "text_digest")
    hashed = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))

    def same(side: DataFrame) -> Column:
        return hashed[id_col].eqNullSafe(side["id"]) & (hashed[sha] == side["text_sha256"])

    few = small(gone)
    left = hashed.join(few, same(few), "left_anti")
    if not again.isEmpty():
        twice = small(again)
        single = hashed.join(twice, same(twice), "left_semi").dropDuplicates([id_col, sha])
        left = left.join(twice, left[id_col].eqNullSafe(twice["id"]) & (left[sha] == twice["text_sha256"]), "left_anti").unionByName(single)
    return left.drop(sha)


def op6(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
