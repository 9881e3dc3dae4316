"""Duplicates of new batches against everything accepted so far, from a persisted index.

The index is a folder with two bucketed tables of the accepted rows: ``entries`` (minwise band keys and exact keys, by
key) and ``docs`` (the signature: sketch bits and the word multiset, by document). Files are sorted by what they are
probed by. A batch shuffles only its own rows and meets only the matching buckets; a batch of few keys hands them to
the scan, which then reads only the pages that can hold them. The history is neither recomputed nor shuffled, texts
are not kept, and :meth:`History.open` goes on with an index that another session left. Every append adds a file a
bucket; after COMPACT_AFTER appends the files are merged.

Near-identical requests: both have MIN_WORDS words or more, and the words common to both (with multiplicity) are at
least 80 % of the longer one's. That is a Jaccard similarity of the multisets of 2/3 or more; with 64 bands of 6 minima
a pair at that limit is missed with a chance of 0.3 %, one at 0.77 with less than 1 in 100,000, and every pair found is
verified exactly on the words. For histories far larger than tens of millions of texts, raise ROWS and BANDS together.

Within a batch the order of row ids decides: a row is a case if an accepted row before it matches, else it is accepted.
That is settled in rounds over only those rows that share a key or a near text inside the batch. Where one band key is
held by more than HOT texts of the batch, texts that nothing before them can match are compared first, and what they
catch is no partner any more, so a family of near texts costs its size, not its square.

Defined results: null, empty or unparsable requests and those under MIN_WORDS words match by id and hash only; null ids
and unusable hashes match nothing; equal word multisets are one class, kept once in the index by its first row; rows
without a batch number are in no batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.scratch import discard, forget, new_path, read_text, release, spool, write_text

MIN_WORDS = 20
ROWS, BANDS = 6, 64
SKETCH = 128
#: Sketch bits that must agree before words are compared. At the limit of 2/3 about 106.7 of 128 do (deviation 4.2).
AGREE = 90

#: A batch of so few keys hands them to the index's scan.
FEW_KEYS = 500
#: Rows a page of the index's files, so that such a scan reads little.
PAGE = 20_000
#: Appends after which the index's files are merged.
COMPACT_AFTER = 32
#: Texts of a batch with one band key beyond which the sure ones are settled first.
HOT = 512

FEATURES = "words array<bigint>, s0 bigint, s1 bigint, bands array<bigint>"


def request_of_capture() -> Column:
    """Content of the last user message in the input of the model call with the lowest sequence_index."""
    calls = F.filter(F.arrays_zip(F.col("trace.events.type").alias("t"), F.col("trace.events.sequence_index").alias("i"), F.col("trace.events.input").alias("x")), lambda e: (e["t"] == "model_call") & e["i"].isNotNull())
    first = F.array_min(F.transform(calls, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))["x"]
    said = F.filter(F.from_json(first, "array<struct<role:string,content:string>>"), lambda m: m["role"] == "user")
    return F.try_element_at(said, F.lit(-1))["content"]


def usable_hash(text: Column) -> Column:
    """The 64 hex digits of a usable hash, else null."""
    bare = F.regexp_replace(F.lower(text), "^sha256:", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$") & ~bare.rlike("^0+$"), bare)


def rows_of(golden: DataFrame, captures: DataFrame) -> DataFrame:
    """Both tables as row_id, batch_no, own_id, hash, request."""
    g = golden.select(F.col("row_id").cast("bigint").alias("row_id"), "batch_no", F.concat(F.lit("g:"), "id").alias("own_id"), F.lit(None).cast("string").alias("hash"), F.get_json_object("inputs", "$.query").alias("request"))
    c = captures.select(F.col("row_id").cast("bigint").alias("row_id"), "batch_no", F.concat(F.lit("c:"), "capture_id").alias("own_id"), F.concat(F.lit("h:"), usable_hash(F.col("input_hash"))).alias("hash"), request_of_capture().alias("request"))
    return g.unionByName(c)


def _multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def feature_parts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Of each request the word multiset (sorted, the k-th of a word as an element of its own), the sketch and the band
    keys: ROWS minima each, mixed with the number of the band. The sketch is one bit of some of the same minima."""
    import re
    import unicodedata

    import xxhash

    run = re.compile(r"[^\W_]+")
    a, b = _multipliers(ROWS * BANDS, 7)
    mix, _ = _multipliers(ROWS, 5)
    number = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    sketched = np.arange(SKETCH) * (ROWS * BANDS // SKETCH)
    seen: dict[str, int] = {}
    for part in parts:
        rows = []
        for text in part:
            tokens = run.findall(unicodedata.normalize("NFKC", text).lower()) if text else []
            if len(tokens) < MIN_WORDS:
                rows.append((None, None, None, None))
                continue
            counts: dict[str, int] = {}
            elements = np.empty(len(tokens), np.uint64)
            for i, token in enumerate(tokens):
                k = counts[token] = counts.get(token, 0) + 1
                if k == 1:
                    h = seen.get(token)
                    if h is None:
                        if len(seen) > 200_000:
                            seen.clear()
                        h = seen[token] = xxhash.xxh64_intdigest(token)
                    elements[i] = h
                else:
                    elements[i] = xxhash.xxh64_intdigest(token, seed=k)
            elements.sort()
            low = _minima(elements, a, b)
            bits = np.packbits(low[sketched] >> np.uint64(63) != 0).view(">i8")
            keys = (low.reshape(BANDS, ROWS) * mix).sum(axis=1, dtype=np.uint64) + number
            rows.append((elements.view(np.int64), int(bits[0]), int(bits[1]), (keys ^ (keys >> np.uint64(29))).view(np.int64)))
        words, s0, s1, bands = zip(*rows) if rows else ((), (), (), ())
        yield pd.DataFrame({"words": words, "s0": pd.array(s0, dtype="Int64"), "s1": pd.array(s1, dtype="Int64"), "bands": bands})


def _minima(elements: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over the elements, mixed once more; long texts go in blocks."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 4096):
        low = np.minimum(low, (elements[at : at + 4096, None] * a[None, :] + b[None, :]).min(axis=0))
    low ^= low >> np.uint64(31)
    return low * np.uint64(0x9E3779B97F4A7C15)


def with_features(rows: DataFrame) -> DataFrame:
    """Rows ready for the index: row_id, batch_no, keys (exact keys as two hashes each), text (the key of the word
    multiset, also among keys), words, s0, s1, bands."""
    f = rows.withColumn("f", F.pandas_udf(feature_parts, FEATURES)("request")).select("row_id", "batch_no", "own_id", "hash", "f.*")
    pair = lambda *c: F.struct(F.xxhash64(F.lit(1), *c).alias("key"), F.xxhash64(F.lit(2), *c).bitwiseOR(F.lit(1)).alias("proof"))
    text = F.when(F.col("words").isNotNull(), pair(F.lit("w"), F.col("words")))
    own = [F.when(F.col(c).isNotNull(), pair(F.col(c))) for c in ("own_id", "hash")]
    return f.select("row_id", "batch_no", F.array_compact(F.array(*own, text)).alias("keys"), text.alias("text"), "words", "s0", "s1", "bands")


def with_classes(batch: DataFrame) -> DataFrame:
    """``batch`` with ``doc``, the first row that has its text; only that row keeps words, sketch and bands."""
    firsts = batch.where("text is not null").groupBy("text").agg(F.min("row_id").alias("doc"))
    first = lambda c: F.when(F.col("row_id") == F.col("doc"), F.col(c)).alias(c)
    return batch.join(firsts, "text", "left").select("row_id", "doc", "keys", "text", *[first(c) for c in ("words", "s0", "s1", "bands")])


def entries_of(rows: DataFrame, *more: str) -> DataFrame:
    """One row a key: key, proof (second hash of an exact key, 0 of a band key), doc (the row's id) and ``more``."""
    bands = F.transform(F.coalesce("bands", F.array().cast("array<bigint>")), lambda b: F.struct(b.alias("key"), F.lit(0).cast("bigint").alias("proof")))
    return rows.select(F.col("row_id").alias("doc"), *more, F.inline(F.concat("keys", bands)))


def standing(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """What rows of :func:`with_classes` that are not ``gone`` (row_id) stand for: src, exact, id. Each brings its own keys
    (exact, ``src`` and ``id`` are the row), and each text that is left is at the row ``src``, ``id`` being the first left."""
    left = rows.select("row_id", "doc").join(gone.select("row_id"), "row_id", "left_anti")
    both = F.array(F.struct(F.col("row_id").alias("src"), F.lit(True).alias("exact")), F.struct(F.col("doc").alias("src"), F.lit(False).alias("exact")))
    return left.select("row_id", F.inline(both)).where("src is not null").groupBy("src", "exact").agg(F.min("row_id").alias("id"))


def placed(rows: DataFrame, stands: DataFrame) -> DataFrame:
    """``rows`` as :func:`standing` says, by id: keys where exact, else the text (words, s0, s1, bands)."""
    keys = F.when(F.col("exact"), F.col("keys")).otherwise(F.array().cast("array<struct<key:bigint,proof:bigint>>"))
    text = [F.when(~F.col("exact"), F.col(c)).alias(c) for c in ("words", "s0", "s1", "bands")]
    return rows.drop("doc", "text").join(stands, F.col("row_id") == F.col("src")).select(F.col("id").alias("row_id"), keys.alias("keys"), *text)


def alike(a0: str, a1: str, b0: str, b1: str) -> Column:
    """Whether two sketches agree well enough for words to be compared."""
    return F.bit_count(F.col(a0).bitwiseXOR(F.col(b0))) + F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) <= SKETCH - AGREE


def enough_common(a: str, b: str) -> Column:
    """Whether two word multisets are near-identical."""
    return F.size(F.array_intersect(a, b)) * 5 >= F.greatest(F.size(a), F.size(b)) * 4


TABLES = {"entries": ("key bigint, proof bigint, doc bigint", "key"), "docs": ("doc bigint, words array<bigint>, s0 bigint, s1 bigint", "doc")}


class History:
    """The accepted rows, as an index that batches are checked against and added to."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or new_path(spark, "history")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"pairloom_history_{uuid.uuid4().hex}"
        self.appends = 0
        self._state = f"{self.path}/state"
        self.generation = 0
        if path:
            kept = json.loads(read_text(spark, self._state))
            self.buckets, self.generation, self.appends = kept["buckets"], kept["generation"], kept["appends"]
        else:
            self._keep()
        self._declare()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """The index that another session left in ``path``."""
        return cls(spark, path=path)

    def _keep(self) -> None:
        write_text(self.spark, self._state, json.dumps({"buckets": self.buckets, "generation": self.generation, "appends": self.appends}))

    def _declare(self) -> None:
        # Keys are random, so a dictionary of them is wasted work.
        options = f"'parquet.page.row.count.limit' = '{PAGE}', 'parquet.enable.dictionary#key' = 'false'"
        for table, (columns, by) in TABLES.items():
            self.spark.sql(f"CREATE TABLE {self._named(table)} ({columns}) USING parquet OPTIONS ({options}) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}-{self.generation}'")

    def _named(self, table: str) -> str:
        return f"{self.name}_{self.generation}_{table}"

    def _table(self, table: str) -> DataFrame:
        return self.spark.table(self._named(table))

    def _append(self, table: str, df: DataFrame) -> None:
        columns, by = TABLES[table]
        df.select(*[c.split()[0] for c in columns.split(", ")]).repartition(self.buckets, by).sortWithinPartitions(by).write.insertInto(self._named(table))

    def close(self) -> None:
        """Leave the index in its folder and forget it in this session."""
        for table in TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._named(table)}")

    def drop(self) -> None:
        """Remove the index."""
        self.close()
        discard(self.spark, self.path)

    def compact(self) -> None:
        """Merge the files of all appends into one a bucket, in a new generation of the tables."""
        old = {table: self._table(table) for table in TABLES}
        names, before = [self._named(t) for t in TABLES], self.generation
        self.generation, self.appends = self.generation + 1, 0
        self._declare()
        for table, df in old.items():
            self._append(table, df)
        self._keep()
        for name, table in zip(names, TABLES):
            self.spark.sql(f"DROP TABLE {name}")
            discard(self.spark, f"{self.path}/{table}-{before}")

    def accept(self, rows: DataFrame) -> None:
        """Append accepted rows (row_id, keys, and words, s0, s1, bands on the first row of a text)."""
        self._append("entries", entries_of(rows))
        self._append("docs", rows.where("words is not null").withColumnRenamed("row_id", "doc"))
        self.appends += 1
        if self.appends >= COMPACT_AFTER:
            self.compact()
        else:
            self._keep()

    def start(self, batch: DataFrame) -> None:
        """Accept a whole batch unchecked (the history to begin with); the first row of a key stands for it."""
        rows = spool(with_classes(batch), "batch-rows")
        exact = rows.select("row_id", F.inline("keys")).groupBy("key", "proof").agg(F.min("row_id").alias("doc"))
        bands = rows.select(F.explode("bands").alias("key"), F.lit(0).cast("bigint").alias("proof"), "doc")
        self._append("entries", exact.unionByName(bands))
        self._append("docs", rows.where("words is not null"))
        self.appends += 1
        self._keep()
        forget(rows)

    def take(self, batch: DataFrame) -> DataFrame:
        """Check one batch, add what is accepted, and return the cases: kept_row_id, dup_row_id (stored).

        ``batch``: rows of :func:`with_features`. Rows of the batch come after all accepted rows.
        """
        rows = spool(with_classes(batch), "batch-rows")
        pushed = "spark.sql.parquet.pushdown.inFilterThreshold"
        before = self.spark.conf.get(pushed)
        self.spark.conf.set(pushed, str(FEW_KEYS))
        try:
            matched = spool(self.probe(rows), "batch-matched")
        finally:
            self.spark.conf.set(pushed, before)
        release(self.spark)
        inside = self._inside(rows, matched)
        release(self.spark)
        found = matched if inside is None else matched.unionByName(inside)
        # A text enters the index by its first accepted row, which need not be the first row of the batch with it.
        stands = spool(standing(rows, found), "batch-standing")
        self.accept(placed(rows, stands))
        forget(rows, stands)
        return found.select(F.col("kept").alias("kept_row_id"), F.col("row_id").alias("dup_row_id"))

    def probe(self, rows: DataFrame) -> DataFrame:
        """Rows of :func:`with_classes` that an accepted row before them matches: row_id, kept (the smallest such row)."""
        asked = entries_of(rows, "s0", "s1")
        held = self._table("entries").select("key", F.col("proof").alias("held_proof"), F.col("doc").alias("other"))
        few = [r[0] for r in asked.select("key").limit(FEW_KEYS + 1).collect()]
        if 0 < len(few) <= FEW_KEYS:
            # So few keys reach the scan as a filter: other buckets and pages of the sorted files are not read.
            held = held.where(F.col("key").isin(few))
        met = asked.hint("shuffle_hash").join(held, "key").where(F.col("proof").bitwiseXOR(F.col("held_proof")) == 0)
        met = met.select("doc", "s0", "s1", "other", (F.col("proof") != 0).alias("exact")).repartition(self.buckets, "other").distinct()
        docs = self._table("docs").select(F.col("doc").alias("other"), F.col("words").alias("other_words"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))
        passed = met.join(docs, "other", "left").where(F.col("exact") | alike("s0", "s1", "t0", "t1"))
        found = passed.join(rows.select(F.col("row_id").alias("doc"), "words"), "doc").where(F.col("exact") | enough_common("words", "other_words")).select("doc", "exact", "other")
        # An exact key speaks for its row, a near text for all rows that have it.
        means = rows.select("row_id", F.inline(F.array(F.struct(F.col("row_id").alias("doc"), F.lit(True).alias("exact")), F.struct("doc", F.lit(False).alias("exact")))))
        return found.join(means, ["doc", "exact"]).where("other < row_id").groupBy("row_id").agg(F.min("other").alias("kept"))

    def _inside(self, rows: DataFrame, matched: DataFrame) -> DataFrame | None:
        """Cases among the rows not ``matched`` whose match is an accepted row of the same batch: row_id, kept (stored);
        None if none can be.

        Only entries whose key comes more than once go on.
        """
        every = entries_of(placed(rows, standing(rows, matched).withColumn("id", F.col("src"))), "s0", "s1")
        shared = spool(every.withColumn("n", F.count("*").over(Window.partitionBy("key", "proof"))).where("n > 1"), "batch-shared")
        size, largest = shared.agg(F.count("*"), F.max(F.when(F.col("proof") == 0, F.col("n")))).first()
        if not size:
            forget(shared)
            return None
        release(self.spark)
        undecided = rows.select("row_id").join(matched.select("row_id"), "row_id", "left_anti").select(F.col("row_id").alias("doc"))
        # Written, as the links need both directions: their plan would hold that of the pairs four times.
        edge = spool(near_inside(shared, rows.where("words is not null").select("doc", "words", "text"), undecided, largest or 0).select("mine", "theirs"), "batch-edges")
        release(self.spark)
        both = edge.unionByName(edge.select(F.col("theirs").alias("mine"), F.col("mine").alias("theirs"))).distinct()
        # Links: a row owns its keys, and is held up by the owners of texts near its own.
        owned = rows.select("row_id", F.explode("keys").alias("key"), F.lit(True).alias("own"))
        foreign = rows.where("text is not null").select("row_id", "text").join(both, F.col("text") == F.col("mine")).select("row_id", F.col("theirs").alias("key"), F.lit(False).alias("own"))
        linked = owned.unionByName(foreign).join(matched.select("row_id"), "row_id", "left_anti")
        by_key = Window.partitionBy("key")
        links = spool(linked.withColumn("n", F.count("*").over(by_key)).where("n > 1").drop("n"), "batch-links")
        state = links.select("row_id").distinct().withColumn("accepted", F.lit(None).cast("boolean"))
        first_in = F.min(F.when(F.col("own") & F.col("accepted"), F.col("row_id"))).over(by_key)
        first_open = F.min(F.when(F.col("own") & F.col("accepted").isNull(), F.col("row_id"))).over(by_key)
        past = []
        while not state.where("accepted is null").isEmpty():
            seen = (
                links.join(state, "row_id")
                .select("row_id", "accepted", first_in.alias("first_in"), first_open.alias("first_open"))
                .where("accepted is null")
                .groupBy("row_id")
                .agg(F.coalesce(F.bool_or(F.col("first_in") < F.col("row_id")), F.lit(False)).alias("hit"), F.coalesce(F.bool_or(F.col("first_open") < F.col("row_id")), F.lit(False)).alias("held"))
                .select("row_id", F.when(F.col("hit"), False).when(~F.col("held"), True).alias("accepted"))
            )
            state = spool(state.where("accepted is not null").unionByName(seen), "batch-state")
            past.append(state)
        kept = links.join(state, "row_id").select("row_id", "accepted", first_in.alias("kept")).where("not accepted and kept < row_id")
        inside = spool(kept.groupBy("row_id").agg(F.min("kept").alias("kept")), "batch-inside")
        forget(shared, edge, links, *past)
        return inside


def verified(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Which candidates (doc, other) are near-identical, by ``texts`` (doc, words, text): doc, other and their texts, mine
    and theirs."""
    mine = candidates.join(texts.withColumnRenamed("text", "mine"), "doc")
    theirs = texts.select(F.col("doc").alias("other"), F.col("words").alias("other_words"), F.col("text").alias("theirs"))
    return mine.join(theirs, "other").where(enough_common("words", "other_words")).select("doc", "other", "mine", "theirs")


def near_inside(shared: DataFrame, texts: DataFrame, undecided: DataFrame, largest: int) -> DataFrame:
    """Near-identical texts within a batch: doc, other (the smaller), mine and theirs (the keys of both texts), at least
    for every other that may be accepted.

    ``shared``: entries (key, proof, doc, s0, s1) whose key comes more than once; ``undecided``: the rows (doc) that
    may be accepted; ``largest``: how often the most frequent band key comes. Candidates of one band meet in a join that
    compares sketches, so only likely pairs leave it. While a band is held by more than HOT texts, one round settles
    the texts that nothing before them can match: each is accepted, what it catches is not, and what is not accepted
    is never the ``other`` of a pair.
    """
    found, mine, other = [], shared.where("proof = 0"), shared.where("proof = 0")
    if largest > HOT:
        exact = shared.where("proof <> 0")
        later = exact.join(exact.groupBy("key", "proof").agg(F.min("doc").alias("first")), ["key", "proof"]).where("doc > first")
        able = spool(undecided.join(later.select("doc").distinct(), "doc", "left_anti"), "batch-able")
    while largest > HOT:
        ranked = other.join(other.groupBy("key").agg(F.min("doc").alias("first")), "key")
        firsts = ranked.groupBy("doc").agg(F.bool_and(F.col("doc") == F.col("first")).alias("sure")).where("sure").select("doc")
        sure = spool(firsts.join(able, "doc", "left_semi"), "batch-sure")
        leads = ranked.where("doc = first").join(sure, "doc").select("key", F.col("doc").alias("other"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))
        met = mine.join(leads, "key").where((F.col("other") < F.col("doc")) & alike("s0", "s1", "t0", "t1"))
        pairs = spool(verified(met.select("doc", "other").distinct(), texts), "batch-pairs")
        found.append(pairs)
        other = spool(other.join(sure.unionByName(pairs.select("doc")).distinct(), "doc", "left_anti"), "batch-open")
        mine = mine.join(sure, "doc", "left_anti")
        now = other.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if now > largest / 2:  # many texts share a band without being near: the join below is for those
            break
        largest = now
    band = other.select("key", F.col("doc").alias("other"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))
    met = mine.join(band, "key").where((F.col("other") < F.col("doc")) & alike("s0", "s1", "t0", "t1"))
    out = verified(met.select("doc", "other").distinct(), texts)
    for pairs in found:
        out = out.unionByName(pairs)
    return out


def replay_batches(rows: DataFrame, first: int = 0) -> DataFrame:
    """Take batch ``first`` as accepted and every later batch in turn: all cases, kept_row_id and dup_row_id."""
    spark = rows.sparkSession
    path = new_path(spark, "history-features")
    ready = with_features(rows.where("batch_no is not null"))
    ready.write.partitionBy("batch_no").option("parquet.enable.dictionary", "false").parquet(path)
    stored = spark.read.schema(ready.schema).parquet(path)
    history = History(spark)
    history.start(stored.where(F.col("batch_no") == first))
    numbers = [r[0] for r in stored.select("batch_no").where(F.col("batch_no") > first).distinct().orderBy("batch_no").collect()]
    cases = stored.select(F.col("row_id").alias("kept_row_id"), F.col("row_id").alias("dup_row_id")).limit(0)
    for number in numbers:
        cases = cases.unionByName(history.take(stored.where(F.col("batch_no") == number)))
        discard(spark, f"{path}/batch_no={number}")
        release(spark)
    history.drop()
    return cases
