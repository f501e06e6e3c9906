"""Mixing sources to target weights, with DataFrame functions alone.

The words of each source stand in one line, document after document, cut into blocks of fixed length.
Every output shard draws its sources from a multinomial; a slot's place among its source's slots goes
through a pseudorandom permutation of that source's block numbers, and slots meet blocks by number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import far, table, written
from .ordered import laid_out, running

#: Words of a block, slots of an output shard, rounds of a permutation.
BLOCK_WORDS, SHARD_SLOTS, ROUNDS = 64, 1024, 24
#: Weights of the sources in order, repeated; share of all words that the mix takes; times that a source may be taken.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Arithmetic of the permutations' keys: modulo a prime, so that 64 bits hold each product.
PRIME, FACTOR, TERM, SEED = (1 << 31) - 1, 48_271, 12_345, 20_011
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """documents: (row, id, source, size, sid, start); sources: a row each with its target and the words
    and slots that it is to give; spans: (shard, slot, sid, row, id, first_word, n_words), the mix itself."""

    documents: DataFrame
    sources: DataFrame
    spans: DataFrame


def stirred(v: Column, x: Column) -> Column:
    """A number below PRIME from two of them."""
    w = (v + x) % PRIME
    return (w * (w + FACTOR) + TERM) % PRIME


def permuted(i: Column, n: Column, keys: Column) -> Column:
    """The place of i among 0..n-1 under the permutation of these keys (swap or not: each round has pairs
    that add up to its key, and swaps a pair or not by a bit of its larger member). A key has its sum
    within n, and a mark for the bits."""

    def turn(x: Column, key: Column) -> Column:
        d = key["sum"] - x
        other = F.when(d < 0, d + n).otherwise(d)
        bit = lambda top: F.shiftright(stirred(key["mark"] + FACTOR * F.shiftright(top, 31), top.bitwiseAND(PRIME)), 16).bitwiseAND(1)
        return F.when(F.get(F.transform(F.array(F.greatest(x, other)), bit), F.lit(0)) == 1, other).otherwise(x)

    return F.aggregate(keys, i, turn)


def shares(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float, block: int) -> DataFrame:
    """A row for each source of (source, size): sid by code point, null last; weight; target: its part of
    share * all words by weight, at most cap times its size, the excess dealt out again by weight; words
    to take; numbers of blocks and slots; where its slots begin among all; keys of its permutations."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # as everywhere below: a row for each source
    s = sizes.withColumn("sid", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))).withColumn("most", cap * F.col("size").cast("double"))
    every, tightest = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("weight"), "sid")
    earlier = tightest.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    s = s.withColumns({"all_words": F.sum("size").over(every), "all_weight": F.sum("weight").over(every), "full": F.coalesce(F.sum("most").over(earlier), none), "gone": F.coalesce(F.sum("weight").over(earlier), none)})
    s = s.withColumn("over", (F.col("most") * (F.col("all_weight") - F.col("gone")) < F.col("weight") * (share * F.col("all_words") - F.col("full"))).cast("int"))
    s = s.withColumn("capped", F.min("over").over(tightest.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    s = s.withColumns({"full": F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(every), none), "gone": F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(every), none)})
    even = F.col("weight") * (share * F.col("all_words") - F.col("full")) / F.nullif(F.col("all_weight") - F.col("gone"), none)
    s = s.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.least(even, F.col("most"))))
    s = s.withColumn("quota", F.when(F.col("size") > 0, F.floor(F.col("target") + 0.5)).otherwise(0))
    up = lambda c: F.floor((c + (block - 1)) / block)
    s = s.withColumns({"rest": F.coalesce(F.try_mod("quota", "size"), F.lit(0)), "n_full": F.floor(F.col("size") / block), "n_blocks": up(F.col("size")), "turns": F.coalesce(F.expr("try_divide(quota - quota % nullif(size, 0), size)").cast("long"), F.lit(0))})
    s = s.withColumn("n_slots", F.col("turns") * F.col("n_blocks") + up(F.col("rest"))).withColumn("last", F.when(F.col("rest") > 0, F.col("rest") - (up(F.col("rest")) - 1) * block))
    s = s.withColumn("lo", F.coalesce(F.sum("n_slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("hi", F.col("lo") + F.col("n_slots"))

    def key(turn: Column, r: Column) -> Column:
        base = stirred(stirred(stirred(F.lit(SEED).cast("long"), F.col("sid").cast("long")), turn), r)
        whole = stirred(base, F.lit(1)) * (PRIME + 1) + stirred(base, F.lit(2))
        return F.struct((whole % F.greatest(F.lit(1), F.col("n_full"))).alias("sum"), (whole % PRIME).alias("mark"))

    long = lambda hi: F.sequence(F.lit(0).cast("long"), F.lit(hi).cast("long"))
    s = s.withColumn("keys", F.transform(long(int(cap)), lambda e: F.transform(long(ROUNDS - 1), lambda r: key(e, r))))
    return s.select("sid", "source", "size", "weight", "target", "quota", "n_full", "n_blocks", "n_slots", "last", "lo", "hi", "keys")


def located(points: DataFrame, x: str, intervals: DataFrame, total: int, n: int) -> DataFrame:
    """points with the interval (lo, hi] that holds each one's x; the intervals cover 0..total-1 once. They
    are dealt to cells of total / n, of which each point has one: an equal join, and twice n rows at most."""
    width = max(1, total // max(1, n))
    cells = intervals.where("hi > lo").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    return points.withColumn("_cell", F.floor(F.col(x) / width)).join(cells, "_cell").where((F.col(x) >= F.col("lo")) & (F.col(x) < F.col("hi"))).drop("_cell")


def drawn(sources: DataFrame, slots: int, spark: SparkSession, shard_slots: int) -> DataFrame:
    """(shard, slot, sid, rank): each shard's sources, drawn slot by slot with the sources' shares of all
    slots, and the slot's rank among its source's. Draws of a source beyond its number go, in order, to
    those that were drawn too seldom, so that ranks of each source run from 0 to its number less one."""
    n = sources.count()
    shards = spark.range(-(-slots // shard_slots)).withColumnRenamed("id", "shard")
    each = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(shard_slots), slots - F.col("shard") * shard_slots) - 1)).alias("slot"))
    each = each.withColumn("_u", F.pmod(F.xxhash64("shard", "slot", F.lit(SEED)), F.lit(max(1, slots)).cast("long")))
    own = located(each, "_u", sources.select("sid", "lo", "hi"), slots, n).select("shard", "slot", "sid")
    place = Window.partitionBy("shard", "sid").orderBy("slot")
    draws = written(own.withColumn("_r", F.row_number().over(place) - 1), spark)

    counts = running(draws.groupBy("shard", "sid").agg(F.count("*").alias("_n")), "sid", "shard", F.col("_n"), "_before")
    ordered = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    got = draws.groupBy(F.col("sid").alias("_s")).agg(F.count("*").alias("_got"))
    s = sources.select("sid", "n_slots").join(got, F.col("sid") == F.col("_s"), "left").select("sid", "n_slots", F.coalesce("_got", F.lit(0)).alias("got"))
    s = s.withColumns({"over": F.greatest(F.lit(0), F.col("got") - F.col("n_slots")), "lack": F.greatest(F.lit(0), F.col("n_slots") - F.col("got"))})
    s = written(s.withColumns({"over_at": F.coalesce(F.sum("over").over(ordered), F.lit(0)), "lo": F.coalesce(F.sum("lack").over(ordered), F.lit(0))}).withColumn("hi", F.col("lo") + F.col("lack")), spark)
    moved = s.agg(F.coalesce(F.sum("lack"), F.lit(0))).first()[0]

    ranked = draws.join(counts.select("shard", "sid", "_before"), ["shard", "sid"]).join(s.select("sid", "n_slots", "over_at"), "sid").withColumn("rank", F.col("_before") + F.col("_r"))
    stay = ranked.where("rank < n_slots").select("shard", "slot", "sid", "rank")
    rest = ranked.where("rank >= n_slots").select("shard", "slot", (F.col("over_at") + F.col("rank") - F.col("n_slots")).alias("_q"))
    found = located(rest, "_q", s.select("sid", "got", "lo", "hi"), moved, n)
    return stay.unionByName(found.select("shard", "slot", "sid", (F.col("got") + F.col("_q") - F.col("lo")).alias("rank")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> Mix:
    """A mix of share times all words of docs, of which each source gives what its weight says.

    Sources stand in order of code points, null last, and take the weights in turn. A source's target
    stops at cap times its words; the excess is dealt out among the others by weight. The words taken
    are the target, rounded: whole turns through the source, each in an order of its own, then a part
    of one more, whose last block is cut. So no word is taken more often than cap says.

    A null text has no words, as an empty one; rows without an id are documents like any other; repeated
    rows are one document each. Documents of equal id and size are in no order that shows in the
    result but for their texts' hashes. Other columns are ignored. An empty table, or one
    without words, gives an empty mix. The same table gives the same mix whatever its partitions.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("_text"))
    rows = laid_out(written(base, spark), [F.col("source").asc_nulls_last(), F.col("id").asc_nulls_last(), F.col("size").asc(), F.col("_text").asc()], "row")

    sources = written(shares(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, share, cap, block), spark)
    named = rows.join(sources.select(F.col("source").alias("_s"), "sid"), F.col("source").eqNullSafe(F.col("_s"))).select("row", "id", "source", "size", "sid")
    documents = written(running(named, "sid", "row", F.col("size"), "start"), spark)

    end = F.col("start") + F.col("size")
    cut = documents.where("size > 0").select("sid", "row", "id", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("index"))
    lo = F.greatest(F.col("start"), F.col("index") * block)
    pieces = cut.select("sid", "index", "row", "id", (lo - F.col("index") * block).alias("at"), (F.least(F.col("end"), (F.col("index") + 1) * block) - lo).alias("n"), (lo - F.col("start")).alias("first_word"))

    slots = drawn(sources, sources.agg(F.coalesce(F.max("hi"), F.lit(0))).first()[0], spark, shard_slots)
    own = slots.join(sources.select("sid", "n_full", "n_blocks", "n_slots", "last", "keys"), "sid")
    i, n_full = F.col("rank") % F.col("n_blocks"), F.greatest(F.lit(1), F.col("n_full"))
    keys = F.element_at("keys", (F.floor(F.col("rank") / F.col("n_blocks")) + 1).cast("int"))
    own = own.select("shard", "slot", "sid", F.when(i < F.col("n_full"), permuted(i, n_full, keys)).otherwise(i).alias("index"), F.when(F.col("rank") == F.col("n_slots") - 1, F.coalesce("last", F.lit(block))).otherwise(block).alias("take"))
    met = own.join(pieces, ["sid", "index"]).where("at < take")
    spans = met.select("shard", "slot", "sid", "row", "id", "at", "first_word", F.least(F.col("n"), F.col("take") - F.col("at")).alias("n_words"))
    return Mix(documents, sources, spans)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mix(table(spark, sf_dir, "documents"))
    taken = made.spans.groupBy(far(F.col("row")).alias("_row")).agg(F.sum("n_words").alias("taken"))
    rows = made.documents.join(taken, far(F.col("row")) == F.col("_row"), "left").join(made.sources.select("sid", F.col("size").alias("source_size"), "target"), "sid")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


_STIR = lambda v, x: f"((((({v}) + ({x})) % {PRIME}) * (((({v}) + ({x})) % {PRIME}) + {FACTOR}) + {TERM}) % {PRIME})"
_BASE = _STIR(_STIR(_STIR(str(SEED), "sid"), "e"), "r")
_TOP = "greatest(x, (k % n + n - x) % n)"
SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
s1 AS (SELECT *, [{", ".join(f"{float(w)}::DOUBLE" for w in WEIGHTS)}][sid % {len(WEIGHTS)} + 1] AS weight, {float(CAP)}::DOUBLE * source_size AS most FROM s0),
s2 AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(most) OVER t, 0) AS fulled, coalesce(sum(weight) OVER t, 0) AS gone FROM s1
       WINDOW t AS (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, min(CASE WHEN most * (all_weight - gone) < weight * ({SHARE}::DOUBLE * total - fulled) THEN 1 ELSE 0 END)
         OVER (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS capped FROM s2),
s4 AS (SELECT sid, source, source_size, most, weight, capped, total, all_weight, coalesce(sum(most) FILTER (WHERE capped) OVER (), 0) AS fulled,
         coalesce(sum(weight) FILTER (WHERE capped) OVER (), 0) AS gone FROM s3),
s5 AS (SELECT sid, source, source_size, CASE WHEN capped THEN most ELSE least(weight * ({SHARE}::DOUBLE * total - fulled) / (all_weight - gone), most) END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT ELSE 0 END AS quota FROM s5),
s7 AS (SELECT *, source_size // {BLOCK_WORDS} AS n_full, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS n_blocks, quota % source_size AS rest FROM s6 WHERE source_size > 0),
s8 AS (SELECT *, (quota // source_size) * n_blocks + (rest + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS n_slots FROM s7),
j AS (SELECT sid, n_full, n_blocks, n_slots, rest, unnest(range(n_slots)) AS rank FROM s8),
i AS (SELECT sid, n_full, greatest(1, n_full) AS n, rank // n_blocks AS e, rank % n_blocks AS i,
        CASE WHEN rank = n_slots - 1 AND rest > 0 THEN rest - ((rest + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} - 1) * {BLOCK_WORDS} ELSE {BLOCK_WORDS} END AS take FROM j),
k AS (SELECT sid, e, list({_STIR(_BASE, "1")} * {PRIME + 1} + {_STIR(_BASE, "2")} ORDER BY r) AS keys
      FROM (SELECT sid, unnest(range({CAP + 1})) AS e FROM s8), (SELECT unnest(range({ROUNDS})) AS r) GROUP BY sid, e),
p AS (SELECT sid, take, CASE WHEN i >= n_full THEN i ELSE list_reduce(keys, lambda x, k: CASE
        WHEN ({_STIR(f"k % {PRIME} + {FACTOR} * ({_TOP} >> 31)", f"({_TOP} & {PRIME})")} >> 16) & 1 = 1 THEN (k % n + n - x) % n ELSE x END, i) END AS idx
      FROM i JOIN k USING (sid, e)),
o AS (SELECT doc_id, size, sid, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
        row_number() OVER (ORDER BY sid, doc_id, size) AS rn FROM d JOIN s0 ON d.source IS NOT DISTINCT FROM s0.source),
c AS (SELECT *, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS idx FROM o WHERE size > 0),
t AS (SELECT rn, sum(greatest(0, least(start + size, idx * {BLOCK_WORDS} + take) - greatest(start, idx * {BLOCK_WORDS})))::BIGINT AS taken FROM c JOIN p USING (sid, idx) GROUP BY rn)
SELECT o.doc_id, o.size, s5.source_size, s5.target, coalesce(t.taken, 0) AS taken FROM o JOIN s5 USING (sid) LEFT JOIN t USING (rn)
"""
