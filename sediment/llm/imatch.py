"""I-Match fingerprints with several randomised lexicons, in DataFrame operations only.

Terms are a text's lower-case runs of letters and digits. The lexicon holds the terms
whose inverse document frequency ln(N / df) over the whole corpus lies in a band; a
term above its lower share of documents can't be rarer than that, so the lexicon has
at most (mean distinct terms of a document) / ``LEAST_SHARE`` terms, and is broadcast
only behind a count of it. The randomised lexicons are the whole one and ``LEVELS``
that each keep a share of it, by bits of a hash of the term. A text's fingerprint has one part a lexicon: the
hash of its sorted distinct terms in it, or a blank if it has none. Lexicons that keep
few terms still agree when texts share only part of theirs, so the share of equal
parts, out of those that aren't blank in both, grades how alike two texts are.

Order and neighbours: documents are range-partitioned by falling doc_id once and
staged; a document's next one is the next row of its partition, and each partition
also gets a copy of the row that follows its last one.

Defined cases: null text is empty; a text without a term of the lexicon has the hash
of the whole text as its first part; rows without an id come last, repeated ids in
order of a hash of their text; a single document is its own next; an empty table gives
no row. Other columns of the input are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sediment.llm.common import stage

#: Band of ln(N / df): from terms in a fifth of the documents to terms in one of 2000.
MOST_SHARE, LEAST_SHARE = 0.2, 0.0005
#: Lexicons: the whole one, then for each (bits, count) that many which keep 1 of 2^bits terms.
LEVELS = ((3, 3), (5, 10), (7, 14), (9, 12))
LEXICONS = 1 + sum(n for _, n in LEVELS)
BROADCAST_TERMS = 1_000_000
SEED = 2024
PART, BLANK = 8, "--------"
#: Stands in every text and in the lexicon, so that texts without terms keep a row.
ANCHOR = ""


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, count: int) -> DataFrame:
    """(term, mark): the band's terms and their hashes; the anchor's is -1."""
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).where(F.col("term") != ANCHOR).groupBy("term").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= LEAST_SHARE * count) & (F.col("df") <= F.greatest(F.lit(MOST_SHARE * count), F.lit(1.0)))).select("term")
    anchor = docs.sparkSession.range(1).select(F.lit(ANCHOR).alias("term"))
    mark = F.when(F.col("term") == ANCHOR, F.lit(-1)).otherwise(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "term"), 1))
    return stage(band.unionByName(anchor).select("term", mark.cast("long").alias("mark")), "imatch-lexicon")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprints(texts: DataFrame, keys: list[str], body: str, lex: DataFrame) -> DataFrame:
    """(keys..., fingerprint) of each row's text; the keys tell rows apart."""
    if lex.count() <= BROADCAST_TERMS:
        lex = F.broadcast(lex)
    words = texts.select(*keys, F.xxhash64(body).alias("_whole"), F.explode(F.concat(terms(F.col(body)), F.array(F.lit(ANCHOR)))).alias("term"))
    held = words.join(lex, "term").groupBy(*keys, "_whole").agg(F.collect_list("mark").alias("_held"))
    # a lexicon keeps the terms in which some bits of the hash have one value; each level reads bits of its own
    blank = F.xxhash64(F.expr("cast(array() as array<bigint>)"))
    part = lambda h: F.when(h == blank, F.lit(BLANK)).otherwise(F.lower(F.substring(F.lpad(F.hex(h), 16, "0"), 1 + PART, PART)))

    def level(marks, shift, bits, count):
        bucket = lambda x: F.shiftright(x, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        some = F.filter(marks, lambda x: bucket(x) < count)
        return bound(some, lambda kept: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: part(F.xxhash64(F.filter(kept, lambda x: bucket(x) == k)))))

    def parts(marks):
        out, shift = [F.array(part(F.xxhash64(marks)))], 0
        for bits, count in LEVELS:
            out.append(level(marks, shift, bits, count))
            shift += bits
        return F.array_join(F.concat(*out), "")

    bare = F.concat(F.lower(F.substring(F.lpad(F.hex("_whole"), 16, "0"), 1 + PART, PART)), F.lit(BLANK * (LEXICONS - 1)))
    ordered = F.array_sort(F.array_distinct(F.filter("_held", lambda x: x >= 0)))
    return held.select(*keys, bound(ordered, lambda marks: F.when(F.size(marks) > 0, parts(marks)).otherwise(bare)).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those that aren't blank in both fingerprints."""
    spots = F.sequence(F.lit(0), F.lit(LEXICONS - 1))
    parts = lambda c: F.transform(spots, lambda i: F.substr(c, i * PART + 1, F.lit(PART)))
    # 0: blank in both, 1: equal, 2: different
    kinds = F.zip_with(parts(a), parts(b), lambda x, y: F.when(x != y, 2).when(x == BLANK, 0).otherwise(1))
    return bound(kinds, lambda z: F.size(F.filter(z, lambda k: k == 1)).cast("double") / F.size(F.filter(z, lambda k: k > 0)))


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part, at): staged by falling doc_id; ``at`` counts within ``part``."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = d.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    return stage(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", at), "imatch-ordered")


def with_next(ordered: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``next_<c>`` for each column: its value in the following row, after the last the first."""
    heads = ordered.groupBy("part").agg(F.min("at").alias("at"))  # one row a partition
    last = F.max("part").over(Window.partitionBy())
    before = heads.select("at", F.coalesce(F.lag("part").over(Window.orderBy("part")), last).alias("_to"))
    copy = ordered.join(F.broadcast(before), "at").withColumn("part", F.col("_to")).withColumn("_copy", F.lit(True)).drop("_to")
    rows = ordered.withColumn("_copy", F.lit(False)).unionByName(copy)
    w = Window.partitionBy("part").orderBy("_copy", "at")
    return rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where(~F.col("_copy")).drop("_copy")


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text's last floor(n / 2) code points are replaced by as many of the next
    document's first ones. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    ordered = in_order(docs)
    count = ordered.count()
    lex = lexicon(ordered, count)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    both = (with_next(ordered, ["text"]).withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
            .select("part", "at", "doc_id", "n_chars", "text", "edited", F.sha2("edited", 256).alias("edited_sha256"))
            .select("part", "at", "doc_id", "n_chars", "edited_sha256", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("x"))
            .select("part", "at", "doc_id", "n_chars", "edited_sha256", "x.kind", "x.body"))
    keys = ["part", "at", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprints(both, [*keys, "kind"], "body", lex)
    pair = prints.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    done = with_next(stage(pair, "imatch-pairs"), ["fingerprint"])
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
