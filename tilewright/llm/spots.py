"""Document fingerprints by spot signatures, in DataFrame functions only.

A common word (an anchor) and the next two content words after it make a signature; a
fingerprint is the set of a text's signatures. The pattern reads anchors by a lookahead,
so chains may overlap. near_pairs() finds near documents within ranges of set length, by
the signatures that are rarest in each, and works out the Jaccard only of pairs that
lengths and places leave over. digest() compares given pairs and needs no search."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import scratch

# Words after which a chain begins, and the further common words that chains skip (en, fr, de, es).
ANCHORS = "is was that are this est dans pour qui une ist und mit von auf es los del para con".split()
SKIPPED = (
    "the a an of and to in on for it be as at by with from or he she we you they not but his her its have has had were will would can "
    "le la les des de du un en et au aux ne pas ce se sur par plus que il elle on sont avec mais ou son sa ses "
    "der die das den dem ein eine einer im zu als nicht auch sich er sie wir ihr aus bei nach wie so oder aber "
    "el las lo y a que se su sus al no un por una como más o pero"
).split()

CHAIN = 2
#: Counters of the sketch of signature counts; their number is fixed, more only save work.
SLOTS = 1 << 14


def _pattern() -> str:
    skip = "|".join(sorted({*ANCHORS, *SKIPPED}, key=lambda w: (-len(w), w)))
    word = rf"(?:(?:{skip}) )*+[^ ]++"
    return rf"(?<= )(?=((?:{'|'.join(ANCHORS)}) {' '.join([word] * CHAIN)} ))"


def _skips() -> str:
    skip = "|".join(sorted({*ANCHORS, *SKIPPED}, key=lambda w: (-len(w), w)))
    return rf"(?<= )(?:(?:{skip}) )++"


def words(text: Column) -> Column:
    """Lower case, letters and digits only, one space around each word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]++", " ")), F.lit(" "))


def with_signatures(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds the sorted distinct hashes of a text's signatures. Texts without a whole chain have one signature, all
    their words, so that they are near equal texts only; texts without words have none."""
    df = df.withColumn("_words", words(F.col(text_col)))
    df = df.withColumn("_chains", F.regexp_extract_all(F.col("_words"), F.lit(_pattern()), F.lit(1)))
    hashes = F.transform("_chains", lambda c: F.xxhash64(F.regexp_replace(c, _skips(), "")))
    none, whole = F.array().cast("array<bigint>"), F.array(F.xxhash64("_words"))
    sigs = F.when(F.length("_words") <= 2, none).when(F.size("_chains") == 0, whole).otherwise(F.array_sort(F.array_distinct(hashes)))
    return df.withColumn(out, sigs).drop("_words", "_chains")


def fingerprint(sigs: Column) -> Column:
    """The set as text: its signatures in hexadecimal."""
    return F.array_join(F.transform(sigs, lambda s: F.hex(s)), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def successors(ids: DataFrame, col: str, carry: list[str]) -> DataFrame:
    """ids (distinct, not null) with the next larger id and its `carry` columns, null for the largest.

    Ids are dealt out in ranges of their order, as many as there are shuffle partitions, however sparse they are; the
    first id of each range, a row a range, then goes to the range before."""
    spark = ids.sparkSession
    ranges = ids.select(col, *carry).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), col)
    dealt, _ = scratch(ranges.withColumn("_p", F.spark_partition_id()), "spots-order")
    w = Window.partitionBy("_p").orderBy(col)
    led = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in (col, *carry)])
    firsts = dealt.groupBy("_p").agg(F.min_by(F.struct(col, *carry), col).alias("_f"))
    after = firsts.select("_p", F.lead("_f").over(Window.orderBy("_p")).alias("_f"))
    return led.join(F.broadcast(after), "_p").select(col, *carry, *[F.coalesce(f"next_{c}", f"_f.{c}").alias(f"next_{c}") for c in (col, *carry)])


def digest(df: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and the likeness to those and to the next document's.

    Of rows with one id, those with the least text digest stand for the id as a successor; all get results. Null ids
    have no place in the order: their edited text is their own and their next is none (likeness null)."""
    every = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = every.where("doc_id is not null")
    ids = df.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.md5(F.coalesce("text", F.lit(""))).alias("h")).where("doc_id is not null")
    ids = ids.groupBy("doc_id").agg(F.max("n").alias("n"), F.min("h").alias("h"))
    linked = successors(ids, "doc_id", ["n"])
    ends = ids.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min_by("h", "doc_id").alias("h"), F.max_by("n", "doc_id").alias("n")).collect()
    first, last, last_n = (ends[0].a, ends[0].b, ends[0].n) if ends and ends[0].a is not None else (None, None, None)
    # Each document's text goes to the document before it, as much of it as that one may take.
    before = linked.where("next_doc_id is not null").select(F.col("next_doc_id").alias("doc_id"), F.col("doc_id").alias("to"), F.col("n").alias("to_n"))
    before = ids.select("doc_id", "h").join(before, "doc_id", "left")
    before = before.select("doc_id", "h", F.when(F.col("doc_id") == first, F.lit(last)).otherwise(F.col("to")).alias("to"), F.when(F.col("doc_id") == first, F.lit(last_n)).otherwise(F.col("to_n")).alias("to_n"))
    placed = with_signatures(docs.join(before, "doc_id", "left"), "text", "sigs")
    sent = placed.where(F.col("to").isNotNull() & F.startswith(F.md5("text"), F.col("h"))).select(F.col("to").alias("doc_id"), F.substring("text", F.lit(1), F.floor(F.col("to_n") / 4).cast("int")).alias("tail"), F.col("sigs").alias("next_sigs")).dropDuplicates(["doc_id"])
    # Both sides read the same columns and rows of the documents, and no more than the id deals them out (equality of the
    # digests would be a second key), so that their one exchange serves both.
    both = placed.select("doc_id", "text", "sigs").join(sent, "doc_id", "left")
    alone = with_signatures(every.where("doc_id is null"), "text", "sigs").select("doc_id", "text", "sigs", F.lit(None).cast("string").alias("tail"), F.lit(None).cast("array<bigint>").alias("next_sigs"))
    both = both.select("doc_id", "text", "sigs", "tail", "next_sigs").unionByName(alone).withColumn("n", F.length("text").cast("long"))
    cut = F.floor(F.col("n") / 4).cast("int")
    edited = F.when(F.col("next_sigs").isNull(), F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), F.col("n").cast("int") - cut), F.substring("tail", F.lit(1), cut)))
    both = with_signatures(both.withColumn("edited", edited), "edited", "edited_sigs")
    return both.select("doc_id", F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def _levels(sets: DataFrame) -> Column:
    """By slot of a signature's hash: log2 of how many sets hold signatures of that slot, as a literal array."""
    counts = sets.select(F.explode("sigs").alias("s")).groupBy(F.pmod("s", F.lit(SLOTS)).alias("slot")).agg(F.ceil(F.log2(F.count("*") + 1)).alias("n"))
    found = {r.slot: r.n for r in counts.collect()}  # SLOTS rows at most
    return F.from_json(F.lit(json.dumps([int(found.get(i, 0)) for i in range(SLOTS)])), "array<int>")


def near_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(fingerprint_id, near_id, likeness) of distinct fingerprints with Jaccard >= threshold > 0.

    Sets are dealt into ranges of length in which the longest is 1 / threshold times the shortest, so that a near set
    is in the same range or the next; within a range sets meet on a signature of their prefixes, rare signatures first by
    a sketch of all. A pair is given up where lengths, or the places at which a shared signature stands, leave it too
    little to share. Copies of a set fold into one id first (see members), so that a large group of copies makes no
    pairs; different sets that are all near each other make all theirs, which are rows of the result."""
    sets, _ = scratch(members(df, id_col, text_col).select("fingerprint_id", "sigs").dropDuplicates(["fingerprint_id"]).withColumn("len", F.size("sigs")).where("len > 0"), "spots-sets")
    levels = _levels(sets)
    part = F.floor(F.log("len") / F.log(F.lit(1 / threshold))).cast("int")
    prefix = (F.col("len") - F.ceil(F.col("len") * threshold) + 1).cast("int")
    ordered = F.sort_array(F.transform("sigs", lambda s: F.struct(F.get(levels, F.pmod(s, F.lit(SLOTS)).cast("int")).alias("level"), s.alias("sig"))))
    keyed = sets.select("fingerprint_id", "len", part.alias("part"), F.posexplode(F.slice(ordered, F.lit(1), prefix)).alias("at", "e")).select("fingerprint_id", "len", "part", "at", "e.sig")
    x = keyed.select(F.col("fingerprint_id").alias("a"), F.col("len").alias("la"), F.col("at").alias("i"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "sig", F.col("part").alias("pa"))
    y = keyed.select(F.col("fingerprint_id").alias("b"), F.col("len").alias("lb"), F.col("at").alias("j"), "part", "sig")
    most = F.least("i", "j") + 1 + F.least(F.col("la") - F.col("i"), F.col("lb") - F.col("j")) - 1
    possible = (F.least("la", "lb") >= threshold * F.greatest("la", "lb")) & (most * (1 + threshold) >= threshold * (F.col("la") + F.col("lb")) - 1e-6)
    pairs = x.join(y, ["part", "sig"]).where(possible & ((F.col("part") > F.col("pa")) | (F.col("a") < F.col("b")))).select("a", "b").distinct()
    sa, sb = sets.select(F.col("fingerprint_id").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("fingerprint_id").alias("b"), F.col("sigs").alias("sb"))
    scored = pairs.join(sa, "a").join(sb, "b").select(F.least("a", "b").alias("fingerprint_id"), F.greatest("a", "b").alias("near_id"), likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return scored.where(F.col("likeness") >= threshold)


def members(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint_id, sigs) of every row; equal sets have one fingerprint_id."""
    return with_signatures(df.select(id_col, text_col), text_col, "sigs").select(id_col, F.md5(fingerprint(F.col("sigs"))).alias("fingerprint_id"), "sigs")
