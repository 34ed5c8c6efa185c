"""Order MinHash fingerprints (after Marcais et al., 2019), as DataFrame expressions only.

A text's k-mers are its runs of ``K`` words (a word of more than LONG characters is cut into pieces, so that texts without white space have k-mers, too), each numbered by its earlier occurrences. A hash of
k-mer and number deals them into ``SKETCHES`` bins (first occurrences: of the k-mer alone); in each bin the ``TUPLE`` smallest are selected, put back into
text order and hashed together. A bin that has too few goes on with the next ones. So a sketch changes when
its k-mers change and also when they change places, and the share of equal sketches
follows edit distance. Sorting by hash makes all of it linear in the text but for the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
SKETCHES = 64
TUPLE = 2
_BIN_BITS = 6
_HEX = 6
_LOW = (1 << 31) - 1
_WHITE = " \t\n\x0b\x0c\r"
#: A word of more characters (of a script without white space, or an encoding) counts as pieces of so many.
LONG, PIECE = 32, 16
_SIGN = r"[^\x20\x09-\x0D]"
_WORDS = rf"(?<!{_SIGN}){_SIGN}{{1,{LONG}}}(?!{_SIGN})|{_SIGN}{{1,{PIECE}}}"


def _hash(x: Column) -> Column:
    return F.shiftright(x, 31)


def _words(text: Column) -> Column:
    """Words between white space, longer ones than LONG in pieces of PIECE characters; an empty text has one empty word."""
    text = F.coalesce(text, F.lit(""))
    plain = F.split(F.btrim(text, F.lit(_WHITE)), r"[\x20\x09-\x0D]+")
    return F.when(text.rlike(rf"{_SIGN}{{{LONG + 1}}}"), F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))).otherwise(plain)


def with_sketches(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """``df`` with ``out``: SKETCHES numbers of 24 bits for the column ``text``."""
    w, s, d, c, m = (f"_{out}_{x}" for x in "wsdcm")
    words, bin_shift = F.col(w), 62 - _BIN_BITS
    # a k-mer is 31 bits of hash, whose first ones are its bin, before 31 bits of position
    kmer = lambda x, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(x, *(F.get(words, i + j) for j in range(1, k))), 33), 31) + i
    again = lambda x, j: _hash(F.get(F.col(s), j - 1)) == _hash(x)

    def numbered(x: Column, j: Column) -> Column:
        """A repeated k-mer under the hash of itself and its number; equal ones stand together, so a search by halves counts those before."""
        halves = F.array(*(F.lit(1 << b) for b in range(30, -1, -1)))
        seen = F.aggregate(halves, F.lit(0), lambda n, q: F.when((q <= j - n) & (_hash(F.get(F.col(d), j - n - q)) == _hash(x)), n + q).otherwise(n))
        return F.shiftleft(F.shiftrightunsigned(F.xxhash64(_hash(x), seen), 33), 31) + x.bitwiseAND(F.lit(_LOW))

    df = df.withColumn(w, _words(F.col(text)))
    df = df.withColumn(s, F.sort_array(F.transform(F.slice(words, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), kmer))).drop(w)
    df = df.withColumn(d, F.filter(s, again))
    first = F.filter(s, lambda x, j: (j == 0) | (_hash(F.get(F.col(s), j - 1)) != _hash(x)))
    df = df.withColumn(c, F.when(F.size(d) == 0, F.col(s)).otherwise(F.sort_array(F.concat(first, F.transform(d, numbered))))).drop(s, d)
    # the smallest of each bin
    df = df.withColumn(m, F.filter(c, lambda x, j: (j < TUPLE) | (F.shiftright(x, bin_shift) != F.shiftright(F.get(F.col(c), j - TUPLE), bin_shift)))).drop(c)
    steps = F.array(*(F.lit(1 << x) for x in range((SKETCHES * TUPLE).bit_length() - 1, -1, -1)))

    def sketch(b: Column) -> Column:
        start = F.aggregate(steps, F.lit(0), lambda n, q: F.when(F.shiftright(F.get(F.col(m), n + q - 1), bin_shift) < b, n + q).otherwise(n))
        chosen = F.transform(F.array(*(F.lit(t) for t in range(TUPLE))), lambda t: F.get(F.col(m), (start + t) % F.size(m)))
        in_order = F.sort_array(F.transform(chosen, lambda x: F.shiftleft(x.bitwiseAND(F.lit(_LOW)), 31) + _hash(x)))
        return F.shiftrightunsigned(F.aggregate(in_order, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x.bitwiseAND(F.lit(_LOW)))), 64 - 4 * _HEX)

    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), sketch)).drop(m)


def as_text(sketches: Column) -> Column:
    return F.lower(F.array_join(F.transform(sketches, lambda x: F.lpad(F.hex(x), _HEX, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal sketches."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(SKETCHES))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """The number of bounds below the key, by a search by halves."""
    if not bounds:
        return F.lit(0)
    table = F.lit(bounds).cast("array<bigint>")
    steps = F.lit([1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, q: F.when(F.get(table, n + q - 1) < key, n + q).otherwise(n))


def with_next(docs: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """``docs`` with next_<column> of the document that follows by descending doc_id (after the last: the first).

    Rows without a doc_id come last; rows of one doc_id follow one another by a hash of their text. Ranges of ids, whose bounds are quantiles,
    become buckets. An id that is a bound several times holds several buckets' worth of rows and is cut by that hash into as many, and so are the
    rows without an id. The first row of each bucket also goes to the bucket before as a guest, so that a window over single buckets finds
    each row's successor. Rows that agree in doc_id and text stay together.
    """
    shares = [i / buckets for i in range(1, buckets)]
    columns_of = [F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("lone")] + ([F.percentile_approx("doc_id", shares, 50 * buckets).alias("b")] if shares else [])
    found = docs.agg(*columns_of).first().asDict()
    quantiles = found.get("b") or []
    bounds = sorted(set(quantiles))
    parts = {b: n for b in bounds if (n := quantiles.count(b)) > 1}
    lone = max(1, -(-found["lone"] * buckets // max(found["n"], 1)))
    key, tie = F.col("doc_id"), F.xxhash64("text")
    # rows of a cut id come before the smaller ids of their bucket
    cell = F.least(F.floor((tie / F.lit(2.0**64) + 0.5) * F.when(key.isNull(), lone).otherwise(F.coalesce(F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in parts.items() for x in kv)), key) if parts else F.lit(None), F.lit(1)))), F.lit(buckets))
    behind = F.when(key.isNull() | (key.isin(*parts) if parts else F.lit(False)), cell).otherwise(F.lit(buckets + 1))
    place = F.when(key.isNull(), len(bounds) + 1).otherwise(len(bounds) - _bucket(key, bounds)) * F.lit(buckets + 2) + behind
    spread = docs.withColumn("_tie", tie).withColumn("_own", place.cast("long"))
    # one row for each bucket; ~tie turns the order of ties round
    tops = spread.groupBy("_own").agg(F.max(F.struct("doc_id", F.bitwise_not("_tie").alias("t"))).alias("top")).orderBy("_own").collect()
    before = {r["_own"]: tops[i - 1]["_own"] for i, r in enumerate(tops)}
    own = [F.struct(F.col("_own").alias("bucket"), F.lit(False).alias("guest"))]
    guest = F.lit(None).cast("long")
    if tops:
        table = F.create_map(*(x for r in tops for x in (F.lit(r["_own"]), F.struct(F.lit(before[r["_own"]]).alias("to"), F.lit(r["top"]["doc_id"]).cast("long").alias("id"), F.lit(~r["top"]["t"]).cast("long").alias("tie")))))
        mine = table[F.col("_own")]
        guest = F.when(key.eqNullSafe(mine["id"]) & (F.col("_tie") == mine["tie"]), mine["to"])
    places = F.when(guest.isNotNull(), F.array(*own, F.struct(guest.alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(*own))
    spread = spread.withColumn("_at", F.explode(places)).select(*docs.columns, "_tie", "_at.bucket", "_at.guest")
    w = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "_tie")
    led = spread.select(*docs.columns, "guest", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return led.where("not guest").drop("guest")


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the string column fingerprint of a text column; a null text counts as an empty one."""
    return with_sketches(docs, text, "_sketches").withColumn("fingerprint", as_text(F.col("_sketches"))).drop("_sketches")


def edited(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text, of the text with its last half taken from the next one, and their likeness.

    Every row stays, repeated ones too. With one document the next one is itself; an empty table gives an empty result.
    Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(with_sketches(base, "text", "a"), ["text", "a"], buckets)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    led = led.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    led = led.withColumn("edited_sha256", F.sha2("edited", 256)).select("doc_id", "n_chars", "edited", "edited_sha256", "a", "next_a")
    return with_sketches(led, "edited", "b").select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next_a")).alias("near_next"),
    )
