"""Line dedup in DataFrame operations only: keep bitmaps by document in place of texts.

Each line becomes two hashes of its key, its document and its place.  Rows are dealt to ranges of hash and document, so a
frequent line is spread over as many ranges as its documents need; within a range an ordered stream takes each document
of a line once, and only counts and the last document of a line go on.  Lines that must go come back as bits, and
the text is read again with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

#: What is stripped from a line's ends, the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key has so many code points, and stands in so many documents, or it stays.
LEAST_CHARS = 20
LEAST_DOCS = 3
#: Lines for each word of a bitmap.
WORD_BITS = 64


def key_of(line: Column) -> Column:
    """A line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER_CASE)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """``doc``, ``t`` (a hash of the text), ``pos`` and two independent hashes of the key, for each line that is long enough."""
    text = _text(docs)
    each = docs.select(docs["doc_id"].alias("doc"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = each.select("doc", "t", "pos", key_of(F.col("line")).alias("k")).where(F.length("k") >= least_chars)
    return keyed.select("doc", "t", "pos", F.xxhash64("k").alias("h"), F.xxhash64(F.lit(13), "k").alias("g"))


def line_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc``, ``t``, ``n_dropped`` and ``bits`` for each text that loses lines; line i is dropped if its bit in ``bits`` is set.

    ``bits`` are structs ``(word, bits)`` of 64 lines each, in order, and only words that aren't zero: lines that
    stay take no room.  A key of ``least_chars`` code points found in ``least_docs`` documents or more stays in
    the document with the greatest id alone.

    Rows of one id are one document.  Rows without an id are no document: they don't count, and lose what three others
    hold.  Equal keys are told by 128 bits of hash, rows of one id by 64 bits of their text's.
    """
    scratch = Scratch(docs.sparkSession)
    lines = scratch.cut(_lines(docs, least_chars), "lines")
    dealt = lines.where("doc is not null").select("h", "g", "doc", "pos").repartitionByRange("h", "g", "doc")
    # The ranges serve the window, so rows aren't dealt again: one sort, and the first row of each document goes on.
    nth = F.row_number().over(W.partitionBy("h", "g", "doc").orderBy("pos"))
    once = dealt.withColumn("nth", nth).where("nth = 1")
    repeated = once.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= least_docs)
    repeated = scratch.cut(repeated.drop("n"), "repeated")
    gone = lines.join(repeated, ["h", "g"]).where(~F.col("doc").eqNullSafe(F.col("last")))
    bit = F.expr(f"shiftleft(1L, pos % {WORD_BITS})")
    words = gone.groupBy("doc", "t", F.expr(f"cast(pos div {WORD_BITS} as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc", "t").agg(
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bits")
    )


def _kept(text: Column, bits: Column) -> Column:
    """The lines of a text whose bits aren't set."""
    # Gaps between words are filled with zeros, so that a line finds its word by its place.
    gap = lambda w, i: w["word"] - F.coalesce(F.get(bits, i - 1)["word"], F.lit(-1)) - 1
    zero = F.lit(0).cast("bigint")
    dense = F.flatten(F.transform(bits, lambda w, i: F.concat(F.array_repeat(zero, gap(w, i)), F.array(w["bits"]))))
    packed = F.struct(F.split(text, "\n", -1).alias("lines"), dense.alias("dense"))
    keep = lambda p: F.filter(p["lines"], lambda _, i: F.coalesce(_bit(F.get(p["dense"], F.floor(i / WORD_BITS).cast("int")), i), F.lit(0)) == 0)
    return F.when(bits.isNull(), text).otherwise(F.array_join(F.element_at(F.transform(F.array(packed), keep), 1), "\n"))


def _bit(word: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, i % WORD_BITS).bitwiseAND(F.lit(1))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with a struct ``__lines`` behind its columns: ``n_lines``, ``n_dropped``, ``bits`` and ``kept``, the text that is left.

    The struct's name has more underscores where a column has it already.  Null and empty texts are one empty line, which
    stays.  Repeated rows lose the same lines each.  An empty table gives an empty result.  Other columns are kept.
    """
    bitmaps = line_bitmaps(docs, least_chars, least_docs)
    name = "__lines"
    while name in docs.columns:
        name += "_"
    # Names of our own, so that none clash and columns that nobody reads aren't shuffled.
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    by = {c: n for n, c in names.items()}
    wide = docs.toDF(*names)
    text = F.coalesce(F.col(by["text"]).cast("string"), F.lit(""))
    wide = wide.withColumn("own_t", F.xxhash64(text))
    both = wide.join(bitmaps, F.col(by["doc_id"]).eqNullSafe(F.col("doc")) & (F.col("own_t") == F.col("t")), "left")
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    made = F.struct(
        n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"), F.col("bits"), _kept(text, F.col("bits")).alias("kept")
    )
    return both.select(*names, made.alias("made")).toDF(*names.values(), name)


def digest(deduped: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    own = F.col(deduped.columns[-1])
    return deduped.select("doc_id", own["n_lines"].alias("n_lines"), own["n_dropped"].alias("n_dropped"), F.sha2(own["kept"], 256).alias("kept_sha256"))
