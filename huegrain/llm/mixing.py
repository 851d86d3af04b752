"""Mixing sources to target weights, in DataFrame functions only.

Words are added up for each source; sources in the order of their names get the weights in turn and share the mixture's words by them, none more than
``most`` times its own words: what is over is shared again until no target is above. A source's rate is its target by its words;
each document is emitted floor(rate) times, and once more by a Bernoulli draw whose probability is the rate's fraction.

Draws are seeded by hashes of ids and spread evenly: documents of a source are dealt to blocks of about ``block`` by hash, put in order of size there,
and share one uniform number, stepped by the fraction from one document to the next. Each draw has its exact probability, and a block's
words miss theirs by a document at most (independent draws of a few very long documents would miss by half of all).

Sources may be many or one may hold a third of all rows: words are added up before they move, sources are numbered in ranges of names, targets are
found by a few sums over the table of sources, and documents are ordered a block at a time.

Defined cases: null and empty texts have no words and are taken 0 times their size; the null source is one, the last; sources without words have target 0
and are not repeated; documents of null or repeated ids are drawn each by itself, equal rows in any order; extra columns stay (``mixture``) or are ignored
(``mix_plan``); an empty table gives an empty result; texts of any length count in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def seeded(*parts: Column) -> Column:
    """52 bits of a hash of the parts, as a fraction of 1."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit(" ")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def weighed_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_docs, weight): sources in order of their names, null last, get the weights in turn.

    Names are sorted by ranges; a source's number is its rank in its range after the sizes of the ranges before (one row a range)."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = [F.col("source").asc_nulls_last()]
    ranged = materialize(sums.repartitionByRange(*by_name).withColumn("range", F.spark_partition_id()), "sources")
    before = ranged.groupBy("range").count().select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*by_name)) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    return ranged.join(before, "range").select("source", "source_size", "n_docs", weight.cast("long").alias("weight"))


def with_targets(sources: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Sources with their target: what is left after the sources at their limit, by weight. Each round closes those that would be above.

    Sums stay whole numbers: a source is above when left * weight > limit * open weights, both sides in decimals."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit = most * share[1] * F.col("source_size")  # in parts of 1/share[1] of a word, as all sums
    open_weight, left, closed = sources.agg(F.sum("weight")).first()[0] or 1, share[0] * total, -1
    above = F.lit(False)
    while True:
        above = F.lit(left).cast("decimal(38,0)") * F.col("weight") > limit.cast("decimal(38,0)") * F.lit(open_weight).cast("decimal(20,0)")
        at = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, limit)).alias("words"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if at.n == closed or not at.weight:
            break
        closed, left, open_weight = at.n, share[0] * total - (at.words or 0), at.weight
    target = F.when(above, limit / F.lit(float(share[1]))).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(share[1] * open_weight)))
    return sources.withColumn("target", target.cast("double"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, block: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per document; ``keep`` names further columns to carry."""
    told = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), *keep)
    with scratch() as held:
        sizes = held(materialize(told, "sizes"))
        sources = held(materialize(with_targets(weighed_sources(sizes, weights), share, most), "targets"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    name = F.coalesce("source", F.lit(" "))
    dealt = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select("doc_id", sizes["source"], "size", *keep, "source_size", "target", rate.alias("rate"), F.ceil(F.col("n_docs") / block).alias("blocks"))
    blocked = dealt.withColumn("draw", seeded(F.col("doc_id"))).withColumn("block", F.floor(F.col("draw") * F.col("blocks")))
    place = F.row_number().over(Window.partitionBy("source", "block").orderBy(F.col("size").desc(), "draw", "doc_id"))
    fraction = F.col("rate") - F.floor("rate")
    step = lambda at: F.floor(seeded(name, F.col("block")) + at * fraction)
    copies = F.floor("rate") + step(F.col("place")) - step(F.col("place") - 1)
    planned = blocked.withColumn("place", place).withColumn("copies", copies.cast("long"))
    return planned.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mixture itself: rows of ``docs`` with all their columns, each as often as it is taken."""
    named = docs.columns
    rows = materialize(docs.withColumn(own := "_row" + "_" * max(map(len, named)), F.monotonically_increasing_id()), "numbered")
    plan = mix_plan(rows, id_col, source_col, text_col, keep=(own,), **how).filter("copies > 0").select(own, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(own + "copy"))
    return rows.join(plan, own).select(*[F.col(f"`{c}`") for c in named])
