"""Removal of lines that spread over many sites.

Every line is known by two 64-bit hashes. One HyperLogLog sketch of sites per line is
built by a single aggregation: partial sketches merge on the map side, so a line that
stands in a third of all documents sends one sketch per map task. Lines whose estimate
is far above the threshold are boilerplate, far below it they are not; only lines near
it get an exact count of distinct sites. Boilerplate lines are then taken out of the
documents, apart from the first occurrence (smallest document id, then line number) if
``keep_first`` is set, so that no text leaves the corpus altogether.

Only (id, line number, hashes) are shuffled for finding lines; a document's text is
moved once, to meet the list of its lines to be removed.

Lines end at a line feed. A line without a character other than the six white-space ones
is never counted nor removed. Defined results: a null text stays null with 0 lines; an
empty text stays empty; a null site is one site of its own; rows with equal ids, null
included, are each cleaned by their own text, and count as one place for ``keep_first``
(all of them keep the line if the first occurrence is theirs); an empty table gives an
empty one. Input columns named ``n_lines`` or ``n_removed`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlane.llm.common import others, stored

# Sketch size: 2^10 registers, a relative standard error of about 3 %.
SKETCH_LG = 10
# Estimates this many standard errors from the threshold need no exact count.
NEAR_ERRORS = 6
STANDARD_ERROR = 1.04 / (1 << SKETCH_LG) ** 0.5


def has_word(line: Column) -> Column:
    return F.translate(line, " \t\n\x0b\x0c\r", "") != ""


def line_places(docs: DataFrame, id_column: str, site_column: str) -> DataFrame:
    """One narrow row per line with a word: document, site, number and hashes."""
    lines = F.posexplode(F.split("text", "\n"))
    return (
        docs.select(
            F.col(id_column).alias("_doc"),
            F.col(site_column).alias("_site"),
            F.xxhash64("text").alias("_text_hash"),
            lines.alias("_no", "_line"),
        )
        .where(has_word(F.col("_line")))
        .select("_doc", "_site", "_text_hash", "_no", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(7), "_line").alias("_h2"))
    )


def spread_lines(places: DataFrame, min_sites: int) -> DataFrame:
    """Hashes and first place of lines found on at least ``min_sites`` distinct sites."""
    margin = max(1.0, NEAR_ERRORS * STANDARD_ERROR * min_sites)
    site = F.coalesce(F.concat(F.lit("="), F.col("_site").cast("string")), F.lit("null"))
    sketched = (
        places.groupBy("_h1", "_h2")
        .agg(
            F.hll_sketch_agg(site, SKETCH_LG).alias("_sketch"),
            F.min(F.struct(F.col("_doc").alias("doc"), F.col("_no").alias("no"))).alias("_first"),
        )
        .withColumn("_estimate", F.hll_sketch_estimate("_sketch"))
        .where(F.col("_estimate") >= min_sites - margin)
        .select("_h1", "_h2", "_first", (F.col("_estimate") <= min_sites + margin).alias("_near"))
    )
    candidates = stored(sketched, "spread")
    near = candidates.where("_near").select("_h1", "_h2")
    # Distinct (line, site) pairs first: a hot line sends one row per site and map task.
    exact = (
        places.join(near, ["_h1", "_h2"], "left_semi")
        .select("_h1", "_h2", site.alias("_key"))
        .distinct()
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_sites"))
        .where(F.col("_sites") >= min_sites)
        .select("_h1", "_h2")
    )
    sure = candidates.where(~F.col("_near"))
    return sure.unionByName(candidates.where("_near").join(exact, ["_h1", "_h2"], "left_semi")).drop("_near")


def remove_spread_lines(
    docs: DataFrame,
    min_sites: int,
    keep_first: bool = True,
    id_column: str = "doc_id",
    site_column: str = "source",
) -> DataFrame:
    """Documents without boilerplate lines; adds ``n_lines`` and ``n_removed``."""
    own = others(docs, "n_lines", "n_removed")
    docs = docs.select(*own)
    places = line_places(docs, id_column, site_column)
    found = spread_lines(places, min_sites).select("_h1", "_h2", "_first")
    here = F.struct(F.col("_doc").alias("doc"), F.col("_no").alias("no"))
    removable = places.join(found, ["_h1", "_h2"])
    if keep_first:
        removable = removable.where(~here.eqNullSafe(F.col("_first")))
    # Per document the numbers of its lines to remove: bounded by the document itself.
    removed = (
        removable.groupBy(F.col("_doc").alias("__spread_id"), F.col("_text_hash").alias("__spread_hash"))
        .agg(F.sort_array(F.collect_set("_no")).alias("_numbers"))
        .select("__spread_id", "__spread_hash", F.size("_numbers").alias("__spread_n"), line_flags(F.col("_numbers")).alias("__spread_flags"))
    )
    same = docs[id_column].eqNullSafe(F.col("__spread_id")) & (F.xxhash64(docs["text"]) == F.col("__spread_hash"))
    lines = F.split(docs["text"], "\n")
    kept = F.filter(
        F.zip_with(lines, F.col("__spread_flags"), lambda line, gone: F.when(F.coalesce(gone, F.lit(False)), None).otherwise(line)),
        lambda line: line.isNotNull(),
    )
    text = F.when(F.col("__spread_n").isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    return docs.join(removed.hint("shuffle_hash"), same, "left").select(
        *[text.alias("text") if c == "`text`" else docs[c] for c in own],
        F.when(docs["text"].isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.coalesce(F.col("__spread_n"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def line_flags(numbers: Column) -> Column:
    """Sorted line numbers as an array that has true at each of them, false before."""
    gap = lambda n, i: n - F.coalesce(F.get(numbers, i - 1), F.lit(-1)) - 1
    return F.flatten(
        F.transform(numbers, lambda n, i: F.concat(F.array_repeat(F.lit(False), gap(n, i)), F.array(F.lit(True))))
    )
