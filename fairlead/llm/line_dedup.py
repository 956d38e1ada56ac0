"""Lines that many sites share: sketches of the sites per line, exact counts near the threshold.

A line's sites are counted by HyperLogLog sketches that merge by aggregation. Where the estimate is
near the threshold, the distinct sites are counted exactly. A line on enough sites is boilerplate; it
stays only in the document with the smallest id that has it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.common import documents, may_hold, row_filter, salted, spread, whole
from fairlead.sources.tables import Staging


@dataclass(frozen=True)
class LineRules:
    """``min_sites`` distinct sites make boilerplate. ``sketch_bits``: log2 of a sketch's registers."""

    min_sites: int = 8
    sketch_bits: int = 10
    site: str = "source"

    @property
    def margin(self) -> float:
        """Beyond it from the threshold, an estimate decides: four standard errors, at least one site."""
        return max(1.0, 4 * 1.04 / 2 ** (self.sketch_bits / 2) * self.min_sites)


def _line(part: Column) -> Column:
    return F.btrim(part, F.lit(" \t\r"))


def _lines(docs: DataFrame, rules: LineRules) -> DataFrame:
    """doc_id, row (hash of the text), at (number of the line), site, and two hashes of each line that isn't blank."""
    rows = docs.select(
        "doc_id",
        F.col(rules.site).cast("string").alias("site"),
        F.xxhash64(whole()).alias("row"),
        F.posexplode(F.split(whole(), "\n")).alias("at", "part"),
    ).withColumn("line", _line(F.col("part")))
    return rows.filter("line != ''").select(
        "doc_id", "row", "at", "site", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), F.col("line")).alias("g")
    )


def line_spread(lines: DataFrame, rules: LineRules, staging: Staging) -> DataFrame:
    """h, g, first (smallest doc_id) of the lines on at least ``min_sites`` sites. Null is no site."""
    sketched = (
        lines.groupBy("h", "g")
        .agg(F.hll_sketch_agg("site", F.lit(rules.sketch_bits)).alias("sites"), F.min("doc_id").alias("first"))
        .select("h", "g", "first", F.hll_sketch_estimate("sites").alias("estimate"))
        .filter(F.col("estimate") >= rules.min_sites - rules.margin)
    )
    likely = staging.keep(sketched, "likely_lines")
    near = likely.filter(F.col("estimate") <= rules.min_sites + rules.margin)
    counted = (
        may_hold(lines, "h", row_filter(near, "h"))
        .groupBy("h", "g", "site")
        .agg(F.min("doc_id"))
        .filter("site is not null")
        .groupBy("h", "g")
        .count()
        .filter(F.col("count") >= rules.min_sites)
        .select("h", "g")
    )
    exact = near.join(counted, ["h", "g"], "left_semi")
    far = likely.filter(F.col("estimate") > rules.min_sites + rules.margin)
    return staging.keep(far.unionByName(exact).select("h", "g", "first"), "boilerplate")


def remove_boilerplate(docs: DataFrame, staging: Staging, rules: LineRules = LineRules()) -> DataFrame:
    """All rows and columns of ``docs`` with cleaned ``text``, and n_lines, n_removed; native expressions only.

    Lines end at line feeds and are compared without blanks at their ends; blank lines stay. A null
    text stays null with no lines; the empty text is one line. Rows with one doc_id and text are treated alike. The copy in
    the smallest doc_id stays, with all its repeats; where no row of a line has a doc_id, all stay. Columns named n_lines or n_removed are replaced.
    """
    lines = _lines(docs, rules)
    boilerplate = line_spread(lines, rules, staging)
    found = salted(may_hold(lines, "h", row_filter(boilerplate, "h")), F.struct("doc_id", "at"))
    drops = (
        found.join(spread(boilerplate), ["h", "g", "__salt"])
        .filter(~F.coalesce(F.col("doc_id") == F.col("first"), F.col("first").isNull()))
        .groupBy(F.col("doc_id").alias("dropped_id"), F.col("row").alias("dropped_row"))
        .agg(F.sort_array(F.collect_set("at")).alias("dropped"))
    )
    drops = staging.keep(drops, "dropped_lines")
    # The caller's columns go by number, so that none clashes with a helper.
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = {c: f"column_{i}" for i, c in enumerate(columns)}
    kept = docs.select(*(F.col(f"`{c}`").alias(own[c]) for c in columns), F.xxhash64(whole()).alias("key"))
    joined = kept.join(
        drops, F.col(own["doc_id"]).eqNullSafe(F.col("dropped_id")) & (F.col("key") == F.col("dropped_row")), "left"
    )
    # What lies between two dropped lines is taken as a slice, so that the work grows with the lines only.
    pieces = F.expr(
        "flatten(transform(sequence(0, size(dropped)), i -> slice(lines, if(i = 0, 0, dropped[i - 1] + 1) + 1,"
        " if(i = size(dropped), size(lines), dropped[i]) - if(i = 0, 0, dropped[i - 1] + 1))))"
    )
    text = F.when(F.col("dropped").isNull(), F.col(own["text"])).otherwise(F.array_join(pieces, "\n"))
    return joined.withColumn("lines", F.split(own["text"], "\n")).select(
        *((text if c == "text" else F.col(own[c])).alias(c) for c in columns),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("dropped").isNotNull(), F.size("dropped")), F.lit(0)).cast("long").alias("n_removed"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(documents(spark, sf_dir), Staging(spark)).select("doc_id", "n_lines", "n_removed", "text")


OP3_SQL = f"""
WITH parts AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, source, trim(unnest(lines), ' ' || chr(9) || chr(13)) AS line FROM parts
), boilerplate AS (
  SELECT line, min(doc_id) AS first FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {LineRules.min_sites}
), numbered AS (
  SELECT doc_id, unnest(lines) AS part, generate_subscripts(lines, 1) AS nr FROM parts
), judged AS (
  SELECT n.*, b.first IS NOT NULL AND n.doc_id <> b.first AS dropped
  FROM numbered n LEFT JOIN boilerplate b ON trim(n.part, ' ' || chr(9) || chr(13)) = b.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_removed,
       coalesce(string_agg(part, chr(10) ORDER BY nr) FILTER (WHERE NOT dropped), '') AS text
FROM judged GROUP BY doc_id
"""
