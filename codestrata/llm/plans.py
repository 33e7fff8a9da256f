"""Queries of the training-data operators, with SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.llm import byte_bpe, cooccurrence, mixing, names, provenance, residue, syntax
from codestrata.tables import table


def p6_ids(spark, d):
    return byte_bpe.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p7_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p2_found(spark, d):
    return syntax.broken_files(table(spark, d, "source_files"))


def p2_rates(spark, d):
    return syntax.broken_rates(table(spark, d, "source_files"))


def p3_found(spark, d):
    """Of the pairs judged by the fitted null those that keep the rule that the problem states.

    The rule looks at the exact counts, so no tail decides a row here; :func:`p3_surprising` has the pairs that the tails
    and the false discovery rate choose.
    """
    pairs = cooccurrence.coupled_paths(table(spark, d, "commits"))
    return pairs.where("together >= 5 and together * n >= 3 * count_a * count_b").select("scan_id", "a", "b")


def p3_surprising(spark, d):
    """Pairs whose count the null does not explain, at a false discovery rate of 1 in 100."""
    return cooccurrence.coupled_paths(table(spark, d, "commits")).where("q_value <= 0.01")


def p3_pairs(spark, d):
    return cooccurrence.coupled_paths(table(spark, d, "commits"))


def p3_counts(spark, d):
    return cooccurrence.coupled_paths(table(spark, d, "commits")).select("scan_id", "a", "b", "together", "count_a", "count_b", "n", "confidence")


def p4_found(spark, d):
    return names.author_names(table(spark, d, "commits"))


def p4_entities(spark, d):
    return names.name_entities(table(spark, d, "commits"), "scan_id", "author").withColumnRenamed("space", "scan_id")


def p5_found(spark, d):
    return provenance.machine_files(table(spark, d, "source_files"), table(spark, d, "skipped_files")).select("file_id")


def p5_reasons(spark, d):
    return provenance.machine_files(table(spark, d, "source_files"), table(spark, d, "skipped_files")).select("file_id", "reason")


def p5_parts(spark, d):
    """How many files each part of the operator tells."""
    told = provenance.machine_files(table(spark, d, "source_files"), table(spark, d, "skipped_files"))
    return told.groupBy("part", "reason").agg(F.count("*").alias("files"))


def p8_found(spark, d):
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p8_reasons(spark, d):
    return residue.residue(table(spark, d, "documents"))


def queries() -> dict:
    return {"p4_found": p4_found, "p4_entities": p4_entities, "p5_found": p5_found, "p5_reasons": p5_reasons, "p5_parts": p5_parts, "p8_found": p8_found, "p8_reasons": p8_reasons, "p2_found": p2_found, "p2_rates": p2_rates, "p3_found": p3_found, "p3_pairs": p3_pairs, "p3_surprising": p3_surprising, "p3_counts": p3_counts, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares}


PLAIN = r"regexp_replace(regexp_replace(replace(x, '\', '/'), '/+', '/', 'g'), '^(\./)+', '')"

COUNTS_SQL = f"""
last AS (SELECT scan_id, id, files FROM commits WHERE id IS NOT NULL AND scan_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY scan_id, id ORDER BY ingested_at DESC NULLS LAST, files DESC NULLS LAST) = 1),
baskets AS (SELECT scan_id, id, list_distinct(list_transform(list_filter(files, lambda x: x IS NOT NULL), lambda x: {PLAIN})) AS held FROM last),
kept AS (SELECT * FROM baskets WHERE len(held) BETWEEN 1 AND 50),
n AS (SELECT scan_id, count(*) AS n FROM kept GROUP BY 1),
item AS (SELECT scan_id, id, unnest(held) AS item FROM kept),
deg AS (SELECT scan_id, item, count(*) AS k FROM item GROUP BY ALL),
pair AS (SELECT x.scan_id, x.item AS a, y.item AS b, count(*) AS together FROM item x JOIN item y ON x.scan_id = y.scan_id AND x.id = y.id AND x.item < y.item GROUP BY ALL),
counted AS (SELECT p.*, da.k AS count_a, db.k AS count_b, n.n FROM pair p JOIN deg da ON da.scan_id = p.scan_id AND da.item = p.a
            JOIN deg db ON db.scan_id = p.scan_id AND db.item = p.b JOIN n ON n.scan_id = p.scan_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {COUNTS_SQL} SELECT scan_id, a, b FROM counted WHERE together >= 5 AND together * n >= 3 * count_a * count_b",
        "p3_counts": f"WITH {COUNTS_SQL} SELECT *, together / least(count_a, count_b) AS confidence FROM counted",
    }
