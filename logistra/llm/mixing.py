"""Mixing sources to target weights along a training run.

Each source has a weight schedule over training time 0 to 1. Its integral is
the cumulative demand for the source's words; inverting it gives every document
of the source a training position, and documents are range-sorted by position.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logistra.llm.frames import WORD, pick
from logistra.storage import stored

# Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
# Slope of each source's schedule, repeating: its weight at time t is
# weight * (1 + tilt * (2t - 1)), which leaves the integral over the run alone.
TILTS = (0.5, 0.0, -0.5)
# Words of the mix as a multiple of all words.
BUDGET = 1.5
# Most times a source, and so a document, is taken.
MOST_PASSES = 2
# Hexadecimal digits that number the hash ranges of a source; the running sum
# within one of these 65,536 ranges is all that one task makes at a time.
BUCKET_DIGITS = 4


def _cycle(values: tuple[float, ...], index: str) -> str:
    items = ", ".join(f"{v}D" for v in values)
    return f"array({items})[CAST(({index} - 1) % {len(values)} AS int)]"


def source_targets(totals: DataFrame, weights=WEIGHTS, tilts=TILTS, budget=BUDGET) -> DataFrame:
    """``(skey, source, source_size)`` with ``target`` and ``tilt``.

    Targets share ``budget`` times all words by weight. One that would pass
    MOST_PASSES times its source's size stops there, and the excess is shared
    again: in the order of cap / weight, the sources that stop are a prefix, so
    running sums give the level of the others. One row per source is all that
    any task sees. Sources without words get 0.
    """
    ranked = totals.selectExpr(
        "*",
        "row_number() OVER (ORDER BY source NULLS LAST) AS place",
        f"{MOST_PASSES} * CAST(source_size AS double) AS cap",
        f"{budget}D * sum(source_size) OVER () AS words",
    ).selectExpr(
        "*", f"{_cycle(weights, 'place')} AS weight", f"{_cycle(tilts, 'place')} AS tilt"
    )
    levels = ranked.selectExpr(
        "*", "row_number() OVER (ORDER BY cap / weight, place) AS step"
    ).selectExpr(
        "*",
        "words - coalesce(sum(cap) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1"
        " PRECEDING), 0D) AS words_left",
        "sum(weight) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        " AS weight_left",
    )
    return levels.selectExpr(
        "*", "if(words_left / weight_left * weight < cap, words_left / weight_left, NULL) AS level"
    ).selectExpr(
        "skey",
        "source_size",
        "tilt",
        "coalesce(weight * first_value(level) IGNORE NULLS OVER (ORDER BY step ROWS BETWEEN"
        " UNBOUNDED PRECEDING AND CURRENT ROW), cap) AS target",
    )


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``docs`` (doc_id, text, source) with hashes that name a row; none is null."""
    return docs.selectExpr(
        *more,
        "coalesce(concat('=', source), '') AS skey",
        "coalesce(md5(CAST(doc_id AS string)), '') AS place",
        "coalesce(md5(text), '') AS content",
    )


def _planned(docs: DataFrame, weights, tilts, budget) -> DataFrame:
    sized, _ = stored(
        _keyed(
            pick(docs, "doc_id", "text", "source"),
            "doc_id",
            "source",
            f"CAST(coalesce(regexp_count(text, r'{WORD}'), 0) AS long) AS size",
        ).selectExpr("*", f"substring(place, 1, {BUCKET_DIGITS}) AS bucket"),
        "mixing",
    )
    buckets = sized.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = buckets.groupBy("skey", "source").agg(F.sum("bucket_size").alias("source_size"))
    offsets = buckets.selectExpr(
        "skey",
        "bucket",
        "sum(bucket_size) OVER (PARTITION BY skey ORDER BY bucket) - bucket_size AS offset",
    ).join(source_targets(totals, weights, tilts, budget), "skey")
    # Position within the source: whole buckets before, then rows before in the bucket.
    started = sized.join(offsets, ["skey", "bucket"]).selectExpr(
        "*",
        "offset + coalesce(sum(size) OVER (PARTITION BY skey, bucket ORDER BY place, doc_id,"
        " content, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start",
        "CAST(floor(target) AS long) AS wanted",
    )
    part = "greatest(0L, least(size, wanted - start - {p} * source_size))"
    # D(t) = target * ((1 - tilt) t + tilt t^2), solved for t without cancellation.
    share = "((start + {p} * source_size) / target)"
    time = f"2 * {share} / (1 - tilt + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * {share}))"
    passes = range(MOST_PASSES)
    return started.selectExpr(
        "*",
        f"{' + '.join(part.format(p=p) for p in passes)} AS taken",
        *(
            f"if({part.format(p=p)} > 0, {time.format(p=p)}, NULL) AS {name}"
            for p, name in zip(passes, ("position", "second_position"), strict=True)
        ),
    )


def schedule(docs: DataFrame, weights=WEIGHTS, tilts=TILTS, budget=BUDGET) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source), range-sorted by ``position``.

    ``size`` (words of the text; null or empty: 0), ``source_size``, ``target``,
    ``taken`` (words that the mix takes, repeats counted), ``position`` and
    ``second_position`` (training time of the first and second pass; null if
    there is none). A source is read in the order of a hash of the id, once or
    twice, until its target is reached; the last document may be taken in part,
    so the words taken of a source are its target without the fraction. Rows
    with equal ids are documents of their own. A null source is a source.
    Documents that are not taken stand at the end.
    """
    columns = ["doc_id", "size", "source_size", "target", "taken", "position", "second_position"]
    planned = _planned(docs, weights, tilts, budget).select(columns)
    return planned.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_sequence(docs: DataFrame, weights=WEIGHTS, tilts=TILTS, budget=BUDGET) -> DataFrame:
    """One row per pass of the mix over a row of ``docs``, sorted by ``position``, all columns.

    ``taken`` is the number of words that the pass takes of the document, from
    its start; only for the last document of a source it is less than all.
    Documents that the mix does not reach are not in it.
    """
    names, lower = docs.columns, [c.lower() for c in docs.columns]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = {c: names.index(c) if c in names else lower.index(c) for c in ("doc_id", "text", "source")}
    keyed = _keyed(plain.selectExpr("*", *(f"c{i} AS {c}" for c, i in key.items())), *plain.columns)
    names_of_row = ["skey", "place", "content"]
    # Rows that agree in all of these are told apart by number.
    number = f"row_number() OVER (PARTITION BY {', '.join(names_of_row)} ORDER BY {{by}}) AS number"
    planned = _planned(docs, weights, tilts, budget).where("content <> ''")
    planned = planned.selectExpr("*", number.format(by="start")).where("taken > 0")
    passes = planned.select(*names_of_row, "number", "size", "taken", "position", "second_position")
    whole = keyed.where("content <> ''").selectExpr("*", number.format(by="skey"))
    return (
        whole.join(passes, [*names_of_row, "number"])
        .selectExpr(
            *plain.columns,
            "inline(filter(array(named_struct('taken', least(size, taken), 'position', position),"
            " named_struct('taken', taken - size, 'position', second_position)),"
            " p -> p.position IS NOT NULL))",
        )
        .orderBy("position", f"c{key['doc_id']}")
        .toDF(*names, "taken", "position")
    )
