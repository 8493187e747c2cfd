"""Document fingerprints: one-permutation MinHash, stored as low-order bits.

Every shingle is hashed once. The hash's high part names one of BINS bins and
the rest is its value; a bin keeps its smallest value. An empty bin takes the
value of the first filled bin of its own fixed probing order over all bins
(optimal densification). Of each value BITS bits are stored, packed as
hexadecimal digits. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logistra.llm.frames import WORD, let, pick

# Words of a shingle.
SHINGLE = 5
# Bins, a power of two, so that an odd stride probes every bin once.
BINS = 256
BIN_BITS = 8
# Stored bits of a bin: one hexadecimal digit.
BITS = 4
# Bits of a bin's value before packing.
VALUE_BITS = 48
# Probes that are tried one by one before the filled bins are ranked.
PROBES = 8
# Documents of one range of ids, whose next documents one task finds.
RANGE_ROWS = 2000
# Ranges of equal share of the rows, inside which ids are dealt out evenly.
SEGMENTS = 64


def _odd(i: int) -> int:
    """Odd stride of bin i's probing order."""
    return (i * 0x9E3779B1 >> 7) % BINS | 1


def _first(i: int) -> int:
    """First bin of bin i's probing order."""
    return (i * 0x85EBCA6B >> 11) % BINS


def _ints(values) -> str:
    return f"array({', '.join(map(str, values))})"


def fingerprint(text: str) -> Column:
    """Hexadecimal digits of the fingerprint of a text expression.

    Words are runs of the lower-case text without space and control white space. A
    text of fewer words than a shingle has its whole word sequence as the only
    shingle. Null, empty and blank texts have none: BINS zeros after an ``x``.
    """
    top = (1 << VALUE_BITS) - 1
    words = f"transform(regexp_extract_all(lower({text}), r'{WORD}', 0), w -> xxhash64(w))"
    shingle = f"xxhash64({', '.join(f'h[i + {k}]' for k in range(SHINGLE))})"
    # One entry per shingle and one empty entry per bin, as bin * 2^48 + value.
    code = f"shiftrightunsigned({shingle}, {64 - VALUE_BITS - BIN_BITS})"
    short = f"shiftrightunsigned(xxhash64(h), {64 - VALUE_BITS - BIN_BITS})"
    codes = (
        f"if(size(h) < {SHINGLE}, array({short}),"
        f" transform(sequence(0, size(h) - {SHINGLE}), i -> {code}))"
    )
    empties = f"transform(sequence(1, {BINS}), i -> shiftleft(CAST(i AS long), {VALUE_BITS}) - 1)"
    ordered = f"sort_array(concat({codes}, {empties}))"
    bins = let(
        ordered,
        "o",
        f"filter(o, (x, i) -> i = 0 OR shiftright(x, {VALUE_BITS}) !="
        f" shiftright(o[i - 1], {VALUE_BITS}))",
    )
    values = f"transform({bins}, x -> if(x & {top} = {top}, NULL, x & {top}))"
    first, stride = _ints(map(_first, range(BINS))), _ints(map(_odd, range(BINS)))
    back = _ints(pow(_odd(i), -1, BINS) for i in range(BINS))
    probes = ", ".join(f"v[(f[i] + {j} * s[i]) & {BINS - 1}]" for j in range(PROBES))
    # Rank of a filled bin b in the probing order of bin i, then b itself.
    rank = f"((((b - f[i] + {BINS}) * r[i]) & {BINS - 1}) * {BINS} + b)"
    ranked = f"v[array_min(transform(n, b -> {rank})) & {BINS - 1}]"
    dense = f"transform(v, (x, i) -> coalesce(x, {probes}, {ranked}))"
    filled = f"filter(sequence(0, {BINS - 1}), b -> v[b] IS NOT NULL)"
    dense = let(filled, "n", dense)
    for name, value in (("r", back), ("s", stride), ("f", first)):
        dense = let(value, name, dense)
    digits = f"transform({dense}, x -> substring('0123456789abcdef', 1 + CAST(x & 15 AS int), 1))"
    packed = let(values, "v", f"array_join({digits}, '')")
    packed = f"if(size(h) = 0, '{'x' + '0' * BINS}', {packed})"
    return F.expr(let(f"coalesce({words}, array())", "h", packed))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1.

    The share of equal digits, less what 4 random bits agree by chance. Two
    fingerprints without shingles are alike (1), one without is unlike (0).
    """
    chance = 1 / (1 << BITS)
    same = (
        f"size(filter(sequence(1, {BINS}), i -> substring({a}, i, 1) = substring({b}, i, 1)))"
    )
    return F.expr(
        f"CASE WHEN {a} = {b} THEN 1D WHEN {a} LIKE 'x%' OR {b} LIKE 'x%' THEN 0D"
        f" ELSE greatest(0D, ({same} / {BINS}D - {chance}D) / {1 - chance}D) END"
    )


def with_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` with ``range``: numbers of ascending ranges of ids with few rows each.

    SEGMENTS quantiles of the ids come first, so that gaps and clusters of ids
    do not matter, and each segment is cut into equal widths. A null id is in
    range -1.
    """
    shares = ", ".join(f"{k / SEGMENTS}D" for k in range(1, SEGMENTS))
    found = docs.selectExpr(
        f"percentile_approx(doc_id, array({shares}), 10000) AS cuts",
        "count(*) AS n",
        "min(doc_id) AS low",
        "max(doc_id) AS high",
    ).first()
    cuts = sorted({found.low, *(found.cuts or []), found.high} - {None})
    pieces = max(1, -(-found.n // (RANGE_ROWS * SEGMENTS)))
    edges = f"array({', '.join(f'{c}L' for c in cuts) or '0L'})"
    place = f"(size(filter({edges}, c -> c <= doc_id)) - 1)"
    inside = (
        f"CAST(floor((doc_id - e[s]) / CAST(coalesce(get(e, s + 1), e[s] + 1) - e[s] AS double)"
        f" * {pieces}) AS long)"
    )
    inside = f"greatest(0L, least({pieces - 1}L, {inside}))"
    number = let(edges, "e", let(place, "s", f"s * {pieces}L + {inside}"))
    return docs.withColumn("range", F.expr(f"coalesce(if(doc_id IS NULL, -1L, {number}), -1L)"))


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, fp, next_text, next_fp)``: fingerprints, and those of the next document.

    The order is descending doc_id, then text; after the last row comes the
    first. A null text is empty. Windows run inside a range of ids; the first
    row of each range is carried over to the range before by a join, so no task
    sees all rows. Rows with a null id come last.
    """
    ranged = with_ranges(docs)
    # Hashes break ties of equal ids, so that no long text is compared.
    order = "PARTITION BY range ORDER BY doc_id DESC, xxhash64(text), text"
    inside = ranged.withColumn("fp", fingerprint("text")).selectExpr(
        "*", f"lead(struct(text, fp)) OVER ({order}) AS following"
    )
    first = F.expr("min_by(text, struct(-doc_id AS a, xxhash64(text) AS b, text AS c))")
    heads = ranged.groupBy("range").agg(first.alias("text"))
    heads = heads.select("range", F.struct("text", fingerprint("text").alias("fp")).alias("head"))
    # One row per range: the range that follows in descending order.
    numbers = ranged.groupBy("range").count()
    follows = numbers.selectExpr(
        "range",
        "coalesce(lead(range) OVER (ORDER BY range DESC),"
        " first_value(range) OVER (ORDER BY range DESC)) AS next_range",
    )
    heads = follows.join(
        heads.withColumnRenamed("range", "next_range"), "next_range"
    ).select("range", "head")
    return inside.join(heads, "range").selectExpr(
        "doc_id", "text", "fp", "inline(array(coalesce(following, head))) AS (next_text, next_fp)"
    )


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text (doc_id, text) and of its edited text.

    In the edited text the last floor(n / 2) code points give way to as many, or
    all, of the first of the next document. One document alone is its own next.
    """
    texts = pick(docs, "doc_id", "text").selectExpr("doc_id", "coalesce(text, '') AS text")
    both = with_next(texts).selectExpr(
        "*", "CAST(char_length(text) AS long) AS n_chars"
    )
    half = "CAST(n_chars - floor(n_chars / 2) AS int)"
    edited = both.selectExpr(
        "*",
        f"concat(substring(text, 1, {half}),"
        " substring(next_text, 1, CAST(floor(n_chars / 2) AS int))) AS edited",
    )
    return (
        edited.withColumn("edited_fingerprint", fingerprint("edited"))
        .selectExpr(
            "doc_id",
            "n_chars",
            "sha2(CAST(edited AS binary), 256) AS edited_sha256",
            "fp AS fingerprint",
            "edited_fingerprint",
            "next_fp",
        )
        .withColumn("near_edited", likeness("fingerprint", "edited_fingerprint"))
        .withColumn("near_next", likeness("fingerprint", "next_fp"))
        .drop("next_fp")
    )
