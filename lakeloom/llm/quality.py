"""Operator 7: quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only.

Each text's measures are computed whole inside the JVM. KLL sketches of five ratios are built per
language and source over the rows that pass the base rules (partial sketches are merged map-side, so
a source with a third of all rows is no hot spot), merged again per language, and read as fences: a
value that lies beyond a group's upper quantile by more than a multiple of the distance between two
of its quantiles (or as far below the lower one) fails. Ratios that are zero for most texts have no
spread between the quartiles, so their fences read tail quantiles. Where even these coincide, a
small least distance from the group's quantile takes the spread's place; no fence is a constant of
its own. A group's fences are shrunk towards its language's, and these towards those of all rows, as if
PRIOR_ROWS rows had been seen there: n rows of its own weigh n / (n + PRIOR_ROWS), at every size alike.
The small fence table (one row a language and source) is joined back to filter.

Defined results: a null text has no words (base_failed); null languages and sources are groups like
others; repeated rows get repeated results; an empty table gives no rows; columns of docs that are
named like a measure are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import written

#: Production parameters.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SKETCH_K, SPREAD, TAIL_SPREAD, PRIOR_ROWS = 1024, 6.0, 1.0, 20

#: Measure -> (SQL over the columns of measures(), side of the fence, the two quantiles, distances of them to the fence, least distance).
#: Symbols are read further in: junk made of them can be a tenth of a source.
RATIOS = {
    "word_length": ("word_chars / n_words", "both", (0.25, 0.75), SPREAD, 0.5),
    "symbol_ratio": ("n_symbols / n_words", "high", (0.5, 0.8), SPREAD, 0.1),
    "dup_line_ratio": ("n_dup_lines / n_lines", "high", (0.5, 0.98), TAIL_SPREAD, 0.1),
    "repeat_ratio": ("n_repeat_words / n_words", "high", (0.5, 0.98), TAIL_SPREAD, 0.05),
    "upper_ratio": ("n_upper / word_chars", "high", (0.25, 0.75), SPREAD, 0.01),
}

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper (all long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    bare = F.btrim(text, F.lit(WHITE))
    cut = docs.select(
        *keep,
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1)).alias("_words"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        lines.alias("_lines"),
    )
    hashed = cut.select(
        *keep,
        "n_symbols",
        "n_upper",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(_words, x -> xxhash64(x))").alias("_w"),
    )
    # hashes of five neighbours: five shifted slices side by side, so that no place is looked up by number
    shifted = ", ".join(f"slice(_w, {i}, greatest(size(_w) - 4, 0))" for i in range(1, 6))
    hashed = hashed.withColumn("_h", F.expr(f"transform(arrays_zip({shifted}), x -> xxhash64(x))")).drop("_w")
    ordered = hashed.withColumn("_s", F.expr("if(size(array_distinct(_h)) = size(_h), array(), sort_array(transform(_h, (x, i) -> struct(x as h, i as i))))"))
    twice = ordered.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, j) -> x.h = coalesce(get(_s, j + 1).h, x.h + 1) or x.h = coalesce(get(_s, j - 1).h, x.h + 1)), x -> x.i))"))
    covered = F.expr("aggregate(zip_with(_p, slice(_p, 2, greatest(size(_p) - 1, 0)), (a, b) -> coalesce(least(5, b - a), 5)), 0L, (a, x) -> a + x)")
    return twice.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines", "n_upper")


def ratio(sql: str) -> Column:
    a, b = sql.split(" / ")
    return F.try_divide(F.col(a).cast("double"), F.col(b))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fences(measured: DataFrame) -> DataFrame:
    """One row for each lang and source: lang, source, and <ratio>_low, <ratio>_high."""
    ratios = measured.where(~base_failed()).select("lang", "source", *(ratio(sql).alias(r) for r, (sql, *_) in RATIOS.items()))
    groups = ratios.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(F.coalesce(r, F.lit(0.0)), SKETCH_K).alias(r) for r in RATIOS)
    )
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(r, SKETCH_K).alias(r) for r in RATIOS)]

    def read(sketches: DataFrame, prefix: str, *keys: str) -> DataFrame:
        out = [F.col("n").alias(f"{prefix}n")]
        for r, (_, side, between, times, least) in RATIOS.items():
            q = [F.kll_sketch_get_quantile_double(r, F.lit(x)) for x in between]
            far = F.greatest(times * (q[1] - q[0]), F.lit(least))
            out.append((q[0] - far if side == "both" else F.lit(None).cast("double")).alias(f"{prefix}{r}_low"))
            out.append((q[1] + far).alias(f"{prefix}{r}_high"))
        return sketches.select(*keys, *out)

    own = read(groups, "g_", "lang", "source")
    language = read(groups.groupBy("lang").agg(*merged), "l_", F.col("lang").alias("l_lang"))
    every = read(groups.agg(*merged), "a_")
    table = own.join(language, own.lang.eqNullSafe(F.col("l_lang"))).crossJoin(every)  # every has one row
    toward = lambda n, x, y: (n * x + PRIOR_ROWS * y) / (n + PRIOR_ROWS)
    fence = lambda c: toward(F.col("g_n"), F.col(f"g_{c}"), toward(F.col("l_n"), F.col(f"l_{c}"), F.col(f"a_{c}")))
    return table.select("lang", "source", *(fence(f"{r}_{side}").alias(f"{r}_{side}") for r in RATIOS for side in ("low", "high")))


def verdict() -> Column:
    """True unless a ratio lies beyond its fence; a ratio or fence that doesn't exist passes."""
    ok = F.lit(True)
    for r, (sql, *_) in RATIOS.items():
        x = ratio(sql)
        ok &= F.coalesce((x <= F.col(f"{r}_high")) & (x >= F.coalesce(F.col(f"{r}_low"), x)), F.lit(True))
    return ok


def _with_fences(measured: DataFrame) -> DataFrame:
    """A written table of measures with its rows' fences."""
    limits = fences(measured).select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *(f"{r}_{s}" for r in RATIOS for s in ("low", "high")))
    limits = written(limits)  # its size is known then: broadcast if small
    return measured.join(limits, measured.lang.eqNullSafe(F.col("f_lang")) & measured.source.eqNullSafe(F.col("f_source")), "left")


def quality_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, source."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("lang"), F.col("source").alias("source"))
    measured = written(measures(named, "doc_id", "lang", "source"))  # read twice, measured once
    return _with_fences(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict()).alias("kept"), "lang", "source"
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep.

    The whole row travels with its measures, so nothing is joined by doc_id and repeated rows stay repeated.
    It is written once with them, and measured once; the sketches' scan reads only the measures.
    """
    row = F.struct(*docs.columns).alias("_row")
    measured = written(measures(docs.select(row, "text", F.col("lang").alias("lang"), F.col("source").alias("source")), "_row", "lang", "source"))
    return _with_fences(measured).where(~base_failed() & verdict()).select("_row.*")


#: The base columns of quality_scores(); sketches have no SQL form.
BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, i, w[i:i + 4] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(generate_series(0, 4)) AS j FROM twice) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed FROM d LEFT JOIN covered USING (doc_id)
"""
