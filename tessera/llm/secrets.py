"""Operator 10, secret scans, with DataFrame functions only.

Three base patterns, and the method's own spans: candidate strings are classed by their characters,
a window slides over each while the counts of its characters, and from them its Shannon entropy, are
kept up by what enters and leaves; strings whose best window reaches their class's threshold are
secrets unless an allow-list names them.

Places of matches come from the lengths of the matches and of the gaps between them, summed up by a
window function, so a text with many matches costs no more than its length. Nothing but these lengths
is shuffled.

Defined cases: a null text has no spans (and stays null when redacted); null ids and repeated rows each
give their own row; spans that begin at one place (ties) come in the order of their kinds, and the method's span gives way to a base one; long texts are
searched whole; an empty table gives an empty table; further columns pass through :func:`redact` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The base patterns, and their kinds in the order they are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # the same spans as AKIA[A-Z0-9]+ of 20 and more
HEX = "[0-9a-f]{24,}"  # the same spans as [0-9a-f]+ of 24 and more
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST = 6

# The method's parameters: characters of a candidate, the window, and bits that a window must reach by class.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
WINDOW = 20
PART = 1 << 16  # characters of a long candidate that are held as an array at once
HEX_BITS, MIXED_BITS, LOWER_BITS = 3.0, 3.9, 3.8
#: Suppressed: UUIDs, named digests, plainly made-up values, and paths of plain words.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|^(?i:sha|md)[0-9]+[-_=]"
    "|(?i:example|sample|dummy|placeholder|changeme|your_|your-|xxxx|012345|123456|abcdef)|^[A-Za-z/_-]*[/_-][A-Za-z]*[0-9]{0,2}$"
)


def _matched(text: Column, pattern: str, least: int = 0) -> Column:
    """An array of ``(gap, size, good)``: lengths before and of each match; the tail after the last has no size."""
    rx = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    if least:
        value = F.transform(F.regexp_extract_all(text, rx, 2), lambda m: F.length(m) >= least)
    else:
        value = F.transform(F.regexp_extract_all(text, rx, 0), lambda m: F.lit(True))
    sizes = F.transform(F.regexp_extract_all(text, rx, 0), F.length)
    return F.transform(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), value.alias("good")), lambda x: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), x["good"].alias("good")))


def _good_assign(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_LEAST


def _replaced(text: Column, pattern: str, instead) -> Column:
    """The text with each match put through ``instead``; texts without a match are not split."""
    joined = F.array_join(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), lambda gap, m: F.concat(gap, F.when(m.isNull(), "").otherwise(instead(m)))), ""
    )
    return F.when(text.rlike(pattern), joined).otherwise(text)


def best_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits a character) of any ``window`` characters in a row, by incremental counts."""
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    weights = F.array(*[F.lit(w) for w in weight])
    # A long candidate goes by parts that overlap by a window less one, so that every window is in one of them.
    parts = F.transform(F.sequence(F.lit(0), F.length(candidate) - 1, F.lit(PART)), lambda i: candidate.substr(i + 1, F.lit(PART + window - 1)))
    places = lambda part: F.transform(F.split(part, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))

    def step(state: Column, i: Column, at: Column) -> Column:
        enters = F.element_at(at, i)
        leaves = F.when(i > window, F.element_at(at, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(-1))
        had = F.get(state["counts"], enters)
        had_left = F.when(leaves >= 0, F.get(state["counts"], leaves) + F.when(leaves == enters, 1).otherwise(0)).otherwise(F.lit(1))
        total = state["total"] + F.get(weights, had + 1) - F.get(weights, had) - F.when(leaves >= 0, F.get(weights, had_left) - F.get(weights, had_left - 1)).otherwise(F.lit(0.0))
        counts = F.transform(state["counts"], lambda c, j: c + F.when(j == enters, 1).otherwise(0) - F.when(j == leaves, 1).otherwise(0))
        entropy = F.when(i >= window, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
        return F.struct(counts.alias("counts"), total.alias("total"), F.greatest(state["best"], entropy).alias("best"))

    # A one-element array binds a part's places, so that they are worked out once.
    best = lambda part: F.element_at(F.transform(F.array(places(part)), lambda at: F.aggregate(F.sequence(F.lit(1), F.size(at)), start, lambda state, i: step(state, i, at), lambda state: state["best"])), 1)
    return F.array_max(F.transform(parts, best))


def is_secret(candidate: Column) -> Column:
    """Whether a candidate's best window reaches its class's threshold and no allow-list entry names it."""
    digits = F.length(F.regexp_replace(candidate, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(candidate, "[^A-Za-z]", ""))
    threshold = (
        F.when(candidate.rlike("^[0-9a-fA-F]+$"), F.when((digits >= 3) & (letters >= 3), F.lit(HEX_BITS)))
        .when((digits >= 2) & candidate.rlike("[a-z]") & candidate.rlike("[A-Z]"), F.lit(MIXED_BITS))
        .when((digits >= 4) & (letters >= 4), F.lit(LOWER_BITS))
    )
    return F.when(threshold.isNull() | candidate.rlike(ALLOWED), F.lit(False)).otherwise(best_entropy(candidate) >= threshold)


def _blank(text: Column) -> Column:
    """The text with base spans blanked out, all places unchanged."""
    blank = lambda m: F.repeat(F.lit(" "), F.length(m))
    text = _replaced(text, ASSIGN, lambda m: F.when(_good_assign(m), blank(m)).otherwise(m))
    return _replaced(_replaced(text, ACCESS, blank), HEX, blank)


def _entropy_matches(text: Column) -> Column:
    rx = F.lit(CANDIDATE)
    gaps = F.transform(F.split(text, CANDIDATE, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, rx, 0), lambda m: F.struct(F.length(m).alias("size"), is_secret(m).alias("good")))
    return F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("m")), lambda x: F.struct(x["gap"].alias("gap"), x["m"]["size"].alias("size"), x["m"]["good"].alias("good")))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, found)`` for every row: an array of ``(start, kind, end)``, in code points, by start and kind."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    empty = F.array().cast("array<struct<gap:int,size:int,good:boolean>>")

    def when_found(text: Column, pattern: str, matches: Column) -> Column:
        return F.when(text.rlike(pattern), matches).otherwise(empty)

    text = F.col("text")
    rows = rows.select("id", "row", "text", F.when(text.rlike(CANDIDATE) | text.rlike(ASSIGN), _blank(text)).alias("rest"))
    base = [when_found(text, ASSIGN, _matched(text, ASSIGN, ASSIGN_LEAST)), when_found(text, ACCESS, _matched(text, ACCESS)), when_found(text, HEX, _matched(text, HEX))]
    more = F.when(F.col("rest").isNull(), empty).otherwise(when_found(F.col("rest"), CANDIDATE, _entropy_matches(F.col("rest"))))

    def tagged(kind: int, matches: Column) -> Column:
        return F.transform(matches, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["good"].alias("good")))

    pieces = F.concat(*[tagged(k, m) for k, m in enumerate([*base, more])])
    laid = rows.select("id", "row", F.explode_outer(pieces).alias("p")).select("id", "row", "p.*").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = laid.withColumn("end", F.sum(F.col("gap").cast("long") + F.coalesce("size", F.lit(0))).over(before))
    span = F.when(F.col("good"), F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end"))
    return ends.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(span)).alias("found")).select("id", "found")


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows with every secret masked in their text and, where there is one, the size column put right.

    The names before assigned values stay.
    """
    kept = docs.columns
    out = docs
    # Step by step, so that each text is worked out once.
    mask = F.lit("[SECRET]")
    text = F.col(text_col)
    out = out.withColumn(text_col, _replaced(text, ASSIGN, lambda m: F.when(_good_assign(m), F.concat(F.regexp_extract(m, ASSIGN, 1), F.lit("="), mask)).otherwise(m)))
    out = out.withColumn(text_col, _replaced(text, ACCESS, lambda m: mask))
    out = out.withColumn(text_col, _replaced(text, HEX, lambda m: mask))
    out = out.withColumn(text_col, _replaced(text, CANDIDATE, lambda m: F.when(is_secret(m), mask).otherwise(m)))
    if size_col in kept:
        out = out.withColumn(size_col, F.when(text.isNull(), F.col(size_col)).otherwise(F.length(text).cast(docs.schema[size_col].dataType)))
    return out.select(*kept)


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Counts, base digest and all spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = spans(docs)
    kind = F.array(*[F.lit(k) for k in KINDS])
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    told = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"], s["end"])), ",")
    return found.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(told(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), told(F.col("found")).alias("spans"),
    )


def _reference_sql() -> str:
    """The query in DuckDB's SQL, from the same patterns and thresholds."""
    # Its regular expressions fold more than A-Z, so both cases are spelt out.
    names = ASSIGN[ASSIGN.index("(?i:(") + 5 : ASSIGN.index("))")]
    spelt = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in names)
    assign = ASSIGN.replace(f"(?i:({names}))", f"({spelt})")
    q = lambda x: "'" + x.replace("'", "''") + "'"
    size = "list_transform({}, lambda x: length(x))"

    def matched(name: str, source: str, text: str, pattern: str, good: str) -> str:
        return f"""{name} AS (SELECT *, list_transform(range(1, len(m) + 1), lambda i: {good}) AS ok FROM (
          SELECT *, string_split_regex({text}, {q(pattern)}) AS g,
            regexp_extract_all({text}, {q(pattern)}, 0) AS m{", regexp_extract_all(" + text + ", " + q(pattern) + ", 2) AS v" if pattern == assign else ""} FROM {source}))"""

    def found(kind: int, name: str) -> str:
        start = f"list_sum({size.format('g[1:i]')}) + coalesce(list_sum({size.format('m[1:i-1]')}), 0)"
        return f"SELECT row, {kind} AS kind, s AS start, s + n AS stop FROM (SELECT row, unnest(list_transform(range(1, len(m) + 1), lambda i: {start})) AS s, unnest({size.format('m')}) AS n, unnest(ok) AS good FROM {name}) WHERE good"

    blank = "list_aggregate(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i > len(m) THEN '' WHEN ok[i] THEN repeat(' ', length(m[i])) ELSE m[i] END), 'string_agg', '')"
    digits, letters = "length(regexp_replace(m[i], '[^0-9]', '', 'g'))", "length(regexp_replace(m[i], '[^A-Za-z]', '', 'g'))"
    best = f"list_max(list_transform(range(1, length(m[i]) - {WINDOW - 2}), lambda s: list_entropy(string_split(substr(m[i], s, {WINDOW}), ''))))"
    secret = f"""CASE WHEN regexp_matches(m[i], {q(ALLOWED)}) THEN false
      WHEN regexp_matches(m[i], '^[0-9a-fA-F]+$') THEN {digits} >= 3 AND {letters} >= 3 AND {best} >= {HEX_BITS}
      WHEN {digits} >= 2 AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]') THEN {best} >= {MIXED_BITS}
      ELSE {digits} >= 4 AND {letters} >= 4 AND {best} >= {LOWER_BITS} END"""
    told = "coalesce(string_agg(CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'entropy' END || ':' || start || ':' || stop, ',' ORDER BY start, kind){}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
{matched("assigned", "d", "t", assign, f"length(v[i]) >= {ASSIGN_LEAST}")},
{matched("accessed", "d", "t", ACCESS, "true")},
{matched("hexed", "d", "t", HEX, "true")},
b0 AS (SELECT row, {blank} AS t FROM assigned),
{matched("a1", "b0", "t", ACCESS, "true")},
b1 AS (SELECT row, {blank} AS t FROM a1),
{matched("a2", "b1", "t", HEX, "true")},
b2 AS (SELECT row, {blank} AS t FROM a2),
{matched("candidates", "b2", "t", CANDIDATE, secret)},
spans AS ({found(0, "assigned")} UNION ALL {found(1, "accessed")} UNION ALL {found(2, "hexed")} UNION ALL {found(3, "candidates")}),
told AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  {told.format(" FILTER (WHERE kind < 3)")} AS base, {told.format("")} AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (row)"""


OP10_SQL = _reference_sql()
