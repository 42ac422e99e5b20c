"""Quality rules: a threshold table compiled into one Spark projection.

Every measure and verdict is a column expression over its own row: no user
function, join or shuffle, so the job is one scan whose cost follows the text.

Edge cases: a null or empty text has no words, so all its counts are 0 and it
fails the base rule (fewer than 10 words). Repeated rows are judged alike, an
empty table gives an empty result, and other columns of the input pass through
``apply_rules`` untouched (its working columns start with ``_qr_``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, ws_words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

# --- fixed values: frequent function words of four languages ---
STOP_WORDS = """
the of and to is in it that for with as be on was are by this at from or an a not
der die und das ist den von zu mit sich auf für nicht ein eine als auch dem des im wie bei
le la les de et un une du en est que qui dans pour par sur au pas il elle ce
el los las del y con una es al se su no lo como
""".split()


@dataclass(frozen=True)
class Rule:
    """A document fails when measure / base lies outside [low, high], both in percent.

    Applies to documents of at least ``min_words`` words. Ratios are compared
    as integers: 100 * measure against bound * base.
    """

    name: str
    measure: str
    base: str
    low: int | None = None
    high: int | None = None
    min_words: int = 0


# The threshold table. Lengths: mean word length in code points. Symbols per
# word. Stop words per word (only texts long enough to hold some). Lines:
# repeated, bullet and unfinished lines per non-blank line.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 20),
    Rule("exclamations", "n_exclaim", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 6, None, 50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90, 50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 40, 50),
)


def _count_chars(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def _shifted(words: Column, m: Column) -> Column:
    """Array of structs of WINDOW consecutive words (fields '0'..'4'), ``m`` of them."""
    return F.arrays_zip(*[F.slice(words, k + 1, m).alias(str(k)) for k in range(WINDOW)])


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures that the rules read; keeps every input column.

    Words in 5-word windows found twice or more: 64-bit window hashes tell
    whether a text has any repeat at all (equal windows have equal hashes);
    only then are its windows sorted as strings, each equal neighbour marked,
    and the marked windows' union measured. All within the row.
    """
    lines = F.filter(F.split(F.col("_qr_t"), "\n"),
                     lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    stops = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]
    window = F.struct
    d = df.withColumn("_qr_t", text_or_empty(text_col))
    d = d.withColumns({"_qr_w": ws_words(F.col("_qr_t")), "_qr_l": lines})
    d = d.withColumn("_qr_m", F.greatest(F.size("_qr_w") - (WINDOW - 1), F.lit(0)))
    d = d.withColumn("_qr_h", F.transform(
        _shifted(F.col("_qr_w"), F.col("_qr_m")),
        lambda x: F.xxhash64(*[x[str(k)] for k in range(WINDOW)])))
    none = "array<struct<s:string,i:int>>"
    texts = F.transform(_shifted(F.col("_qr_w"), F.col("_qr_m")),
                        lambda x, i: window(F.concat_ws(" ", *[x[str(k)] for k in range(WINDOW)]).alias("s"),
                                            i.alias("i")))
    d = d.withColumn("_qr_s", F.when(F.size(F.array_distinct("_qr_h")) < F.size("_qr_h"),
                                     F.array_sort(texts)).otherwise(F.array().cast(none)))
    n = F.size("_qr_s")
    d = d.withColumn("_qr_e", F.zip_with(  # whether each sorted window equals the next one
        F.col("_qr_s"), F.slice("_qr_s", 2, F.greatest(n, F.lit(1))),
        lambda a, b: F.coalesce(a["s"] == b["s"], F.lit(False))))
    marked = F.filter(
        F.arrays_zip(F.col("_qr_s").alias("w"), F.col("_qr_e").alias("next"),
                     F.slice(F.concat(F.array(F.lit(False)), F.col("_qr_e")), 1, n).alias("prev")),
        lambda x: x["next"] | x["prev"])
    d = d.withColumn("_qr_p", F.array_sort(F.transform(marked, lambda x: x["w"]["i"])))
    covered = F.aggregate(
        F.zip_with(F.col("_qr_p"), F.slice("_qr_p", 2, F.greatest(F.size("_qr_p"), F.lit(1))),
                   lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda acc, x: acc + x)
    out = {
        "n_words": F.size("_qr_w"),
        "word_chars": F.length(F.array_join("_qr_w", "")),
        "n_symbols": _count_chars(F.col("_qr_t"), SYMBOLS),
        "n_exclaim": _count_chars(F.col("_qr_t"), "!"),
        "n_stop_words": F.size(F.filter(F.col("_qr_w"), lambda w: w.isin(*stops))),
        "n_lines": F.size("_qr_l"),
        "n_dup_lines": F.size("_qr_l") - F.size(F.array_distinct("_qr_l")),
        "n_bullet_lines": F.size(F.filter(F.col("_qr_l"), lambda x: F.ltrim(x).rlike("^[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(F.col("_qr_l"), lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))),
        "n_repeat_words": covered,
    }
    return (d.withColumns({k: v.cast("long") for k, v in out.items()})
            .drop("_qr_t", "_qr_w", "_qr_l", "_qr_m", "_qr_h", "_qr_s", "_qr_e", "_qr_p"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failed(r: Rule) -> Column:
    hundred, base, out = 100 * F.col(r.measure), F.col(r.base), F.lit(False)
    if r.low is not None:
        out = out | (hundred < r.low * base)
    if r.high is not None:
        out = out | (hundred > r.high * base)
    return out & (F.col("n_words") >= r.min_words)


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add base_failed, failed_rules (names, in table order) and kept to measured rows."""
    failed = F.array_compact(F.array(*[F.when(rule_failed(r), F.lit(r.name)) for r in rules]))
    return (df.withColumns({"base_failed": base_failed(), "failed_rules": failed})
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_exclaim", "n_stop_words", "n_lines",
            "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words"]


def apply_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``df`` that pass the base rule and every rule of the table, unchanged.

    The input row travels as one struct, so a column named like a measure
    neither clashes nor is lost. The verdict is applied by an outer explode: a
    plain filter would be pushed below the measures, with every measure spelt
    out, and computed, again for each use in the predicate.
    """
    packed = df.select(F.struct("*").alias("_row"), F.col(text_col).alias("text"))
    judged = judge(measures(packed), rules)
    kept = judged.select(F.explode_outer(F.when(F.col("kept"), F.array("_row"))).alias("_row"))
    return kept.where("_row is not null").select("_row.*")


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed, kept and the failed rules' names (comma-joined)."""
    d = judge(measures(docs.select("doc_id", "text")), rules)
    return d.select("doc_id", *MEASURES, "base_failed", "kept",
                    F.concat_ws(",", "failed_rules").alias("failed_rules"))
