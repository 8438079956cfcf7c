"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule's cost and selectivity are estimated on a sample; rules then run in the order of rejections per cost, and a text
that a rule rejects reaches none of the later ones. The order changes the work, never the verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = "#*$%&|<>"
#: Rows that the sample holds on average.
SAMPLE_ROWS = 500
#: Bits of the hashes by which windows of words are first told apart; equal hashes are then compared word by word.
HASH_BITS = 64
#: Units of work, about a nanosecond each: a comparison of counts, a character translated, one matched by an expression, a word hashed.
COMPARE, TRANSLATE, MATCH, HASH = 50, 3, 15, 60


def text_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty), words (an array of the words of the whole text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    bare = F.btrim("text", F.lit(SPACES))
    return rows.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \x09-\x0D]+")))


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda's body would evaluate it for each element, and so it would where the
    optimizer merges projections or pushes a filter below them."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(keys: Column) -> Column:
    """The positions, ascending, of the keys that occur twice or more."""

    def found(pairs: Column) -> Column:
        same = lambda x, k, by: F.coalesce(x["h"] == F.get(pairs, k + by)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(pairs, lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["i"]))

    return _let(F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), found)


def _covered(at: Column) -> Column:
    """How many words the windows at these positions cover."""
    return F.aggregate(F.transform(at, lambda v, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), v - F.get(at, k - 1)))), F.lit(0), lambda a, v: a + v)


def _repeat_words(words: Column) -> Column:
    """A window's hash is that of its halves' hashes. Where hashes repeat, the windows themselves are compared: if two that
    differ share a hash, the count goes by the windows' words."""
    window = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)])  # noqa: E731  # get() is constant in time; slice() would copy the array
    places = lambda h, step: F.sequence(F.lit(0), F.size(h) - step - 1)
    narrow = lambda h: h if HASH_BITS == 64 else F.pmod(h, F.lit(1 << HASH_BITS))
    joined = lambda h, step: F.transform(places(h, step), lambda i: narrow(F.xxhash64(F.get(h, i), F.get(h, i + step))))
    distinct = lambda x: F.size(F.array_distinct(x))

    def verified(h: Column) -> Column:
        def check(at: Column) -> Column:
            alike = distinct(F.transform(at, window)) == distinct(F.transform(at, lambda i: F.get(h, i)))
            return F.when(alike, _covered(at)).otherwise(_let(_repeated(F.transform(places(words, WINDOW - 1), window)), _covered))

        return F.when(distinct(h) == F.size(h), F.lit(0)).otherwise(_let(_repeated(h), check))

    hashed = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(joined(h, 1), lambda h2: _let(joined(h2, 2), lambda h4: _let(joined(h4, 4), verified))))
    return F.when(F.size(words) >= WINDOW, hashed).otherwise(F.lit(0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, words and the base counts of every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = text_columns(docs, id_col, text_col)
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return rows.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(F.col("words"), _repeat_words).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A rule rejects a text where its condition is true; work is what the condition takes, in units. Both read the columns of measures()."""

    name: str
    rejects: Column
    work: Column


def rules() -> list[Rule]:
    text, n = F.col("text"), F.col("n_words")
    upper = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}", ""))
    marks = F.length(text) - F.length(F.translate(text, "!?", ""))
    size = F.length(text)
    return [
        Rule("mean_word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n), F.lit(2 * COMPARE)),
        Rule("symbols", 10 * F.col("n_symbols") > n, F.lit(COMPARE)),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.size(F.split(text, "\n")), COMPARE + MATCH * size),
        Rule("exclamations", 10 * marks > 3 * n, COMPARE + TRANSLATE * size),
        Rule("capitals", 10 * upper > 3 * letters, COMPARE + 2 * MATCH * size),
        Rule("vocabulary", (n >= 50) & (5 * F.size(F.array_distinct("words")) < n), COMPARE + F.when(n >= 50, HASH * n).otherwise(0)),
    ]


def cascade_order(rows: DataFrame, all_rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per work, both summed over a sample of rows (columns of text_columns are read) that pass the
    base; rules of equal value stay in the given order. One aggregation where the rows are read: no clock, so repeated runs agree."""
    total = rows.count()
    if not total or not all_rules:
        return all_rules
    sample = measures(rows.sample(min(1.0, sample_rows / total), seed=7)).where(~base_failed())
    sums = [x for r in all_rules for x in (F.count_if(r.rejects), F.coalesce(F.sum(r.work), F.lit(0)))]
    found = sample.agg(*[c.alias(f"c{k}") for k, c in enumerate(sums)]).head()
    value = {r.name: found[2 * k] / max(1, found[2 * k + 1]) for k, r in enumerate(all_rules)}
    return sorted(all_rules, key=lambda r: -value[r.name])


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, and failed_rule (null if none; of several the first as
    the rules are given, whatever order the cascade takes).

    Null and empty texts have no words and fail the base; counts cover whole texts; repeated rows are judged each; an empty
    table gives no rows. Windows whose hashes repeat are compared word by word."""
    given = all_rules or rules()
    kept = ~base_failed()
    for r in cascade_order(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), given):
        kept = F.when(kept, ~F.coalesce(r.rejects, F.lit(False))).otherwise(False)  # a rejected text reaches no later rule
    failed = F.when(F.col("kept"), F.lit(None).cast("string")).when(base_failed(), F.lit("base"))
    for r in given:
        failed = failed.when(F.coalesce(r.rejects, F.lit(False)), F.lit(r.name))
    rows = measures(docs, id_col, text_col).withColumn("kept", kept).withColumn("failed_rule", failed)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "kept", "failed_rule")
