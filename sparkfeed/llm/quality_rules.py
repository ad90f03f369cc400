"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Measures and verdict are one ``select`` without user functions, shuffles or joins; Spark runs it
where the text is. Words are runs of characters other than space, tab and the four line controls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import col, fresh, let

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words in a window, for the words in windows that a text has more than once.
WINDOW = 8
#: Frequent words of languages written in Latin letters: English, French, German, Spanish, Italian,
#: Portuguese, Dutch, the Scandinavian ones, Polish, Czech, Turkish, Romanian, Hungarian, Finnish, Indonesian, Vietnamese.
STOP_WORDS = (
    "the of and to a in is it that for on with as are be this by at from or an not have was "
    "le la les de des du un une et est que qui dans pour en sur au par pas ce il elle avec ne plus "
    "der die das und ist von zu den mit ein eine auf für im dem nicht als auch sich es an "
    "el los las del y una por con para no se lo al como más pero su "
    "di che è per sono della non gli anche nel dei "
    "os um uma não dos da em mais foi ao ele "
    "het een van dat niet zijn voor met ook aan "
    "och att som är inte til av og er ikke den det på "
    "nie jest się na do że jak przez "
    "je že se na ve pro jsou "
    "bir ve bu için ile çok daha olarak "
    "și este din care pentru nu "
    "az és hogy nem egy van "
    "ja on ei että oli mutta "
    "yang dan ini itu dengan untuk tidak "
    "và của là không được các"
).split()
#: Characters of other scripts, in which these words don't occur and words may not be parted by spaces.
OTHER_SCRIPTS = r"[\x{0370}-\x{1DFF}\x{1F00}-\x{1FFF}\x{2C00}-\x{D7FF}\x{F900}-\x{FAFF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10000}-\x{1BFFF}\x{20000}-\x{3FFFF}]"

#: (name, measure, least, most): a text is kept if each measure lies within its bounds.
#: ``base`` rules are fixed by contract; the others are this method's own verdict.
BASE_RULES = [
    ("n_words", "n_words", 20, None),
    ("repeat_words_pct", "100 * n_repeat_words / n_words", None, 30),
]
RULES = [
    ("word_length", "word_chars / n_words", 2.0, 14.0),
    ("symbol_ratio", "n_symbols / n_words", None, 0.30),
    ("stop_ratio", "n_stop_words / n_words", 0.03, None),
    ("dup_line_ratio", "n_dup_lines / n_lines", None, 0.50),
    ("ellipsis_line_ratio", "n_ellipsis_lines / n_lines", None, 0.50),
    ("bullet_line_ratio", "n_bullet_lines / n_lines", None, 0.95),
    ("upper_word_ratio", "n_upper_words / n_words", None, 0.40),
]
#: Rules that are not asked of texts whose characters are for more than this share of other scripts.
LATIN_ONLY, OTHER_SHARE = ("word_length", "stop_ratio"), 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES, -1), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window which the text has twice or more, first ones included.

    Windows are compared by a 64-bit hash. Texts without an equal pair, found by one distinct, are
    done; for others the windows are sorted, and what equal neighbours cover is summed up.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda k: F.coalesce((F.get(s, k)["h"] == F.get(s, k + 1)["h"]) & (k >= 0), F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k) | F.when(k > 0, same(k - 1)).otherwise(False))
            return F.array_sort(F.transform(at, lambda k: F.get(s, k)["i"]))

        total = F.aggregate(
            let(ordered, starts),
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-window).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")),
        )
        return total["n"]

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - window)
        hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))
        return let(hashes, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("bigint")).otherwise(covered(x)))

    none = F.lit(0).cast("bigint")
    return F.when(F.size(words) <= window, none).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def measures(text: Column) -> Column:
    """A struct of all that the rules refer to."""
    text = F.coalesce(text, F.lit(""))
    count = lambda xs, test: F.size(F.filter(xs, test)).cast("bigint")
    stop = [w.lower() for w in dict.fromkeys(STOP_WORDS)]

    def of_words(words: Column) -> Column:
        full = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
        return let(full, lambda lines: F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(lines).cast("bigint").alias("n_lines"),
            count(words, lambda w: F.lower(w).isin(stop)).alias("n_stop_words"),
            count(words, lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)).alias("n_upper_words"),
            count(lines, lambda x: x.endswith("...") | x.endswith("…")).alias("n_ellipsis_lines"),
            count(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]")).alias("n_bullet_lines"),
            # texts of ASCII characters alone have none
            F.when(F.octet_length(text) > F.length(text), F.regexp_count(text, F.lit(OTHER_SCRIPTS))).otherwise(0).cast("bigint").alias("n_other_chars"),
        ))

    return let(words_of(text), of_words)


def violations(m: Column, rules: list) -> Column:
    """The names of the rules that the measures ``m`` break; a ratio over nothing breaks none."""
    broken = []
    for name, measure, least, most in rules:
        top, _, bottom = measure.partition(" / ")
        factor, _, field = top.rpartition(" * ")
        value, scale = m[field].cast("double") * float(factor or 1), m[bottom].cast("double") if bottom else F.lit(1.0)
        tests = ([value < F.lit(float(least)) * scale] if least is not None else []) + ([value > F.lit(float(most)) * scale] if most is not None else [])
        asked = (scale > 0) & (m["n_other_chars"] <= OTHER_SHARE * m["word_chars"]) if name in LATIN_ONLY else scale > 0
        for test in tests:
            broken.append(F.when(test & asked, F.lit(name)))
    return F.array_compact(F.array(*broken))


def quality_measures(docs: DataFrame, text_col: str = "text", rules: list = RULES, base_rules: list = BASE_RULES) -> DataFrame:
    """``docs`` with columns ``measures`` (struct), ``base_broken`` and ``broken`` (names of rules).

    Null and empty texts have no words: they break the base rule on length. Every row gives a row,
    repeated ones too; other columns pass through. If ``docs`` has a column of one of the new
    names, the new one gets underscores at its end.
    """
    m, base, broken = fresh(docs, "measures", "base_broken", "broken")
    packed = let(measures(col(text_col)), lambda x: F.struct(x.alias("m"), violations(x, base_rules).alias("b"), violations(x, rules).alias("r")))
    (tmp,) = fresh(docs, "packed")
    return docs.withColumn(tmp, packed).select(*map(col, docs.columns), col(tmp)["m"].alias(m), col(tmp)["b"].alias(base), col(tmp)["r"].alias(broken))


def keep_good(docs: DataFrame, text_col: str = "text", rules: list = RULES, base_rules: list = BASE_RULES) -> DataFrame:
    """The rows of ``docs``, with their own columns, that break no rule.

    Null and empty texts are too short and go; of repeated rows all stay or all go, as each is judged
    by its text alone. Columns with the names of measures pass through like others; an empty table
    gives no rows.
    """
    found = quality_measures(docs, text_col, rules, base_rules)
    base, broken = found.columns[-2:]
    return found.where((F.size(col(base)) == 0) & (F.size(col(broken)) == 0)).select(*map(col, docs.columns))
