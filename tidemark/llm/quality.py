"""Quality rules, line first; DataFrame functions only.

Every line of a text is tested by three rules:

* punctuation: symbol characters or doubled exclamation marks at the rate of one for each
  ``SYMBOL_EVERY`` words or more;
* navigation: three or more stand-alone separators (``|``, ``>>`` and the like);
* boilerplate: phrases of site furniture at the rate of one for each ``FURNITURE_EVERY`` words
  or more, or more than half of the words inside repeated 3-word windows.

All of them are rates, which do not change with the length of the line.

Lines that fail are removed. A document is rejected when the removed lines held more than
``max_loss`` of its characters, and in any case when the base rules fail it: fewer than
``min_words`` words, or more than half of its words inside repeated 3-word windows.

Defined results: a null text has no words, is rejected and stays null; an empty text is
rejected; repeated rows give repeated rows; an empty table gives an empty table; other columns
are carried along, and columns of the input that clash with an added name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import fresh

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_LOSS = 0.3
#: A line fails when it has one symbol for so many words, or more.
SYMBOL_EVERY = 3
#: A line of so many words or more fails when more than half of them are inside repeated windows.
REPEAT_WORDS = 8
#: A line fails when it has one phrase of site furniture for so many words, or more.
FURNITURE_EVERY = 20
FURNITURE = (
    "(?i)(accept (all )?cookies|cookie policy|privacy policy|terms of (use|service)|all rights reserved|enable javascript|"
    "(log|sign) in to|sign up for|subscribe to our|click here to|share (this|on) |follow us on|back to top|skip to (main )?content|lorem ipsum)"
)
#: What ``FURNITURE`` finds, told apart by first letters; this is only asked whether there is a match.
FURNISHED = (
    "(?i)(?=[abceflpst])(?:a(?:ccept (?:all )?cookies|ll rights reserved)|back to top|c(?:ookie policy|lick here to)|enable javascript|follow us on|"
    "l(?:og in to|orem ipsum)|privacy policy|s(?:ign (?:in to|up for)|ubscribe to our|hare (?:this|on) |kip to (?:main )?content)|terms of (?:use|service))"
)
#: A text without one of these has no symbol, doubled exclamation mark or separator.
MARKS = r"[#*$%&|<>»›·•/]|!!"

ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "loss", "cleaned")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that later filters cannot take apart.

    A filter on a plain column is pushed below it with its expression copied, arrays that an
    inner function reads for each element included. What a generator gives stays as it is.
    """
    return df.select("*", F.inline(F.array(F.struct(*(column.alias(name) for name, column in columns.items())))))


def _symbols(column: Column) -> Column:
    return F.length(column) - F.length(F.translate(column, SYMBOLS, ""))


def _words(column: Column) -> Column:
    return F.filter(F.split(column, SPACE), lambda w: w != "")


def _covered(windows: Column) -> Column:
    """Words covered by those 3-word windows of the array that occur twice or more in it.

    Windows are sorted by text; a window with an equal neighbour repeats. The starts of those
    windows, sorted, each cover three words, less what the next one covers as well.
    """

    def starts(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return _let(
            placed,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["k"] == x["k"])) | ((j + 1 < F.size(s)) & (F.get(s, j + 1)["k"] == x["k"]))),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, j: F.coalesce(F.least(F.lit(3), F.get(at, j + 1) - p), F.lit(3))), F.lit(0), lambda a, b: a + b)

    return _let(windows, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), _let(starts(k), covered)).otherwise(0))


def _heads(words: Column) -> Column:
    """The words that start a 3-word window."""
    return F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def repeated_words(words: str) -> Column:
    """Words of the array column ``words`` in 3-word windows that occur twice or more in it."""
    word = F.col(words)
    return _covered(F.transform(_heads(word), lambda w, i: F.concat_ws(" ", w, word[i + 1], word[i + 2])))


def _mostly_repeats(words: Column) -> Column:
    """Whether more than half of the words of the array are inside repeated windows.

    Each such word occurs twice or more, so that fewer than 3/4 of all words are distinct then;
    lines with more need no windows.
    """
    windows = F.transform(_heads(words), lambda w, i: F.concat(w, F.lit(" "), words[i + 1], F.lit(" "), words[i + 2]))
    return (F.size(F.array_distinct(words)) * 4 < F.size(words) * 3) & (_covered(windows) * 2 > F.size(words))


def line_fails(line: Column, marked: Column | None = None) -> Column:
    """Whether the line, which holds a word, fails a rule.

    ``marked``: whether its text matches ``MARKS``, without which it breaks no rule on symbols or separators.
    """
    marked = F.lit(True) if marked is None else marked
    n_words = F.size(F.split(F.trim(line), " +"))
    symbols = _symbols(line) + F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("!")))
    punctuation = symbols * SYMBOL_EVERY >= n_words
    navigation = F.length(F.regexp_replace(line, r"(^|\s)(\||>>?|»|›|·|•|/)(?=\s|$)", "$1$2\u0001")) - F.length(line) >= 3
    furniture = line.rlike(FURNISHED) & (F.regexp_count(line, F.lit(FURNITURE)) * FURNITURE_EVERY >= n_words)
    repeats = F.exists(F.array(_words(line)), lambda w: (F.size(w) >= REPEAT_WORDS) & _mostly_repeats(w))
    return (marked & (((symbols > 0) & punctuation) | navigation)) | furniture | repeats


def assess(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_loss: float = MAX_LOSS) -> DataFrame:
    """``df`` with the counts, the verdicts and the cleaned text of each row."""
    kept = [c for c in df.columns if c.lower() not in ADDED]
    whole, word, line, dup, good, repeat, mark = fresh([*kept, *ADDED], "_content", "_words", "_lines", "_dup", "_good", "_repeat", "_marked")
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(*(F.col(f"`{c}`") for c in kept), content.alias(whole))
    rows = _computed(rows, {word: _words(F.col(whole)), line: F.split(whole, "\n"), mark: F.rlike(F.col(whole), F.lit(MARKS))})
    has_word = lambda line: F.btrim(line, F.lit(BLANKS)) != ""
    rows = _computed(
        rows,
        {
            dup: _let(F.filter(line, has_word), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))),
            good: F.filter(line, lambda line: ~(has_word(line) & line_fails(line, F.col(mark)))),
            repeat: repeated_words(word),
        },
    )
    n_words, n_repeat = F.size(word).cast("long"), F.col(repeat).cast("long")
    failed = (n_words < min_words) | (n_repeat * 100 > n_words * 50)
    cleaned = F.array_join(good, "\n")
    rows = rows.withColumns(
        {
            "n_words": n_words,
            "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
            "n_symbols": _symbols(F.col(whole)).cast("long"),
            "n_dup_lines": F.col(dup).cast("long"),
            "n_repeat_words": n_repeat,
            "base_failed": failed,
            "cleaned": F.when(F.col(f"`{text}`").isNotNull(), cleaned),
            "loss": 1 - F.length(cleaned) / F.greatest(F.length(whole), F.lit(1)),
        }
    )
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("loss") <= max_loss))
    return rows.select(*(F.col(f"`{c}`") for c in kept), *ADDED)


def cleaned_documents(df: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The documents that are kept, without the lines that failed; the columns of ``df``."""
    clashing = [c for c in df.columns if c.lower() in ADDED]
    held = dict(zip(clashing, fresh(df.columns, *(f"_held_{c}" for c in clashing))))  # their own values, under other names meanwhile
    good = assess(df.withColumnsRenamed(held), text).filter("kept")
    made = {text: F.col("cleaned"), chars: F.length("cleaned").cast("long")}
    return good.select(*(made[c].alias(c) if c in made else F.col(f"`{held.get(c, c)}`").alias(c) for c in df.columns))
