"""Text expressions: cleaning, keys, tokens, ids. All are Column builders but repair_mojibake."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The form of an identifier that is the same everywhere.
GUID = r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"
# Words that do not tell addresses apart.
COMMON_ADDRESS_WORDS = ("российская", "федерация", "область", "район", "имущества", "имущество", "расположенное", "адресу")

# The Latin spelling of Cyrillic letters in slugs.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), where value is worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean(c: Column | str) -> Column:
    """Tags become blanks, white space of any kind one blank; null becomes empty."""
    bare = F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"(?s)<[^<>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)[\s   ]+", " "))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def tokens(c: Column | str, ignored: tuple[str, ...] = COMMON_ADDRESS_WORDS) -> Column:
    """Distinct lower-case words of two letters or more that tell texts apart, in the order they first occur."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[0-9a-zа-яё]+"), 0)
    return F.filter(F.array_distinct(words), lambda w: (F.length(w) > 1) & ~w.isin(*ignored))


def shared_share(x: Column | str, y: Column | str) -> Column:
    """Shared strings of two arrays of different ones over the smaller number; 0 where one has none."""
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def containment(a: Column | str, b: Column | str) -> Column:
    """Shared tokens over the smaller number of tokens; 0 where one has none."""
    return shared_share(tokens(a), tokens(b))


def contains_all_terms(text: Column | str, query: str) -> Column:
    """Every term of the query occurs: as a word, or anywhere if it has one or two characters."""
    low = F.lower(col(text))
    found = F.lit(True)
    for term in query.lower().split():
        quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        found = found & (low.contains(term) if len(term) <= 2 else low.rlike(rf"(?U)(?<![\w]){quoted}(?![\w])"))
    return found


def slug(c: Column | str, longest: int = 100, default: str = "online") -> Column:
    low = F.lower(F.coalesce(col(c), F.lit("")))
    plain = {k: v for k, v in LATIN.items() if len(v) == 1}
    low = F.translate(low, "".join([*plain, "ъь"]), "".join(plain.values()))
    for k, v in LATIN.items():
        if len(v) > 1:
            low = F.replace(low, F.lit(k), F.lit(v))
    out = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", F.lit(default)).otherwise(F.substring(out, 1, longest))


def hash_id(c: Column, length: int = 20) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def join_ids(*parts: Column | str) -> Column:
    """The non-blank parts joined by _; null if there is none."""
    given = F.filter(F.array(*[clean(p) for p in parts]), lambda x: x != "")
    return F.when(F.size(given) > 0, F.array_join(given, "_"))


def lot_id_of_url(c: Column | str) -> Column:
    found = F.regexp_extract(col(c), r"/lot/([^/?#]+)", 1)
    return F.when(found != "", found)


def is_guid(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c)).rlike(f"^{GUID}$"), F.lit(False))


def shorten(c: Column | str, longest: int = 200) -> Column:
    text = col(c)
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)


def is_transient_error(c: Column | str) -> Column:
    """Errors worth another attempt: time-outs, lost connections, overload and server faults."""
    # What such messages hold.
    return contains_any(F.lower(F.coalesce(col(c), F.lit(""))), ("timeout", "timed out", "connection", "temporarily", "429", "500", "502", "503", "504"))


@F.pandas_udf(T.StringType())
def repair_mojibake(texts: pd.Series) -> pd.Series:
    """UTF-8 that was read as Latin-1, only where its signature shows and the repair is possible."""

    def repair(x: str | None) -> str | None:
        if x and ("Ð" in x or "Ñ" in x):
            try:
                return x.encode("latin-1").decode("utf-8")
            except UnicodeError:
                return x
        return x

    return texts.map(repair)
