"""Column functions on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that count as Latin handwriting; words that say nothing in an id; hints of a secret.
LATIN = r"\x20-\x7E\xA0-ɏ‘-”…€₹"
NOISE_WORDS = ["et", "edit", "edittext", "txt", "text", "input", "field", "view", "new", "id", "tv", "ed"]
SECRET = "(?i)pass|pin|secret|otp"


def clean_text(s: Column) -> Column:
    """Control characters become spaces, runs of white space one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[\x00-\x1f]", " "), r"\s+", " "))


def is_latin(s: Column) -> Column:
    """Every character lies in the Latin ranges; true for an empty string."""
    return s.rlike(f"^[{LATIN}]*$")


def label_from_id(rid: Column) -> Column:
    """The last two telling words of an identifier, capitalised."""
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(rid, "([a-z])([A-Z])", "$1 $2"), "[_-]", " ")), r"\s+")
    keep = F.filter(words, lambda w: (w != "") & ~w.isin(NOISE_WORDS) & ~w.rlike("^[0-9]+$"))
    last = F.array_join(F.when(F.size(keep) > 2, F.slice(keep, -2, 2)).otherwise(keep), " ")
    return F.concat(F.upper(F.substring(last, 1, 1)), F.substring(last, 2, 1 << 30))


def short_words(s: Column, limit: int) -> Column:
    """Whole words from the start while they and a space fit the limit, else a hard cut; a string that fits is left alone."""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("over"))

    def step(acc: Column, w: Column) -> Column:
        over = acc["over"] | (F.char_length(acc["out"]) + F.char_length(w) + 1 > limit)
        return F.struct(F.when(over, acc["out"]).when(acc["out"] == "", w).otherwise(F.concat_ws(" ", acc["out"], w)).alias("out"), over.alias("over"))

    cut = F.aggregate(words, start, step)["out"]
    return F.when(F.char_length(s) <= limit, s).when(cut == "", F.substring(s, 1, limit)).otherwise(cut)


def slug(title: Column) -> Column:
    """Lower-case letters and digits joined by underscores; s_ before anything that doesn't start with a letter."""
    out = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when((out != "") & ~out.rlike("^[a-z]"), F.concat(F.lit("s_"), out)).otherwise(out)


def prompt_text(s: Column, most: int = 40) -> Column:
    """Text for a prompt line: no double quotes, white space collapsed, cut; null if nothing is left."""
    return F.nullif(F.left(F.trim(F.regexp_replace(F.replace(s, F.lit('"'), F.lit("'")), r"\s+", " ")), F.lit(most)), F.lit(""))


def tail_of(s: Column, mark: str) -> Column:
    """What follows the last mark."""
    return F.substring_index(s, mark, -1)


def list_mark(s: Column) -> Column:
    """n of a repeat mark such as "x5", within 1 to 50; null if it is none."""
    digits = F.regexp_extract(s, r"^\s*[xX×*]\s*(\d{1,2})\s*$", 1)
    return F.when(digits != "", F.greatest(F.lit(1), F.least(F.lit(50), digits.cast("int"))))


def repeat_count(kind: Column, text: Column, readings: Column | None = None) -> Column:
    """How often an element repeats: the mark in its text, else in one of its first three readings; 3 for a mark that can't be read; null for no mark."""
    others = [list_mark(F.get(readings, F.lit(k))) for k in range(3)] if readings is not None else []
    return F.coalesce(list_mark(text), *others, F.when(kind == "listmark", F.lit(3)))


def secret_hint(s: Column) -> Column:
    return F.coalesce(s.rlike(SECRET), F.lit(False))


def sanitize_code(s: Column) -> Column:
    """Letters, digits, _ and - alone; "anon" if none is left."""
    return F.coalesce(F.nullif(F.regexp_replace(s, "[^A-Za-z0-9_-]", ""), F.lit("")), F.lit("anon"))


def sample_id(split: Column, n: Column) -> Column:
    return F.format_string("%s-%06d", split, n)


def chat_format(messages: Column) -> Column:
    """One training string from an array of (role, content)."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<"), m["role"], F.lit(">\n"), m["content"], F.lit("\n</"), m["role"], F.lit(">"))), "\n")


def token_count(s: Column) -> Column:
    """Words and single marks."""
    return F.size(F.regexp_extract_all(s, F.lit(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"), F.lit(0)))


def extract_json(s: Column) -> Column:
    """From the first brace to the last; null if there is none."""
    return F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit(""))
