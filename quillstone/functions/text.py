"""Text functions as Column expressions. Spark-side regular expressions are Java's; white space follows Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(c), rf"\A{SPACE}+|{SPACE}+\z", "")


def trimmed_end(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"{SPACE}+\z", "")


def tokenize(c: Column | str) -> Column:
    """Lower-cased runs of letters, marks and digits of at least two characters."""
    return F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), lambda x: F.length(x) > 1)


def detect_locale(c: Column | str) -> Column:
    """hi if more than 30 % of the characters that are no white space are Devanagari, else en; for queries."""
    text = F.coalesce(col(c), F.lit(""))
    solid = F.regexp_replace(text, SPACE, "")
    return F.when(F.regexp_count(text, F.lit(r"[\x{0900}-\x{097F}]")) > 0.3 * F.length(solid), "hi").otherwise("en")


def upload_locale(c: Column | str) -> Column:
    """hi if there is any Devanagari character, else en; for uploaded documents."""
    return F.when(F.coalesce(col(c).rlike(r"[\x{0900}-\x{097F}]"), F.lit(False)), "hi").otherwise("en")


def slug(c: Column | str, most: int | None = None) -> Column:
    out = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")
    return F.substring(out, 1, most) if most else out


def strip_templates(c: Column | str) -> Column:
    """Template tags and variables and HTML tags become blanks, three or more newlines two; trimmed."""
    out = F.regexp_replace(col(c), r"(?s)\{%-?.*?-?%\}", " ")
    out = F.regexp_replace(out, r"(?s)\{\{.*?\}\}", " ")
    out = F.regexp_replace(out, r"</?[a-zA-Z][^>]*>", " ")
    return trimmed(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def normalize_ocr(c: Column | str) -> Column:
    """Blanks collapsed, words joined over line ends, wrapped lines joined, at most two newlines, trimmed."""
    out = F.regexp_replace(col(c), r"[ \t]+", " ")
    out = F.regexp_replace(out, r"-\n(?=[a-z])", "")
    out = F.regexp_replace(out, r"([^\n.!?:])\n(?=[a-z(₹0-9])", "$1 ")
    return trimmed(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def truncate_runaway(c: Column | str) -> Column:
    """Cut before the first line that begins another turn, then trimmed at the end; untouched without one."""
    mark = rf"\n{SPACE}*(?:User|Assistant){SPACE}*:"
    return F.when(col(c).rlike(mark), trimmed_end(F.element_at(F.split(col(c), mark, 2), 1))).otherwise(col(c))


def cites(c: Column | str) -> Column:
    """The numbers of [n] marks, in order, repeated ones kept."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def snippet(c: Column | str, most: int = 260) -> Column:
    """One line without markup marks, cut with an ellipsis."""
    flat = trimmed(F.regexp_replace(F.regexp_replace(col(c), rf"{SPACE}+", " "), r"[#*|>`]", ""))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def clipped(c: Column | str, most: int) -> Column:
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most - 1), F.lit("…"))).otherwise(col(c))


def word_count(c: Column | str) -> Column:
    """Parts between white space; blank ends count as parts, an empty text as one."""
    return F.size(F.split(col(c), rf"{SPACE}+")).cast("long")


def block_kind(c: Column | str) -> Column:
    """heading, list, table or para of a display block."""
    text = col(c)
    return (
        F.when(text.rlike(r"\A#{1,4}\s"), "heading").when(text.rlike(r"\A(?:[-*]|\d+\.)\s"), "list").when(text.rlike(r"\A\|"), "table").otherwise("para")
    )


def tenth(c: Column | str) -> Column:
    """A number from 0 with one decimal: rounded to ten decimals, then halves up, so 7.2499999999999 is 7.3. From 1e15 on as it is written."""
    x = col(c).cast("double")
    units = F.rint(x * 1e10)
    past = units % 1e9  # exact, as remainders of doubles are
    tenths = F.rint((units - past) / 1e9).cast("long") + F.when(past >= 5e8, 1).otherwise(0)
    digits = F.concat(F.floor((tenths - tenths % 10) / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(x < 1e15, digits).otherwise(F.format_string("%.1f", x))


def format_bytes(c: Column | str) -> Column:
    n = col(c).cast("double")
    out = F.lit("—")
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        x = n / float(1024**power)
        here = F.when(x >= 100, F.concat(F.floor(x + 0.5).cast("string"), F.lit(f" {unit}"))).otherwise(F.concat(tenth(x), F.lit(f" {unit}")))
        out = F.when(n >= float(1024**power) if power else n > 0, here).otherwise(out)
    return F.when(n.isNull() | F.isnan(n) | (n == float("inf")), "—").otherwise(out)


def format_ms(c: Column | str) -> Column:
    n = col(c).cast("double")
    return (
        F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), "—").when(n < 1, "<1 ms")
        .when(n < 1000, F.concat(F.floor(n + 0.5).cast("string"), F.lit(" ms"))).otherwise(F.concat(tenth(n / 1000), F.lit(" s")))
    )


def format_date(c: Column | str) -> Column:
    """d MMM yyyy; a dash for null and empty, the text itself if it is no date."""
    text = col(c).cast("string")
    return F.when(text.isNull() | (text == ""), "—").otherwise(F.coalesce(F.date_format(F.expr(f"try_cast({_name(c)} AS date)") if isinstance(c, str) else text.try_cast("date"), "d MMM yyyy"), text))


def _name(c: str) -> str:
    return f"`{c}`"


def premise(passages: Column | str, most: int = 1600) -> Column:
    """`heading. text` of an array of passages, a line each, cut."""
    return F.substring(F.array_join(F.transform(col(passages), lambda p: F.concat(p["heading"], F.lit(". "), p["text"])), "\n"), 1, most)


def _numbered(passages: Column | str, head: str, most: int | None) -> Column:
    def one(p: Column, i: Column) -> Column:
        text = F.substring(p["text"], 1, most) if most else p["text"]
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p[head], F.lit(" — "), p["heading"], F.lit("\n"), text)

    return F.array_join(F.transform(col(passages), one), "\n\n")


def grounded_prompt(query: Column | str, passages: Column | str, intro: str) -> Column:
    """A question over numbered passages (title, heading, text cut at 900 characters); the intro is the caller's."""
    return F.concat(F.lit(intro + "\n\n"), _numbered(passages, "title", 900), F.lit("\n\nQuestion: "), col(query), F.lit("\nAnswer:"))


def chat_prompt(question: Column | str, passages: Column | str, history: Column | str, intro: str) -> Column:
    """As grounded_prompt with whole passages and the turns so far (role, text), if any."""
    turns = F.array_join(F.transform(col(history), lambda m: F.concat(F.when(m["role"] == "user", "User").otherwise("Assistant"), F.lit(": "), m["text"])), "\n")
    said = F.when(turns == "", "").otherwise(F.concat(F.lit("Conversation so far:\n"), turns, F.lit("\n")))
    return F.concat(F.lit(intro + "\n\n"), _numbered(passages, "title", None), F.lit("\n\n"), said, F.lit("\nUser: "), col(question), F.lit("\nAssistant:"))


def score_percent(value: Column | str, top: Column | float = 1.0) -> Column:
    """A score as a share of the top in percent, between 0 and 100."""
    whole = top if isinstance(top, Column) else F.lit(float(top))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), col(value).cast("double") / whole * 100))


def base36(c: Column | str) -> Column:
    """A whole number from 0 in digits and small letters, as in ids made of milliseconds."""
    return F.lower(F.conv(col(c).cast("string"), 10, 36))
